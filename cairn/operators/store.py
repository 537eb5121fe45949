"""Tables as change logs in Parquet, whose changes are commits.

A change is written aside, with all its rows, and counts once its commit has a number
(``CommitLog``). The current table is, for each key, the row of the latest commit, so the
later of two commits wins whichever store wrote it. A change that was made of what its
store had read is made anew if a commit that came in between touched one of its keys
(told by KEY_MARKS marks of their hashes), and so is one that depends on the whole table if
any commit came. Files are never changed: ``compact`` writes the current rows of a
version in buckets of keys, with Bloom filters, and commits that they stand for all up to it.

A commit of an update has the key and the columns that it sets, one of a deletion the key alone; of
each column the latest commit that has it counts. Reads shuffle only the columns that are asked for.

A commit names the marks and the range of its keys. A lookup by key opens the commits
that may have it, and one bucket of the compacted rows. Keys are distinct within one write.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import values as C
from cairn.functions.schema import KEYS, TABLES
from cairn.sources.commits import CommitLog, Files
from cairn.sources.shared import sound

#: Kinds of keys that a commit tells apart.
KEY_MARKS = 256
#: Rows of one bucket of compacted rows, and buckets at most.
BUCKET_ROWS, BUCKETS = 1 << 18, 1 << 12
#: Commits of a table after which it is compacted.
COMPACT_AFTER = 128
#: How often a change is made anew before it is given up.
ATTEMPTS = 20


class ModelMismatch(ValueError):
    """The store is locked to another embedding model."""


class DimensionMismatch(ValueError):
    """The store is locked to another embedding dimension."""


class NotFound(KeyError):
    """No row has that id."""


class Contended(RuntimeError):
    """Others kept changing the same rows."""


def _fold(state: dict[str, Any], version: int, entry: dict[str, Any]) -> dict[str, Any]:
    """The commits that make up each table: its compacted rows, if any, and those after it."""
    name = entry["table"]
    known = state.get(name, {"base": None, "adds": []})
    if entry["op"] == "compact":
        known = {"base": entry, "adds": [a for a in known["adds"] if a["version"] > entry["upto"]]}
    else:
        known = {"base": known["base"], "adds": [*known["adds"], {**entry, "version": version}]}
    return {**state, name: known}


class Store:
    """The tables below one folder, which may be on any file system of Spark's."""

    def __init__(self, spark: SparkSession, path: str, as_of: str = "1970-01-01 00:00:00"):
        self.spark, self.path, self.as_of = sound(spark), path.rstrip("/"), as_of
        self.compact_after: int | None = COMPACT_AFTER
        self._data = Files(spark, self.path)
        self._commits = CommitLog(Files(spark, f"{self.path}/_commits"), _fold, {})

    # log

    def version(self) -> int:
        """The number of the last commit."""
        self._commits.refresh()
        return self._commits.version

    def _parts(self, name: str) -> dict[str, Any]:
        return self._commits.state.get(name, {"base": None, "adds": []})

    @staticmethod
    def _hash(key: str) -> Column:
        return F.xxhash64(F.col(key))

    def _log(self, name: str, ids: list[Any] | None = None) -> DataFrame:
        """All rows of all commits with their ``_version``; with ids, only commits and buckets that may have one of them."""
        key, parts = KEYS[name], self._parts(name)
        schema = f"{TABLES[name]}, _deleted boolean"
        base, adds = parts["base"], parts["adds"]
        places: list[int] | None = None
        if ids is not None:
            kind, buckets = dict(self._types(name))[key], base["buckets"] if base else 1
            hashed = F.xxhash64(F.col("id").cast(kind))
            found = self.spark.createDataFrame([(str(i),) for i in ids], "id string").select("id", F.pmod(hashed, F.lit(KEY_MARKS)).alias("m"), F.pmod(hashed, F.lit(buckets)).alias("b")).collect()
            places = sorted({r["b"] for r in found})
            adds = [a for a in adds if any((a["marks"] is None or r["m"] in a["marks"]) and a["low"] <= r["id"] <= a["high"] for r in found)]
        logs = []
        if base:
            rows = self.spark.read.schema(f"{schema}, kb int").parquet(f"{self.path}/{name}/{base['path']}")
            logs.append((rows if places is None else rows.filter(F.col("kb").isin(places))).drop("kb").withColumn("_version", F.lit(base["upto"]).cast("bigint")))
        if adds:
            rows = self.spark.read.schema(f"{schema}, c string").option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/{a['path']}" for a in adds))
            if len(adds) == 1:
                rows = rows.withColumn("_version", F.lit(adds[0]["version"]).cast("bigint"))
            else:  # one small row for each commit since the last compaction
                numbers = self.spark.createDataFrame([(a["path"].removeprefix("c="), a["version"]) for a in adds], "c string, _version bigint")
                rows = rows.join(F.broadcast(numbers), "c")
            logs.append(rows.drop("c"))
        if not logs:
            return self.spark.createDataFrame([], f"{schema}, _version bigint")
        return logs[0] if len(logs) == 1 else logs[0].unionByName(logs[1])

    def _types(self, name: str) -> list[tuple[str, str]]:
        return self.spark.createDataFrame([], TABLES[name]).dtypes

    def _latest(self, name: str, log: DataFrame) -> DataFrame:
        """The key, what the latest commits that have it say of each column, and ``_deleted``; a column that is not asked for is not shuffled."""
        key, patches = KEYS[name], [a for a in self._parts(name)["adds"] if a.get("columns") is not None]

        def at(column: str) -> Column:
            without = [a["version"] for a in patches if column not in a["columns"]]
            return F.when(~F.col("_version").isin(without), F.col("_version")) if without else F.col("_version")

        columns = [c for c in log.columns if c != key and not c.startswith("_")]
        return log.groupBy(key).agg(*(F.max_by(c, at(c)).alias(c) for c in columns), F.max_by("_deleted", "_version").alias("_deleted"))

    def _current(self, name: str, ids: list[Any] | None = None, among: DataFrame | None = None) -> DataFrame:
        """The current rows; with ``among`` those whose key is in its column of that name."""
        log, key, parts = self._log(name, ids), KEYS[name], self._parts(name)
        if among is not None:
            log = log.join(among.select(key).distinct(), key, "left_semi")
        columns = [c for c in log.columns if not c.startswith("_")]
        if parts["base"] and not parts["adds"]:
            return log.select(*columns)
        return self._latest(name, log).filter("not _deleted").select(*columns)

    def table(self, name: str) -> DataFrame:
        """The current rows; a condition on the key reaches the files."""
        self._commits.refresh()
        return self._current(name)

    def changes(self, name: str, since: int, upto: int) -> DataFrame | None:
        """The rows of a table that commits after one version and up to another have left, with ``_deleted``; None if a compaction came between."""
        self._commits.refresh()
        parts = self._parts(name)
        if parts["base"] and parts["base"]["upto"] > since:
            return None
        key, log = KEYS[name], self._log(name).filter(F.col("_version") <= upto)
        new = log.filter(F.col("_version") > since)
        if any(a.get("columns") for a in parts["adds"] if since < a["version"] <= upto):  # the other columns of updated rows are older
            new = log.join(new.select(key).distinct(), key, "left_semi")
        return self._latest(name, new)

    def _shaped(self, name: str, rows: DataFrame, columns: list[str] | None) -> DataFrame:
        """Whole rows, columns that are not given being null; with ``columns`` the key and these."""
        fields = [f for f in self.spark.createDataFrame([], TABLES[name]).schema.fields if columns is None or f.name in (KEYS[name], *columns)]
        return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))

    def _stage(self, name: str, rows: DataFrame, deleted: bool) -> dict[str, Any] | None:
        """Writes shaped rows aside; what a commit says of them, or None if there are none."""
        path, key = f"c={uuid.uuid4().hex}", KEYS[name]
        columns = None if len(rows.columns) == len(self._types(name)) else [c for c in rows.columns if c != key]
        rows.withColumn("_deleted", F.lit(deleted)).write.parquet(f"{self.path}/{name}/{path}")
        written = self.spark.read.schema(f"{TABLES[name]}").parquet(f"{self.path}/{name}/{path}")
        text = F.col(key).cast("string")
        n, low, high, marks = written.agg(F.count("*"), F.min(text), F.max(text), F.array_sort(F.collect_set(F.pmod(self._hash(key), F.lit(KEY_MARKS))))).head()
        if not n:
            self._data.delete(f"{name}/{path}")
            return None
        return {"table": name, "op": "add", "path": path, "rows": n, "low": low or "", "high": high or "", "marks": None if len(marks) == KEY_MARKS else list(marks), "columns": columns}

    def commit(self, name: str, make: Callable[[], DataFrame], reads: str = "keys", deleted: bool = False, columns: list[str] | None = None) -> DataFrame | None:
        """Commits the rows that ``make`` gives and returns them, None if there are none.

        ``reads`` says what they were made of: ``nothing`` of the table, the rows with their own ``keys``, or the whole
        ``table``. If others have changed that meanwhile they are made anew. With ``columns`` only these are written beside
        the key, and the others are null in what is returned; so are all but the key of deleted rows.
        """
        for _ in range(ATTEMPTS):
            self._commits.refresh()
            entry = self._stage(name, self._shaped(name, make(), [] if deleted else columns), deleted)
            if entry is None:
                return None
            while not self._commits.put(entry):
                marks = set(entry["marks"] or range(KEY_MARKS))
                others = [e for e in self._commits.refresh() if e["table"] == name and e["op"] == "add"]
                if reads != "nothing" and any(reads == "table" or not marks.isdisjoint(e["marks"] or range(KEY_MARKS)) for e in others):
                    break
            else:
                rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{entry['path']}")
                if self.compact_after and len(self._parts(name)["adds"]) > self.compact_after:
                    self.compact(name)
                return rows
            self._data.delete(f"{name}/{entry['path']}")
        raise Contended(f"{name}: gave up after {ATTEMPTS} attempts")

    def append(self, name: str, rows: DataFrame) -> None:
        """New rows; one with a key that is there already is an error, as is a repeated key."""
        key = KEYS[name]
        if rows.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name}: key exists")

        def make() -> DataFrame:
            if rows.join(self._current(name), key, "left_semi").limit(1).count():
                raise ValueError(f"{name}: key exists")
            return rows

        self.commit(name, make)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Whole rows that are not made of the table's; the later commit stands."""
        self.commit(name, lambda: rows, reads="nothing")

    def change(self, name: str, how: Callable[[DataFrame], DataFrame], reads: str = "keys", among: list[Any] | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """Commits ``how(table)``, made anew whenever the table has changed meanwhile; returns the rows, None if there are none. With ``among`` the table has the rows of these keys, and few others; with ``columns`` these alone change."""
        return self.commit(name, lambda: how(self._current(name, among)), reads, columns=columns)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Whole new rows for keys that are there; one that is not is an error. ``created_at`` stays."""
        key = KEYS[name]

        def made(known: DataFrame) -> DataFrame:
            missing = rows.join(known, key, "left_anti").select(key).head()
            if missing:
                raise NotFound(missing[0])
            return rows.drop("created_at").join(known.select(key, "created_at"), key) if "created_at" in known.columns else rows

        self.change(name, made)

    def update(self, name: str, ids: list[str] | DataFrame, **changes: Column) -> None:
        """Sets columns of the rows with these keys; rows that are not there are passed over."""
        key = KEYS[name]

        def made(rows: DataFrame) -> DataFrame:
            rows = rows.join(ids, key, "left_semi") if isinstance(ids, DataFrame) else rows.filter(F.col(key).isin(ids))
            return rows.withColumns(changes)

        self.change(name, made, columns=list(changes))

    def delete(self, name: str, which: Callable[[DataFrame], DataFrame], reads: str = "keys") -> int:
        """Marks the rows that ``which(table)`` gives as deleted and returns how many."""
        gone = self.commit(name, lambda: which(self._current(name)), reads, deleted=True)
        return 0 if gone is None else gone.count()

    def compact(self, name: str) -> None:
        """Commits the current rows, by key in buckets, in place of all commits so far."""
        self._commits.refresh()
        upto, path, rows = self._commits.version, f"b={uuid.uuid4().hex}", self._current(name)
        total = sum(a["rows"] for a in self._parts(name)["adds"]) + (self._parts(name)["base"] or {"rows": 0})["rows"]
        buckets = min(BUCKETS, 1 << max(0, (total // BUCKET_ROWS).bit_length()))
        key = KEYS[name]
        placed = rows.withColumns({"_deleted": F.lit(False), "kb": F.pmod(self._hash(key), F.lit(buckets)).cast("int")}).repartition(buckets, "kb").sortWithinPartitions("kb", key)
        placed.write.partitionBy("kb").option("parquet.bloom.filter.enabled#" + key, "true").parquet(f"{self.path}/{name}/{path}")
        entry = {"table": name, "op": "compact", "path": path, "upto": upto, "buckets": buckets, "rows": total}
        while not self._commits.put(entry):
            if any(e["table"] == name and e["op"] == "compact" for e in self._commits.refresh()):
                self._data.delete(f"{name}/{path}")  # somebody else has
                return

    # meta

    def meta_get(self, key: str) -> str | None:
        row = self.get("meta", key)
        return row["value"] if row else None

    def meta_set(self, key: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, value)], TABLES["meta"]))

    def lock_embedding(self, model: str, dim: int) -> None:
        """Pins model and dimension on first use; others are an error later."""
        known = {r["key"]: r["value"] for r in self.table("meta").filter(F.col("key").isin("embedding_model", "embedding_dim")).collect()}
        if not known:
            for k, v in (("schema_version", C.SCHEMA_VERSION), ("embedding_model", model), ("embedding_dim", dim), ("created_at", self.as_of)):
                self.meta_set(k, str(v))
        elif known["embedding_model"] != model:
            raise ModelMismatch(f"{known['embedding_model']} is locked, not {model}")
        elif int(known["embedding_dim"]) != dim:
            raise DimensionMismatch(f"{known['embedding_dim']} is locked, not {dim}")

    # lookups

    def lookup(self, name: str, *ids: str) -> DataFrame:
        """The rows with these keys, from the files that may have them."""
        self._commits.refresh()
        return self._current(name, list(ids)).filter(F.col(KEYS[name]).isin(*ids))

    def get(self, name: str, id_: str):
        return self.lookup(name, id_).head()

    def require(self, name: str, id_: str):
        row = self.get(name, id_)
        if row is None:
            raise NotFound(id_)
        return row

    def get_embedding(self, id_: str) -> list[float] | None:
        row = self.lookup("memories", id_).select("embedding").head()
        return row["embedding"] if row else None

    def set_embedding(self, id_: str, embedding: Column | list[float]) -> None:
        """Stores the vector and takes the memory into the index."""
        vector = embedding if isinstance(embedding, Column) else F.array(*map(F.lit, embedding)).cast("array<float>")
        self.update("memories", [id_], embedding=vector, in_index=F.lit(True), embedded_at=F.lit(self.as_of).cast("timestamp"))

    def index(self) -> DataFrame:
        """id and embedding of the memories in the vector index."""
        return self.table("memories").filter("in_index").select("id", "embedding")

    def rebuild_index(self, dim: int) -> int:
        """If no memory is in the index, takes in those that have a vector of that width, whatever their state; returns how many."""
        if not self.index().isEmpty():
            return 0
        fit = self.table("memories").filter(F.size("embedding") == dim)
        n = fit.count()
        if n:
            self.update("memories", fit.select("id"), in_index=F.lit(True))
        return n

    def known_sessions(self, ids: DataFrame) -> DataFrame:
        """Those of the ids that are sessions."""
        return ids.join(self.table("sessions").select("id"), "id", "left_semi")

    def memories(self, room: str | None = None, state: str | None = None, limit: int | None = None) -> DataFrame:
        """Newest first."""
        rows = self.table("memories")
        for column, value in (("room", room), ("state", state)):
            if value is not None:
                rows = rows.filter(F.col(column) == value)
        rows = rows.orderBy(F.desc("created_at"), "id")
        return rows if limit is None else rows.limit(limit)

    def edges_for(self, ids: DataFrame) -> DataFrame:
        """Edges that begin or end at one of the ids, each once."""
        edges, keys = self.table("edges"), ids.select(F.col("id").alias("_id")).distinct()
        ends = [edges.join(keys, F.col(c) == F.col("_id"), "left_semi") for c in ("source_id", "target_id")]
        return ends[0].union(ends[1]).dropDuplicates(["id"])

    def orphan_edges(self) -> DataFrame:
        """Edges without one of their memories."""
        known = self.table("memories").select(F.col("id").alias("_id"))
        edges = self.table("edges")
        return edges.join(known, F.col("source_id") == F.col("_id"), "left_anti").union(edges.join(known, F.col("target_id") == F.col("_id"), "left_anti")).dropDuplicates(["id"])

    def timeline_for(self, ids: DataFrame, limit: int = 10) -> DataFrame:
        from cairn.operators.conflict import newest_first

        return newest_first(self.table("timeline").join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi"), "memory_id", limit)

    def conflicts(self, state: str | None = None) -> DataFrame:
        rows = self.table("conflicts")
        return (rows if state is None else rows.filter(F.col("state") == state)).orderBy(F.desc("created_at"), "id")

    def session_observations(self, session_id: str) -> DataFrame:
        return self.table("observations").filter(F.col("session_id") == session_id).orderBy("created_at", "id")

    # queue

    def enqueue(self, target_type: str, target_id: str, content: str, priority: int) -> int:
        rows = self.spark.createDataFrame([(target_type, target_id, content, priority, 0)], "target_type string, target_id string, content string, priority bigint, place bigint")
        return self.enqueue_all(rows)

    def enqueue_all(self, rows: DataFrame) -> int:
        """Queues rows (target_type, target_id, content, priority, place); ids follow the commit and then the place, and the first possible one is returned.

        An id holds the number of the commit and the place, which is below 2^24.
        """
        first = 0

        def made(_: DataFrame) -> DataFrame:
            nonlocal first
            first = (self._commits.version + 1) << 24
            return rows.withColumns({"id": F.col("place") + first, "status": F.lit("pending"), "created_at": F.lit(self.as_of).cast("timestamp")})

        self.change("embed_queue", made, reads="table")
        return first

    def pending(self, n: int) -> DataFrame:
        return self.table("embed_queue").filter("status = 'pending'").orderBy(F.desc("priority"), "id").limit(n)

    def mark_done(self, ids: int | DataFrame) -> None:
        self.update("embed_queue", [ids] if isinstance(ids, int) else ids, status=F.lit("done"), processed_at=F.lit(self.as_of).cast("timestamp"))

    def claim(self, worker: str, n: int | None, as_of: str, seconds: int = 600) -> DataFrame | None:
        """Leases the first ``n`` entries by priority that are pending, or whose lease is over, to a worker, without ``n`` all of them; None if there are none.

        Of workers that claim at once each entry goes to one: the later commits find the entries taken and choose anew.
        """
        now = F.lit(as_of).cast("timestamp")

        def made(queue: DataFrame) -> DataFrame:
            free = queue.filter((F.col("status") == "pending") | (F.col("status") == "leased") & (F.col("lease_until") <= now))
            first = free if n is None else free.select("id", "priority").orderBy(F.desc("priority"), "id").limit(n)
            return first.select("id").withColumns({"status": F.lit("leased"), "worker": F.lit(worker), "lease_until": now + F.make_interval(secs=F.lit(float(seconds)))})

        taken = self.change("embed_queue", made, columns=["status", "worker", "lease_until"])
        return None if taken is None else self._current("embed_queue", among=taken)

    def finish(self, worker: str, ids: DataFrame, as_of: str) -> int:
        """Marks entries as done that the worker still holds; returns how many."""
        held = (F.col("status") == "leased") & (F.col("worker") == worker)
        done = {"status": F.lit("done"), "processed_at": F.lit(as_of).cast("timestamp")}
        rows = self.change("embed_queue", lambda q: q.filter(held).join(ids.select("id"), "id", "left_semi").withColumns(done), columns=list(done))
        return 0 if rows is None else rows.count()

    # cache

    def cache_count(self) -> int:
        return self.table("cache").count()

    def cache_touch(self, ids: DataFrame) -> None:
        """Counts a hit for each of the ids, repeated ones too."""
        from cairn.operators.grounding import touched

        self.change("cache", lambda t: touched(t.join(ids.select("id").distinct(), "id", "left_semi"), ids, "hits"), columns=["hits"])

    def cache_clear(self, room: str | None = None) -> int:
        return self.delete("cache", lambda t: t if room is None else t.filter(F.col("room") == room))

    def cache_purge(self, as_of: str) -> int:
        return self.delete("cache", lambda t: t.filter(F.col("expires_at") <= F.lit(as_of).cast("timestamp")))

    def cache_invalidate(self, memory_id: str) -> int:
        return self.delete("cache", lambda t: t.filter(F.array_contains("source_ids", memory_id)))

    def cache_evict(self, most: int) -> int:
        from cairn.operators.grounding import evict

        return self.delete("cache", lambda t: t.join(evict(t, most).select("id"), "id", "left_anti"), reads="table")

    def stats(self) -> DataFrame:
        """One row: memories by state, pending conflicts, edges."""
        states = [F.count_if(F.col("state") == s).alias(s) for s in ("active", "disputed", "superseded", "archived")]
        memories = self.table("memories").agg(F.count("*").alias("total"), *states, F.count_if("in_index").alias("indexed"))
        waiting = self.table("conflicts").agg(F.count_if(F.col("state") == "pending").alias("pending_conflicts"))
        return memories.join(F.broadcast(waiting))  # one row each
