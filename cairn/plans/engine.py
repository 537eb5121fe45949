"""The memory engine over a store: remember, resolve, recall, validate, cache, consensus, sessions.

Times are explicit: every call that writes takes ``as_of``. Reads have no side
effects; ``commit_access`` and ``commit_hits`` write what a read returned.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import values as C
from cairn.functions.schema import EXPORTED, MEMORY_FIELDS, TABLES
from cairn.functions.vectors import embed, embedder
from cairn.operators import conflict as K
from cairn.operators import grounding as G
from cairn.operators.keyword_index import KeywordIndex
from cairn.operators.store import NotFound, Store
from cairn.operators.vector_index import VectorIndex
from cairn.plans import recall as R
from cairn.sources import files
from cairn.sources.shared import fresh_folder, settle


#: Entries of the embedding queue that a worker takes at a time.
CLAIM = 1 << 16


def parse_scope(name: str | None) -> str:
    return name if name in C.SCOPES else "personal"


def parse_action(name: str) -> str:
    action = "discard_new" if name == "discard" else name
    if action not in C.RESOLUTIONS:
        raise ValueError(f"unknown action: {name}")
    return action


class Engine:
    """One named database below a root folder."""

    def __init__(self, spark: SparkSession, root: str, name: str = "default", config: dict | None = None, as_of: str = R.AS_OF):
        safe = spark.range(1).select(X.database_name(F.lit(name))).head()[0]
        if safe is None:
            raise ValueError(f"unsafe name: {name}")
        self.spark, self.config = spark, config or files.settings()
        self.store = Store(spark, f"{root.rstrip('/')}/dbs/{safe}", as_of)
        embedder(self.config["embedding"]["provider"])
        self.store.lock_embedding(C.EMBEDDER, self.config["embedding"]["dim"])

    @classmethod
    def temporary(cls, spark: SparkSession, config: dict | None = None, as_of: str = R.AS_OF) -> Engine:
        """A database in a folder of its own below the shared folder, to be kept only by ``save``."""
        return cls(spark, fresh_folder(spark, "engine"), config=config, as_of=as_of)

    def configuration(self) -> DataFrame:
        """section, name and value (as JSON) of every setting, and of what the store is locked to."""
        rows = [(section, key, json.dumps(value)) for section, values in self.config.items() for key, value in values.items()]
        locked = [("store", r["key"], json.dumps(r["value"])) for r in self.store.table("meta").orderBy("key").collect()]  # a handful
        return self.spark.createDataFrame(sorted(rows + locked), "section string, name string, value string")

    # small helpers

    def _one(self, table: str, **values) -> DataFrame:
        """A row of a table; columns that are not given are null."""
        columns = self.spark.createDataFrame([], TABLES[table]).schema.fields
        given = {k: v if not isinstance(v, (str, int, float, bool, type(None))) else F.lit(v) for k, v in values.items()}
        return self.spark.range(1).select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in columns))

    @staticmethod
    def _id(*parts: str) -> str:
        return hashlib.sha256("\u0001".join(parts).encode()).hexdigest()[:26]

    def _log(self, memory_id: str, event: str, as_of: str, actor: str, detail: str | None = None) -> None:
        key = self._id("timeline", memory_id, event, as_of, actor, detail or "", uuid.uuid4().hex)
        self.store.upsert("timeline", self._one("timeline", id=key, memory_id=memory_id, event_type=event, detail=detail, actor=actor, created_at=as_of))

    def _link(self, source: str, target: str, kind: str, as_of: str, by: str) -> None:
        self.store.upsert("edges", self._one("edges", id=self._id("edge", source, target, kind, as_of), source_id=source, target_id=target, edge_type=kind, created_at=as_of, created_by=by))

    def _author(self, author: str | None) -> str:
        return author or self.config["author"]["id"]

    def _new(self, id_: str, content: str, author: str, room, scope, type_, tags, source_type, as_of) -> DataFrame:
        """A memory row of a raw text, settled so that it is computed once."""
        raw = self.spark.createDataFrame([(id_, content, author, room, as_of)], "id string, content string, author string, room string, at string")
        clean = X.preprocess("content", self.config["privacy"]["exclude_patterns"])["text"]
        rows = files.as_memories(raw.select("id", clean.alias("content"), "author", "room", F.col("at").cast("timestamp").alias("created_at")), self.config["compress"]["intensity"], with_embedding=True)
        rows = rows.withColumns({"scope": F.lit(parse_scope(scope)), "source_type": F.lit(source_type), "tags": X.merge_tags(F.array(*map(F.lit, tags)).cast("array<string>"), "tags")})
        if type_:
            rows = rows.withColumn("memory_type", F.lit(type_))
        row = rows.withColumn("embedded_at", F.col("created_at")).head()
        if not row["content"]:
            raise ValueError("nothing is left of the text")
        return self.spark.createDataFrame([row], TABLES["memories"])

    # write

    def remember(self, content: str, author: str | None = None, room: str | None = None, scope: str | None = None, memory_type: str | None = None, tags: tuple[str, ...] = (), source_type: str = "manual", as_of: str = R.AS_OF) -> dict:
        """Stores a text, resolves its conflict at once, or leaves it for review: status, id, conflict_id, resolution."""
        author = self._author(author)
        id_ = self._id("memory", content, author, as_of)
        new = self._new(id_, content, author, room, scope, memory_type, tags, source_type, as_of)
        routed = R.ingest_batch(new, self.store.table("memories"), self.config).head()
        if routed["outcome"] == "stored":
            self._persist(new, as_of, author)
            return {"status": "stored", "id": id_}
        if routed["outcome"] == "auto_resolved":
            kept = self._apply(new, routed["resolution"], [routed["existing_id"]], None, as_of, author)
            return {"status": "auto_resolved", "id": kept, "resolution": routed["resolution"], "relation": routed["relation"]}
        key = self._id("conflict", id_)
        analysis = F.struct(*(F.lit(routed[c]).alias(c) for c in ("relation", "confidence", "reasoning", "key_difference", "suggested_action", "existing_id", "tier")))
        row = new.select(
            F.lit(key).alias("id"), F.struct(*MEMORY_FIELDS).alias("new_memory"), F.array(*map(F.lit, routed["candidate_ids"])).alias("existing_memory_ids"), analysis.alias("analysis"), F.lit("pending").alias("state"),
            F.lit(as_of).cast("timestamp").alias("created_at"), K.expiry(F.lit(as_of).cast("timestamp"), self.config["conflict"]["expiry_secs"]).alias("expires_at"),
        )
        self.store.upsert("conflicts", row)
        return {"status": "conflict", "conflict_id": key, "relation": routed["relation"], "existing_id": routed["existing_id"]}

    def ingest_sequential(self, rows: list[dict]) -> list[dict]:
        """Remembers texts one after another, each seeing those before; ``ingest_batch`` sees one snapshot."""
        return [self.remember(**row) for row in rows]

    def _persist(self, new: DataFrame, as_of: str, actor: str, event: str = "created") -> str:
        self.store.append("memories", new)
        id_ = new.head()["id"]
        self._log(id_, event, as_of, actor)
        return id_

    def _apply(self, new: DataFrame, action: str, existing: list[str], merged: str | None, as_of: str, actor: str) -> str:
        now = F.lit(as_of).cast("timestamp")
        if action == "discard_new":
            self._log(existing[0], "refreshed", as_of, actor)
            return existing[0]
        if action == "merge":
            if not merged:
                raise ValueError("a merge needs its content")
            level = X.levels(F.lit(merged), self.config["compress"]["intensity"])
            row = new.withColumns({"content": F.lit(merged), "_l": level, "embedding": embed(F.lit(merged)), "id": F.lit(self._id("merge", merged, as_of))})
            row = row.withColumns({c: F.col(f"_l.{c}") for c in ("compressed", "summary", "headline")}).drop("_l").head()
            new = self.spark.createDataFrame([row], TABLES["memories"])
        id_ = self._persist(new, as_of, actor)
        for old in existing:
            if action == "keep_both":
                self._link(id_, old, "complements", as_of, actor)
                continue
            self.store.update("memories", [old], state=F.lit("superseded"), in_index=F.lit(False), updated_at=now)
            self._link(id_, old, "supersedes", as_of, actor)
            self.store.cache_invalidate(old)
            if action == "replace":
                self._log(old, "superseded", as_of, actor, id_)
        return id_

    def resolve(self, conflict_id: str, action: str, context: str | None = None, merged: str | None = None, by: str | None = None, as_of: str = R.AS_OF) -> str:
        """Applies an action to a pending conflict and all its candidates; returns the id that stands."""
        action, by = parse_action(action), self._author(by)
        conflict = self.store.require("conflicts", conflict_id)
        if conflict["state"] != "pending":
            raise ValueError(f"conflict is {conflict['state']}")
        if action == "merge" and not merged:
            raise ValueError("a merge needs its content")
        resolution = F.struct(F.lit(action).alias("action"), F.lit(context).cast("string").alias("context"), F.lit(merged).cast("string").alias("merged_content"))
        done = {"state": F.lit("resolved"), "resolution": resolution, "resolved_at": F.lit(as_of).cast("timestamp"), "resolved_by": F.lit(by)}
        if self.store.change("conflicts", lambda c: c.filter((F.col("id") == conflict_id) & (F.col("state") == "pending")).withColumns(done)) is None:
            raise ValueError("conflict was resolved meanwhile")  # one of several resolvers goes on
        row = {**conflict["new_memory"].asDict(), "in_index": True}
        new = self.spark.createDataFrame([row], f"{EXPORTED}, in_index boolean").withColumn("embedding", embed("content")).withColumn("embedded_at", F.lit(as_of).cast("timestamp"))
        new = self.spark.createDataFrame([new.select(*self.store.table("memories").columns).head()], TABLES["memories"])
        return self._apply(new, action, list(conflict["existing_memory_ids"]), merged, as_of, by)

    def resolve_many(self, decisions: DataFrame, by: str | None = None, as_of: str = R.AS_OF) -> DataFrame:
        """Applies decisions (conflict_id, action, merged) to the pending ones of these conflicts, all at once; returns what they changed.

        Of resolvers that decide the same conflict at once one goes on. A merge without content is left pending.
        """
        by, now = self._author(by), F.lit(as_of).cast("timestamp")
        asked = decisions.select(F.col("conflict_id").alias("id"), "action", "merged").filter(F.col("action").isin(*C.RESOLUTIONS) & ((F.col("action") != "merge") | (F.coalesce("merged", F.lit("")) != "")))
        outcome = F.struct(F.col("action"), F.lit(None).cast("string").alias("context"), F.col("merged").alias("merged_content"))
        done = {"state": F.lit("resolved"), "resolution": outcome, "resolved_at": now, "resolved_by": F.lit(by)}
        taken = self.store.change("conflicts", lambda c: c.filter("state = 'pending'").join(asked, "id").withColumns(done))
        if taken is None:
            return self.spark.createDataFrame([], "conflict_id string, kind string, id string, other string, what string")
        hashed = lambda *parts: F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 26)
        decided = taken.select(F.col("id").alias("conflict_id"), "resolution.action", F.col("new_memory.id").alias("new_id"), hashed(F.lit("merge"), "resolution.merged_content", F.lit(as_of)).alias("merged_id"), F.col("existing_memory_ids").alias("existing_ids"), F.col("resolution.merged_content").alias("merged"), "new_memory")
        changes = settle(K.resolution_changes(decided))
        of = lambda kind: changes.filter(F.col("kind") == kind)
        level = X.levels("merged", self.config["compress"]["intensity"])
        added = of("added").select("conflict_id", F.col("id").alias("_id")).join(decided, "conflict_id").withColumn("_l", F.when(F.col("action") == "merge", level))
        pick = lambda c: F.coalesce(F.col(f"_l.{c}"), F.col(f"new_memory.{c}"))
        content = F.when(F.col("action") == "merge", F.col("merged")).otherwise(F.col("new_memory.content"))
        made = {"id": F.col("_id"), "content": content, **{c: pick(c) for c in ("compressed", "summary", "headline")}}
        rows = added.select(*(made.get(c, F.col(f"new_memory.{c}")).alias(c) for c in MEMORY_FIELDS)).dropDuplicates(["id"])
        rows = rows.withColumns({"embedding": embed("content"), "in_index": F.lit(True), "embedded_at": now})
        if not rows.isEmpty():
            self.store.append("memories", rows)
        gone = of("superseded").select("id").distinct()
        self.store.update("memories", gone, state=F.lit("superseded"), in_index=F.lit(False), updated_at=now)
        edges = of("edge").select(hashed(F.lit("edge"), "id", "other", "what", F.lit(as_of)).alias("id"), F.col("id").alias("source_id"), F.col("other").alias("target_id"), F.col("what").alias("edge_type"), now.alias("created_at"), F.lit(by).alias("created_by"))
        self.store.upsert("edges", edges.dropDuplicates(["id"]))
        events = of("event").select(hashed(F.lit("timeline"), "conflict_id", "id", "what", F.lit(as_of)).alias("id"), F.col("id").alias("memory_id"), F.col("what").alias("event_type"), F.col("other").alias("detail"), F.lit(by).alias("actor"), now.alias("created_at"))
        self.store.upsert("timeline", events.dropDuplicates(["id"]))
        self.store.delete("cache", lambda t: t.join(t.select("id", F.explode("source_ids").alias("_of")).join(gone.select(F.col("id").alias("_of")), "_of", "left_semi").select("id").distinct(), "id", "left_semi"))
        return changes

    def endorse_many(self, votes: DataFrame, as_of: str = R.AS_OF) -> int:
        """Takes votes (id, author) for memories in at once; returns how many memories changed."""
        rows = self.store.change("memories", lambda m: K.endorse(m.join(votes.select("id").distinct(), "id", "left_semi"), votes, as_of))
        return 0 if rows is None else rows.count()

    def forget_many(self, ids: DataFrame, as_of: str = R.AS_OF) -> None:
        """Archives memories (id) at once; ids that are not there are passed over."""
        self.store.update("memories", ids.select("id").distinct(), state=F.lit("archived"), in_index=F.lit(False), updated_at=F.lit(as_of).cast("timestamp"))

    def forget(self, id_: str, actor: str | None = None, as_of: str = R.AS_OF) -> None:
        """Archives a memory; an unknown id is an error."""
        self.store.require("memories", id_)
        self.store.update("memories", [id_], state=F.lit("archived"), in_index=F.lit(False), updated_at=F.lit(as_of).cast("timestamp"))
        self.store.cache_invalidate(id_)
        self._log(id_, "archived", as_of, self._author(actor))

    def _vote(self, id_: str, author: str | None, as_of: str, change, event: str, detail: str | None) -> float:
        author = self._author(author)
        self.store.require("memories", id_)
        votes = self.spark.createDataFrame([(id_, author)], "id string, author string")
        row = self.store.change("memories", lambda m: change(m.filter(F.col("id") == id_), votes)).head()
        self._log(id_, event, as_of, author, detail)
        return row["confidence"]

    def endorse(self, id_: str, author: str | None = None, as_of: str = R.AS_OF) -> float:
        return self._vote(id_, author, as_of, lambda m, v: K.endorse(m, v, as_of), "endorsed", None)

    def dispute(self, id_: str, author: str | None = None, reason: str | None = None, as_of: str = R.AS_OF) -> float:
        confidence = self._vote(id_, author, as_of, K.dispute, "disputed", reason)
        self.store.cache_invalidate(id_)
        return confidence

    # read

    def recall(self, queries: DataFrame, **options) -> DataFrame:
        return R.recall(queries, self.store.table("memories"), config=self.config, **options)

    def indexes(self) -> tuple[KeywordIndex, VectorIndex]:
        """The kept indexes beside the store, in step with it: what has changed since the last time is taken in, and much change leads to a merge or a rebuild."""
        words, vectors = KeywordIndex(self.spark, f"{self.store.path}/_keywords"), VectorIndex(self.spark, f"{self.store.path}/_vectors")
        words.sync(self.store)
        vectors.sync(self.store, member="in_index")
        if words.due():
            words.merge()
        if vectors.due():
            vectors.rebuild()
        return words, vectors

    def recall_indexed(self, queries: DataFrame, **options) -> DataFrame:
        """``recall`` by the kept indexes."""
        return self.recall(queries, indexes=self.indexes(), **options)

    def commit_access(self, returned: DataFrame, as_of: str = R.AS_OF) -> None:
        """Counts the ids that a recall returned."""
        ids = returned.select("id")
        touched = lambda m: G.touched(m.join(ids.distinct(), "id", "left_semi"), ids, "access_count")
        self.store.change("memories", lambda m: touched(m).withColumn("last_accessed", F.lit(as_of).cast("timestamp")))

    def memories_by_id(self, ids: list[str]) -> DataFrame:
        """Seven fields of memories in the order asked for."""
        asked = self.spark.createDataFrame(list(enumerate(ids)), "place int, id string")
        return asked.join(self.store.table("memories"), "id").orderBy("place").select("id", "headline", "content", "memory_type", "author", "confidence", "tags")

    def validate(self, answers: DataFrame, evidence_ids: list[str] | None = None, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
        """Report and claims of answers (answer_id, answer, query) against memories by id, or else the recalled ones."""
        memories = self.store.table("memories")
        if evidence_ids is not None:
            found = self.spark.createDataFrame(list(enumerate(evidence_ids)), "rank int, id string")  # the caller's list, for all answers
        else:
            limit = max(self.config["guardrail"]["evidence_limit"], 3)
            asked = answers.select(F.col("answer_id").alias("query_id"), F.coalesce("query", "answer").alias("query"))
            found = self.recall(asked, limit=limit, max_tokens=1 << 30, detail="full").select(F.col("query_id").alias("answer_id"), "rank", "id")
        evidence = found.join(memories.select("id", "content"), "id")
        limit = self.config["guardrail"]["support_threshold"] if threshold is None else threshold
        checks = G.check_claims(answers, evidence, limit)
        return G.report(answers, checks), checks

    def cache_get(self, queries: DataFrame, as_of: str = R.AS_OF, room: str | None = None, hit: float | None = None, answer: float | None = None, ground: float | None = None) -> DataFrame:
        c = self.config["cache"]
        if not c["enabled"]:
            return queries.select("query_id", F.lit("miss").alias("tier"), F.lit(None).cast("string").alias("answer"), F.array().cast("array<string>").alias("ids"))
        asked = queries.withColumn("embedding", embed("query"))
        pick = lambda own, name: c[name] if own is None else own
        return G.lookup(asked, self.store.table("cache"), self.store.table("memories"), as_of, room, pick(hit, "hit_threshold"), pick(answer, "answer_threshold"), pick(ground, "ground_threshold"), c["use_kb"])

    def commit_hits(self, looked_up: DataFrame) -> None:
        ids = looked_up.filter("tier = 'hit'").select(F.col("ids")[0].alias("id"))
        self.store.cache_touch(ids)

    def cache_put(self, query: str, answer: str, source_ids: list[str] = (), room: str | None = None, ttl: int | None = None, as_of: str = R.AS_OF) -> str:
        """Keeps an answer, drops what has expired, and keeps the newest entries."""
        c = self.config["cache"]
        ttl = c["ttl_secs"] if ttl is None else ttl
        key = self._id("cache", query, room or "")
        expires = K.expiry(F.lit(as_of).cast("timestamp"), ttl) if ttl > 0 else None
        row = self._one("cache", id=key, query=query, query_embedding=embed(F.lit(query)), answer=answer, source_ids=F.array(*map(F.lit, source_ids)), room=room, created_at=as_of, expires_at=expires).drop("hits")
        self.store.change("cache", lambda t: row.join(t.filter(F.col("id") == key).select("id", "hits"), "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0))))
        self.store.cache_purge(as_of)
        self.store.cache_evict(c["max_entries"])
        return key

    def save(self, root: str, name: str = "default") -> Engine:
        """Writes the current rows of all tables as another database, and returns it."""
        other = Engine(self.spark, root, name, self.config, self.store.as_of)
        for table in TABLES:
            rows = self.store.table(table)
            if table != "meta" and not rows.isEmpty():
                other.store.upsert(table, rows)
        return other

    # batch jobs

    def export(self, path: str, scope: str | None = None) -> None:
        files.export_memories(self.store.table("memories"), path, scope)

    def import_(self, path: str, as_of: str = R.AS_OF) -> int:
        """Adds memories of JSON lines whose id is new, with their state, without conflict checks."""
        rows = files.new_only(files.read_memories(self.spark, path), self.store.table("memories")).persist()
        try:
            n = rows.count()
            if n:
                now = F.lit(as_of).cast("timestamp")
                self.store.append("memories", rows.withColumns({"embedding": embed("content"), "in_index": F.lit(True), "embedded_at": now}))
                self.store.upsert("timeline", rows.select(F.sha2(F.concat_ws("\u0001", F.lit("imported"), "id", F.lit(as_of)), 256).alias("id"), F.col("id").alias("memory_id"), F.lit("imported").alias("event_type"), F.col("author").alias("actor"), now.alias("created_at")))
            return n
        finally:
            rows.unpersist()

    def reindex(self, as_of: str = R.AS_OF) -> int:
        """Embeds all memories anew, whatever their state, and clears the cache."""
        now = F.lit(as_of).cast("timestamp")
        rows = self.store.change("memories", lambda m: m.withColumns({"embedding": embed("content"), "in_index": F.lit(True), "embedded_at": now}), reads="table")
        self.store.cache_clear()
        self.store.meta_set("embedding_model", C.EMBEDDER)
        return 0 if rows is None else rows.count()

    def drain(self, worker: str, n: int | None = CLAIM, as_of: str = R.AS_OF, seconds: int = 600) -> int:
        """Embeds up to ``n`` queued memories, without ``n`` all, and returns how many the worker finished.

        What a call reads of the queue grows with the queue, so one worker that is to empty it takes all at once.

        A worker that dies leaves its lease to run out; embedding a content again gives the same vector, so what it had written does no harm.
        """
        claimed = self.store.claim(worker, n, as_of, seconds)
        if claimed is None:
            return 0
        last = claimed.groupBy(F.col("target_id").alias("id")).agg(F.max_by("content", "id").alias("_text"))
        vectors = last.select("id", embed("_text").alias("_vector"))
        now = F.lit(as_of).cast("timestamp")
        self.store.change("memories", lambda m: m.join(vectors, "id").withColumns({"embedding": F.col("_vector"), "in_index": F.col("state").isin("active", "disputed"), "embedded_at": now}), columns=["embedding", "in_index", "embedded_at"])
        return self.store.finish(worker, claimed, as_of)

    def expire_conflicts(self, as_of: str) -> None:
        self.store.change("conflicts", lambda c: K.expire(c.filter("state = 'pending'"), as_of))

    def stats(self) -> DataFrame:
        return self.store.stats()

    def get(self, id_: str) -> dict:
        """A memory with its edges."""
        row = self.store.get("memories", id_)
        if row is None:
            raise NotFound(id_)
        edges = self.store.edges_for(self.spark.createDataFrame([(id_,)], "id string"))
        return row.asDict() | {"edges": [e.asDict() for e in edges.orderBy("id").collect()]}
