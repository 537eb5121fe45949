"""Commits of several stores, lookups by key, compaction, leases."""

import threading

import pytest
from pyspark.sql import functions as F

from cairn.functions.schema import TABLES
from cairn.operators.store import Contended, Store
from cairn.plans.engine import Engine
from cairn.sources.commits import CommitLog, Files


@pytest.fixture
def stores(spark, tmp_path):
    return [Store(spark, f"file://{tmp_path}/s") for _ in range(2)]


def entries(spark, ids, **values):
    return spark.createDataFrame([(i,) for i in ids], "id string").select("id", *(F.lit(v).alias(c) for c, v in values.items()))


def files_read(df):
    """How many files the scans of a plan that has run have opened."""
    name = lambda node: node.getClass().getSimpleName()
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan.executedPlan() if name(plan) == "AdaptiveSparkPlanExec" else plan], 0
    while todo:
        node = todo.pop()
        if name(node).endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_the_later_commit_wins(stores):
    a, b = stores
    for i in range(3):
        a.meta_set("k", f"a{i}")
    b.meta_set("k", "b")
    assert {s.meta_get("k") for s in stores} == {"b"}
    ids = [s.enqueue("memory", name, "", 1) for name, s in zip("xy", stores, strict=True)]
    assert ids[0] < ids[1]
    assert [r["target_id"] for r in a.pending(5).collect()] == ["x", "y"]


def test_a_change_of_what_others_changed_is_made_anew(spark, stores):
    a, b = stores
    a.upsert("cache", entries(spark, ["p", "q"], hits=0))
    seen = []

    def count(table):
        seen.append(1)
        if len(seen) == 1:  # another writer comes between reading and committing
            b.cache_touch(entries(spark, ["p"]))
        return table.filter("id = 'p'").withColumn("hits", F.col("hits") + 1)

    a.change("cache", count)
    assert (len(seen), a.get("cache", "p")["hits"]) == (2, 2)
    seen.clear()

    def other(table):
        seen.append(1)
        b.cache_touch(entries(spark, ["p"]))
        return table.filter("id = 'q'").withColumn("hits", F.lit(9))

    a.change("cache", other)  # another key is no conflict
    assert (len(seen), a.get("cache", "q")["hits"], b.get("cache", "p")["hits"]) == (1, 9, 3)


def test_a_writer_that_is_always_late_gives_up(spark, stores, monkeypatch):
    a, b = stores
    a.upsert("cache", entries(spark, ["p"], hits=0))

    def late(table):
        b.upsert("cache", entries(spark, ["p"], hits=1))
        return table

    monkeypatch.setattr("cairn.operators.store.ATTEMPTS", 3)
    with pytest.raises(Contended):
        a.change("cache", late)
    assert a.get("cache", "p")["hits"] == 1


def test_many_threads_count_every_hit(spark, tmp_path):
    first = Store(spark, f"file://{tmp_path}/s")
    first.upsert("cache", entries(spark, ["p"], hits=0))
    work = [threading.Thread(target=lambda: Store(spark, f"file://{tmp_path}/s").cache_touch(entries(spark, ["p"]))) for _ in range(4)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert first.get("cache", "p")["hits"] == 4


def test_an_append_of_a_key_that_came_meanwhile_is_an_error(spark, stores):
    a, b = stores
    b.append("edges", entries(spark, ["e"], edge_type="x"))
    with pytest.raises(ValueError):
        a.append("edges", entries(spark, ["e"], edge_type="y"))
    assert a.get("edges", "e")["edge_type"] == "x"


@pytest.mark.parametrize("n", [40])
def test_lookups_open_few_files(spark, tmp_path, n):
    store = Store(spark, f"file://{tmp_path}/s")
    store.compact_after = None
    for i in range(n):
        store.upsert("cache", entries(spark, [f"key{i}"], hits=i).coalesce(1))
    row = store.lookup("cache", "key7")
    assert [r["hits"] for r in row.collect()] == [7]
    assert files_read(row) <= 4  # of those that share its mark or none
    whole = store.table("cache")
    assert whole.count() == n
    store.compact("cache")
    assert store.lookup("cache", "nothing").collect() == []
    store.upsert("cache", entries(spark, ["key7"], hits=70))
    assert (store.get("cache", "key7")["hits"], store.table("cache").count()) == (70, n)
    assert store.delete("cache", lambda t: t.filter("id = 'key7'")) == 1
    assert store.get("cache", "key7") is None and store.table("cache").count() == n - 1


def test_compacted_rows_are_in_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cairn.operators.store.BUCKET_ROWS", 64)
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("cache", spark.range(1000).select(F.format_string("k%d", "id").alias("id"), F.col("id").alias("hits")))
    store.compact("cache")
    row = store.lookup("cache", "k500")
    assert [r["hits"] for r in row.collect()] == [500]
    assert store._parts("cache")["base"]["buckets"] == 16 and files_read(row) == 1
    assert {r["hits"] for r in store.table("cache").collect()} == set(range(1000))


def test_compaction_leaves_later_commits(spark, stores):
    a, b = stores
    a.upsert("cache", entries(spark, ["p", "q"], hits=1))
    plain = Store._current

    def slow(self, name, ids=None):
        out = plain(self, name, ids)
        if self is a:
            b.upsert("cache", entries(spark, ["q"], hits=2))  # after the snapshot that is compacted
        return out

    Store._current = slow
    try:
        a.compact("cache")
    finally:
        Store._current = plain
    assert {r["id"]: r["hits"] for r in a.table("cache").collect()} == {"p": 1, "q": 2}
    a.compact_after = 3
    for i in range(6):
        a.upsert("cache", entries(spark, ["p"], hits=i))
    assert len(a._parts("cache")["adds"]) <= 3 and b.get("cache", "p")["hits"] == 5


def test_log_opens_from_its_last_snapshot(spark, tmp_path):
    fold = lambda state, version, entry: {"sum": state["sum"] + entry["x"], "read": state["read"] + [version]}
    log = CommitLog(Files(spark, f"file://{tmp_path}/log"), fold, {"sum": 0, "read": []})
    for i in range(130):
        assert log.put({"x": i})
    again = CommitLog(Files(spark, f"file://{tmp_path}/log"), fold, {"sum": 0, "read": []})
    assert (again.version, again.state["sum"]) == (130, sum(range(130)))
    assert (tmp_path / "log" / "last").read_text() == "128"
    stale = CommitLog(Files(spark, f"file://{tmp_path}/log"), fold, {"sum": 0, "read": []})
    assert log.put({"x": 1}) and not stale.put({"x": 2}) and stale.refresh() == [{"x": 1}]


def test_one_of_two_resolvers_goes_on(spark, tmp_path):
    engines = [Engine(spark, f"file://{tmp_path}/e") for _ in range(2)]
    a, b = engines
    a.remember("Retries enabled for the webhooks of the gateway", author="ana")
    conflict = a.remember("Retries disabled for the webhooks of the gateway", author="bo")
    assert conflict["status"] == "conflict"
    b.resolve(conflict["conflict_id"], "keep_both", by="me")
    with pytest.raises(ValueError):
        a.resolve(conflict["conflict_id"], "replace", by="me")
    assert set(TABLES) >= {"conflicts"} and a.store.table("memories").filter("state = 'active'").count() == 2


def test_an_abandoned_lease_goes_to_another_worker(spark, tmp_path):
    engines = [Engine(spark, f"file://{tmp_path}/e") for _ in range(2)]
    a, b = engines
    a.store.append("memories", spark.createDataFrame([(f"m{i}", f"text {i}", "active", False) for i in range(6)], "id string, content string, state string, in_index boolean"))
    for i in range(6):
        a.store.enqueue("memory", f"m{i}", f"text {i}", i % 3)
    first = a.store.claim("dies", 2, "2026-01-01 00:00:00", seconds=60)
    assert {r["target_id"] for r in first.collect()} == {"m2", "m5"}
    assert b.drain("lives", 10, "2026-01-01 00:00:30") == 4
    assert b.drain("lives", 10, "2026-01-01 00:00:59") == 0
    assert b.store.index().count() == 4
    assert b.drain("lives", 10, "2026-01-01 00:01:00") == 2
    assert a.store.finish("dies", first, "2026-01-01 00:02:00") == 0  # too late
    done = {r["target_id"]: r["worker"] for r in a.store.table("embed_queue").filter("status = 'done'").collect()}
    assert done == {f"m{i}": "lives" for i in range(6)}
    assert a.store.index().count() == 6


def test_two_workers_never_hold_the_same_entry(spark, stores):
    a, b = stores
    a.enqueue_all(spark.range(20).selectExpr("'memory' AS target_type", "cast(id AS string) AS target_id", "'x' AS content", "id AS priority", "id AS place"))
    held, plain = [], Store._stage

    def stage(self, name, rows, deleted):
        out = plain(self, name, rows, deleted)
        if self is a and not held:
            held.append({r["target_id"] for r in b.claim("b", 8, "2026-01-01 00:00:00").collect()})
        return out

    Store._stage = stage
    try:
        mine = {r["target_id"] for r in a.claim("a", 8, "2026-01-01 00:00:00").collect()}
    finally:
        Store._stage = plain
    assert len(mine) == 8 and mine.isdisjoint(held[0])


def test_updates_write_what_they_change(spark, stores):
    """Of a claim, an update and a deletion only keys and changed columns are written; what is read is whole, for indexes and after a compaction too."""
    a, b = stores
    rows = lambda name: {r["id"]: r.asDict() for r in b.table(name).collect()}
    columns = lambda name: b._parts(name)["adds"][-1]["columns"]
    a.upsert("cache", entries(spark, ["x", "y", "z"], query="q", answer="long", hits=0))
    a.cache_touch(spark.createDataFrame([("x",), ("x",), ("y",)], "id string"))
    assert rows("cache")["x"]["answer"] == "long" and rows("cache")["x"]["hits"] == 2 and columns("cache") == ["hits"]
    touched = {r["id"]: r.asDict() for r in b.changes("cache", 1, b.version()).collect()}
    assert set(touched) == {"x", "y"} and touched["x"]["answer"] == "long" and touched["x"]["hits"] == 2
    a.update("cache", ["y"], answer=F.lit(None), room=F.lit("r"))
    assert rows("cache")["y"] | {"query": "q", "answer": None, "room": "r", "hits": 1} == rows("cache")["y"]
    assert a.delete("cache", lambda t: t.filter("id = 'z'")) == 1
    assert set(rows("cache")) == {"x", "y"} and columns("cache") == []
    before = rows("cache")
    a.compact("cache")
    assert rows("cache") == before
    a.upsert("cache", entries(spark, ["y", "z"], query="new"))
    assert rows("cache")["y"]["hits"] is None and rows("cache")["z"]["query"] == "new" and rows("cache")["x"] == before["x"]


def test_one_claim_takes_all(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.store.append("memories", spark.range(9).selectExpr("cast(id AS string) AS id", "'text' AS content", "'active' AS state", "false AS in_index"))
    engine.store.enqueue_all(spark.range(9).selectExpr("'memory' AS target_type", "cast(id AS string) AS target_id", "'text' AS content", "id AS priority", "id AS place"))
    assert {r["target_id"] for r in engine.store.claim("dies", 2, "2026-01-01 00:00:00").collect()} == {"8", "7"}
    before = engine.store.version()
    assert engine.drain("lives", None, "2026-01-01 00:00:01") == 7 and engine.store.version() == before + 3
    parts = engine.store._parts("embed_queue")["adds"]
    assert [a["columns"] for a in parts] == [None, ["status", "worker", "lease_until"], ["status", "worker", "lease_until"], ["status", "processed_at"]]


def test_columns_that_are_not_asked_for_are_not_read(spark, stores):
    a, _ = stores
    a.upsert("cache", entries(spark, ["x", "y"], query="q", answer="long", hits=0))
    a.cache_touch(spark.createDataFrame([("x",)], "id string"))
    plan = a.table("cache").select("id", "hits")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Relation")[0]  # a relation names all its columns, what reads it those that it takes
    assert "hits" in above and "answer" not in above
