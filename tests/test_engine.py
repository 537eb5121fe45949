import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import vectors as V
from cairn.operators import budget as B
from cairn.operators import conflict as K
from cairn.operators import grounding as G
from cairn.operators import search as S
from cairn.operators import similar
from cairn.operators.store import DimensionMismatch, ModelMismatch, NotFound, Store
from cairn.plans.engine import Engine, parse_action, parse_scope
from cairn.sources import files
from cairn.streaming import capture as H


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(("text", "n"), [("one two three", 3), ("a" * 20, 5), ("", 0)])
def test_count_tokens(spark, text, n):
    assert one(spark, X.count_tokens(F.lit(text))) == n


def test_cleaning(spark):
    got = one(spark, X.preprocess(F.lit("a <private>b\nc</private>  d\nsecret.txt\npassword: hunter2hunter2"), ["secret.txt"]))
    assert got["text"] == "a d\n[REDACTED]"
    assert got["redacted"]


def test_types_tags_entities(spark):
    assert one(spark, X.detect_type(F.lit("We decided on Redis"))) == "decision"
    assert one(spark, X.detect_type(F.lit("I prefer tabs"))) == "preference"
    assert one(spark, X.tags(F.lit("Redis and JWT over gRPC"))) == ["jwt", "redis", "grpc"]
    assert one(spark, X.entities(F.lit("Use Redis v7 with redis and Kafka."))) == ["Use", "Redis", "v7", "Kafka."]


def test_compress_keeps_literals(spark):
    text = "Actually the database configuration lives in src/app/config.toml, see `the code` and https://x.org/the/a in order to run."
    got = one(spark, X.compress(F.lit(text)))
    assert got == "DB config lives in src/app/config.toml, see `the code` and https://x.org/the/a to run."
    assert "the" in one(spark, X.compress(F.lit("the cat"), "lite"))


def test_levels(spark):
    got = one(spark, X.levels(F.lit("Search uses port 9200. It is fast. Third.")))
    assert got["headline"] == "SEARCH: 9200"
    assert got["summary"] == "Search uses port 9200. It is fast."


@pytest.mark.parametrize(("name", "safe"), [("my db!", "my-db-"), ("a/b", None), ("..", None), ("", None), ("ok.1", "ok.1")])
def test_database_name(spark, name, safe):
    assert one(spark, X.database_name(F.lit(name))) == safe


def test_embedding(spark):
    rows = spark.createDataFrame([("redis cache layer",), ("redis cache tier",), ("",), (None,)], "t string").select("t", V.embed("t").alias("e")).collect()
    assert len(rows[0]["e"]) == 256
    assert abs(sum(x * x for x in rows[0]["e"]) - 1) < 1e-4
    assert not any(rows[2]["e"])
    assert not any(rows[3]["e"])
    assert V.hashes(*V.strings(pa.array(["redis", "é", ""])))[:2].tolist() == [11748835841157022580, 775207407765167617]
    with pytest.raises(ValueError):
        V.embedder("elsewhere")


def test_hashes_of_slices_and_long_strings():
    def plain(word):
        h = 14695981039346656037
        for byte in word.encode():
            h = (h ^ byte) * 1099511628211 % 2**64
        return h

    words = ["", "redis", "x" * 100_000, "é", "redis", "日本", "a"]
    assert V.hashes(*V.strings(pa.array(words).slice(1, 5))).tolist() == [plain(w) for w in words[1:6]]
    assert V.hashes(*V.strings(pa.array([], pa.string()))).tolist() == []


def test_condense(spark):
    text = "Alpha is first. Beta has the answer here. Gamma closes."
    assert one(spark, B.condense(F.lit("beta answer"), F.lit(text), F.lit(8))) == "Beta has the answer here."
    assert one(spark, B.condense(F.lit("x"), F.lit(text), F.lit(100))) == text


def test_budget_is_a_prefix(spark):
    rows = [("q", i, str(i), "H: x", "s " * 10, "c", 0.8, []) for i in range(1, 9)]
    ranked = spark.createDataFrame(rows, "query_id string, rank int, id string, headline string, summary string, content string, confidence double, tags array<string>")
    ranked = ranked.withColumns({"author": F.lit("me"), "created_at": F.lit("2026-01-01").cast("timestamp")})
    got = sorted(B.allocate(ranked, 60).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert got[-1]["used"] == sum(r["cost"] for r in got) <= 60


def test_votes(spark):
    none = F.array().cast("array<string>")
    m = spark.range(1).select(F.lit("m").alias("id"), F.lit("active").alias("state"), F.lit(0.8).alias("confidence"), none.alias("endorsed_by"), none.alias("disputed_by"), F.lit(None).cast("timestamp").alias("verified_at"))
    votes = spark.createDataFrame([("m", "a"), ("m", "a")], "id string, author string")
    up = K.endorse(m, votes, "2026-01-01")
    assert up.head()["endorsed_by"] == ["a"]
    assert abs(up.head()["confidence"] - 2 / 3) < 1e-9
    assert K.dispute(up, spark.createDataFrame([("m", "b")], "id string, author string")).head()["state"] == "disputed"


def test_grounding(spark):
    answers = spark.createDataFrame([("a", "Redis stores sessions. Moon cheese."), ("b", "")], "answer_id string, answer string")
    evidence = spark.createDataFrame([("a", 1, "m", "redis stores all sessions")], "answer_id string, rank int, id string, content string")
    checks = G.check_claims(answers, evidence)
    report = {r["answer_id"]: r for r in G.report(answers, checks).collect()}
    assert report["a"]["unsupported"] == ["Moon cheese."]
    assert not report["a"]["grounded"]
    assert not report["b"]["grounded"]
    assert report["b"]["n_claims"] == 0


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.lock_embedding("m", 4)
    store.lock_embedding("m", 4)
    with pytest.raises(ModelMismatch):
        store.lock_embedding("n", 4)
    with pytest.raises(DimensionMismatch):
        store.lock_embedding("m", 5)
    ids = [store.enqueue("memory", x, "text", p) for x, p in (("a", 1), ("b", 5))]
    assert [r["target_id"] for r in store.pending(5).collect()] == ["b", "a"]
    store.mark_done(ids[1])
    store.compact("embed_queue")
    assert [r["target_id"] for r in store.pending(5).collect()] == ["a"]
    assert Store(spark, f"file://{tmp_path}/s").meta_get("embedding_dim") == "4"


def test_store_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "2026-01-05 00:00:00")
    rows = spark.createDataFrame([("a", "one", "2026-01-01", [1.0, 0.0]), ("b", "two", "2026-01-02", [0.0]), ("c", "three", "2026-01-03", None)], "id string, content string, created_at string, embedding array<float>")
    store.append("memories", rows.withColumn("in_index", F.lit(False)))
    with pytest.raises(ValueError):
        store.append("memories", rows)
    with pytest.raises(NotFound):
        store.replace("memories", spark.createDataFrame([("a", "x"), ("zz", "y")], "id string, content string"))
    store.replace("memories", spark.createDataFrame([("a", "new", "2030-01-01")], "id string, content string, created_at string").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))).withColumn("in_index", F.lit(False)))
    row = store.get("memories", "a")
    assert (row["content"], str(row["created_at"])) == ("new", "2026-01-01 00:00:00")
    assert store.rebuild_index(2) == 1
    assert store.rebuild_index(2) == 0
    store.set_embedding("c", [0.5, 0.5])
    assert store.get_embedding("c") == [0.5, 0.5]
    assert store.get_embedding("zz") is None
    assert {r["id"] for r in store.index().collect()} == {"a", "c"}
    store.upsert("sessions", spark.createDataFrame([("s",)], "id string"))
    assert [r["id"] for r in store.known_sessions(spark.createDataFrame([("s",), ("t",)], "id string")).collect()] == ["s"]
    plan = store.table("memories").filter("id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,a)" in plan


def test_neighbours_of_mixed_widths_and_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0])], "query_id long, embedding array<float>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), *((i, [0.0, 3.0]) for i in range(20, 9, -1))], "id long, embedding array<float>").repartition(3)
    got = {}
    for r in S.nearest(q, v, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["sim"]))
    assert sorted(got[1]) == [(1, 3, 1.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert sorted(got[2]) == [(1, 2, 1.0), (2, 10, 1.0), (3, 11, 1.0)]
    assert sorted(got[3]) == sorted(got[4]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    assert S.nearest(q, v.limit(0), 3).count() == 0


def test_fused_ids_are_not_doubled(spark):
    """The inputs of the union are read in unlike numbers of partitions; each id still comes once."""
    rows = spark.createDataFrame([(q, f"d{i}", float(i)) for q in range(3) for i in range(9)], "query_id int, id string, x double")
    ranks = [rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("x"), "id"))) for _ in range(2)]
    few = spark.createDataFrame([(0, "d1", 1.0)], "query_id int, id string, x double").groupBy("query_id").agg(F.min("id").alias("id")).withColumn("rank", F.lit(1))
    found = S.fuse([*ranks, few]).select("id")
    again = found.groupBy("id").agg(F.count("*").alias("n")).join(found.distinct(), "id")
    assert {r["n"] for r in again.collect()} == {3}


def test_keyword_by_matrix_and_by_joins(spark, monkeypatch):
    rng = random.Random(6)
    some = lambda n: " ".join(rng.choice(["a", "bé", "c-d", "d", "e'f", "f", "x9", "Und so", "d-a"]) for _ in range(n))
    empty = F.array().cast("array<string>").alias
    docs = spark.createDataFrame([(f"m{i}", some(rng.randrange(12))) for i in range(90)], "id string, content string").select("id", "content", F.lit("").alias("summary"), empty("tags"), empty("entities"))
    asked = spark.createDataFrame([*((i, some(6)) for i in range(7)), (8, ""), (9, "nowhere c-d-a"), (10, None)], "query_id long, query string")
    monkeypatch.setattr(S, "ROWS", 4)
    matrix = S.keyword(asked, docs, 5).collect()
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    joined = S.keyword(asked, docs, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in matrix) == sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in joined)
    assert len(matrix) >= 35


def test_summary_and_entities_from_the_head(spark):
    rng = random.Random(7)
    words = ["in order to", "the", "Redis.", "well", "a.b/c.py", "`x. y`", "plain", "K8s", "due to the fact that", "application.", "\n", "Ünder", "v2.1", "\u0000", "now. "]
    texts = ["", "one. two", *(" ".join(rng.choice(words[: rng.choice([5, 9, 15])]) for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.summary(X.compress("t")).alias("s"), X.entities("t").alias("e"))
    want = [(r["s"], r["e"]) for r in df.collect()]
    for head in (40, 120):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(X, "HEAD", head)
            assert [(r["s"], r["e"]) for r in df.select(X.summary_of("t").alias("s"), X.entities("t").alias("e")).collect()] == want


def test_levels_compress_once(spark):
    plan = spark.range(1).select(F.lit("a b").alias("t")).select(X.levels("t").alias("l"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1


def test_embedding_is_that_of_the_features(spark):
    rows = spark.createDataFrame([("redis cache redis cache layer",), ("é é",), ("a",)], "t string").select("t", V.embed("t", 16).alias("e"))
    hashed = rows.select("t", "e", F.explode_outer(V.features("t")).alias("f")).withColumn("h", V.fnv1a("f")).select("t", "e", V.bucket("h", 16).alias("b"), V.sign("h").alias("s"))
    for r in hashed.groupBy("t", "e").agg(F.collect_list(F.struct("b", "s")).alias("x")).collect():
        sums = [sum(x["s"] for x in r["x"] if x["b"] == i and x["s"]) for i in range(16)]
        length = sum(x * x for x in sums) ** 0.5 or 1
        assert r["e"] == pytest.approx([x / length for x in sums], abs=1e-6)


def test_similar_documents(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 4)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(4000)}" for _ in range(40)] for _ in range(4)]
    texts = []
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(40)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(words))
    rows = list(enumerate([*texts, *texts[:10], "", None, "lone", texts[0].replace(" ", "  ")]))
    sets = {i: frozenset((t or "").split()) for i, t in rows}
    alike = lambda a, b: (not a and not b) or len(a & b) / len(a | b) > 0.9
    want = {i: (min(j for j in sets if sets[j] == s), sum(alike(s, o) for j, o in sets.items() if j != i)) for i, s in sets.items()}
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in got} == want


def test_similar_documents_moves_no_texts(spark):
    rng = random.Random(5)
    texts = [[f"word{rng.randrange(3000)}" for _ in range(600)] for _ in range(150)]
    rows = list(enumerate(" ".join(t) for x in texts for t in (x, [*x[5:], "other", "words"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    written = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    assert {r["links"] for r in similar.similar_documents(df).collect()} == {1}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert written() - before < 5 * sum(len(t) for _, t in rows)


def test_similar_documents_of_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, "quite another text"), (2, long + " more"), (None, long + " most"), (None, "lone")]
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["links"]) for r in got) == [(0, 0), (0, 2), (1, 0), (1, 2), (2, 2)]


def test_engine(spark, tmp_path):
    root = f"file://{tmp_path}/e"
    e = Engine(spark, root)
    first = e.remember("Search runs through Solr on port 8983", author="ana")
    assert first["status"] == "stored"
    again = e.remember("Search runs through Solr on port 8983", author="ana", as_of="2026-01-02 00:00:00")
    assert (again["status"], again["id"]) == ("auto_resolved", first["id"])
    changed = e.remember("Search switched to Solr 9 on port 8983", author="ana", as_of="2026-01-03 00:00:00")
    assert changed["status"] == "conflict"
    kept = e.resolve(changed["conflict_id"], "replace")
    assert e.store.get("memories", first["id"])["state"] == "superseded"
    q = spark.createDataFrame([("q", "solr port")], "query_id string, query string")
    found = e.recall(q)
    assert [r["id"] for r in found.collect()] == [kept]
    e.commit_access(found)
    assert e.store.get("memories", kept)["access_count"] == 1
    e.cache_put("solr port", "8983", [kept])
    assert e.cache_get(q).head()["tier"] == "hit"
    e.dispute(kept, "bo")
    assert e.store.table("cache").count() == 0
    e.forget(kept)
    assert e.recall(q).count() == 0
    with pytest.raises(NotFound):
        e.forget("nothing")
    e.export(f"{root}/out")
    assert Engine(spark, root, "other").import_(f"{root}/out") == 2
    assert e.stats().head()["total"] == 2


def test_capture_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [{"event": "session_start", "session_id": "s", "ide": "x", "ts": "2026-01-01T00:00:00Z"}, {"event": "tool_use", "session_id": "s", "tool": "t", "result": "r", "ts": "2026-01-01T00:00:01Z"}, {"event": "other", "session_id": "s"}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, events)) + "\nnot json\n")
    store = Store(spark, f"file://{tmp_path}/s")
    for run in ("one", "two"):
        H.capture(store, H.source(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/{run}").awaitTermination()
    assert store.table("sessions").count() == 1
    assert [r["content"] for r in store.session_observations("s").collect()] == ["t: r"]


def test_vector_files(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(files.pack_vectors([("a", [1.0, 2.0]), ("é", [0.5, 0.25])], 2))
    assert {r["id"]: list(r["embedding"]) for r in files.read_vectors(spark, f"file://{tmp_path}/v.bin").collect()} == {"a": [1.0, 2.0], "é": [0.5, 0.25]}


def test_settings():
    s = files.settings('[recall]\nlimit = 9\n', recall__max_tokens=50)
    assert (s["recall"]["limit"], s["recall"]["max_tokens"], s["cache"]["max_entries"]) == (9, 50, 500)
    assert parse_scope("x") == "personal"
    assert parse_action("discard") == "discard_new"
    assert B.effective(None, 0, 200) == 200
    assert B.detail_level("odd") == "summary"
