"""Lines, reports and JSON of whole tables; databases in a folder of their own; settings."""

import json

from pyspark.sql import functions as F

from cairn.operators import grounding as G
from cairn.plans import render
from cairn.plans.engine import Engine
from cairn.sources import files


def one(df, column="line"):
    return [r[column] for r in df.collect()]


def test_lines_of_an_engine(spark, tmp_path):
    e = Engine.temporary(spark)
    a = e.remember("Redis keeps the sessions of the gateway", author="ana", room="ops", tags=("cache",))["id"]
    b = e.remember("Tea is served at four in the hall", author="bo")["id"]
    c = e.remember("Retries enabled for the webhooks", author="ana")["id"]
    conflict = e.remember("Retries disabled for the webhooks", author="bo")
    e._link(a, b, "complements", "2026-01-01 00:00:00", "ana")
    memories = e.store.table("memories")
    row = memories.filter(F.col("id") == a).head()
    assert one(render.list_lines(memories.filter(F.col("id") == a))) == [f"{a} [{row['memory_type']}] {row['headline']} @ana"]
    (text,) = one(render.records(memories.filter(F.col("id") == a), e.store.table("edges")), "text")
    assert text.startswith(f"id:         {a}\ntype:       ") and "room:       ops" in text and text.endswith(f"relations:\n  {a} --complements--> {b}")
    (other,) = one(render.records(memories.filter(F.col("id") == c), e.store.table("edges")), "text")
    assert "relations" not in other and "\ncontent:\nRetries enabled" in other
    (line,) = one(render.conflict_lines(e.store.conflicts("pending")))
    assert line.startswith(f"{conflict['conflict_id']} [contradicts] 75% — ")
    assert one(render.timeline_lines(e.store.table("timeline").filter(F.col("memory_id") == a))) == ["2026-01-01 00:00 · created by ana"]
    (stats,) = one(render.stats_text(e.stats(), "m", 256), "text")
    assert "  total memories:    3\n" in stats and "  pending conflicts: 1\n" in stats and stats.endswith("m (256d)")
    config = {(r["section"], r["name"]): json.loads(r["value"]) for r in e.configuration().collect()}
    assert config["recall", "limit"] == files.DEFAULTS["recall"]["limit"] and config["store", "embedding_dim"] == "256"
    saved = e.save(f"file://{tmp_path}/kept")
    assert sorted(map(repr, saved.store.table("memories").collect())) == sorted(map(repr, memories.collect()))
    assert saved.store.conflicts("pending").count() == 1 and saved.store.meta_get("embedding_dim") == "256"


def test_reports(spark):
    answers = spark.createDataFrame([("x", "Redis stores sessions. Moon cheese is blue."), ("y", "")], "answer_id string, answer string")
    evidence = spark.createDataFrame([(0, "m", "redis stores all sessions")], "rank int, id string, content string")  # for all answers
    checks = G.check_claims(answers, evidence)
    report = G.report(answers, checks)
    texts = {r["answer_id"]: r["text"] for r in render.validation_text(report, checks).collect()}
    assert texts["x"] == "Grounding: 50%  (UNSUPPORTED CLAIMS FOUND)\n  [ok ] 100%  Redis stores sessions.\n  [!! ] 0%  Moon cheese is blue.\n\nUnsupported claims (revise or verify against the knowledge base):\n  - Moon cheese is blue."
    assert texts["y"] == "Grounding: 0%  (UNSUPPORTED CLAIMS FOUND)"
    told = {r["answer_id"]: json.loads(r["json"]) for r in render.validation_json(report, checks).collect()}
    assert told["x"]["unsupported_claims"] == ["Moon cheese is blue."] and [c["supported"] for c in told["x"]["claims"]] == [True, False] and told["y"]["claims"] == []


def test_lookups_and_outcomes(spark):
    found = spark.createDataFrame([(1, "hit", "A", ["c"], 0.925), (2, "grounding", "B", ["m", "n"], 0.5), (3, "miss", None, [], None), (4, "answer", "D", ["m"], 0.8)], "query_id int, tier string, answer string, ids array<string>, sim double")
    texts = {r["query_id"]: r["text"] for r in render.lookup_text(found).collect()}
    assert texts == {1: "HIT [cache] (92% match)\nsource memories: c\n\nA", 2: "GROUNDING (50% match) — 2 memory(ies):\n  [m]\n  [n]", 3: "MISS", 4: "HIT [memory] (80% match)\nsource memories: m\n\nD"}
    assert {r["query_id"]: json.loads(r["json"])["status"] for r in render.lookup_json(found).collect()} == {1: "hit", 2: "grounding", 3: "miss", 4: "hit"}
    outcomes = spark.createDataFrame(
        [("a", "stored", None, None, None, None, None, None), ("b", "auto_resolved", "discard_new", "duplicate", 0.95, "w", "o", ["o"]), ("c", "conflict", None, "contradicts", 0.75, "w", "o", ["o", "p"])],
        "id string, outcome string, resolution string, relation string, confidence double, reasoning string, existing_id string, candidate_ids array<string>",
    )
    told = {r["id"]: json.loads(r["json"]) for r in render.outcome_json(outcomes).collect()}
    assert told["a"] == {"status": "stored", "id": "a"} and told["b"]["id"] == "o" and told["c"]["existing"] == ["o", "p"]
