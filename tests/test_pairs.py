"""Documents and those before them of their source: pairs are those of SQL over runs of ids, and no task orders a source's texts."""

import random

import duckdb
import pytest
from compare import rows as told
from pyspark.sql import functions as F

from cairn.operators import conflict as K
from cairn.plans import queries as Q

SAID = ["Retries enabled on the edge", "Retries disabled on the edge", "the portal uses redis", "the portal uses mysql", "We now use kafka", "", None, "a b c d e f g h i j k l"]


def _documents(spark, folder, sources):
    dice = random.Random(3)
    ids = [*range(40), *range(9_000, 9_040), *range(20_000, 20_003), 50_000]
    rows = [(i, dice.choice(SAID), dice.choice(["en", "de", None]), dice.choice(sources), 1) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


@pytest.mark.parametrize("run", [1, 7, 1 << 12])
def test_pairs_over_runs(spark, tmp_path, monkeypatch, run):
    monkeypatch.setattr(Q, "_RUN", run)
    rows = _documents(spark, tmp_path, ["s0", "s0", "s1", None])
    last, want = {}, {}
    for i, _, _, source, _ in rows:
        if source in last:
            want[i] = last[source]
        last[source] = i
    assert {r["doc_id"]: r["old_id"] for r in Q._before(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", ["supersede", "negation", "competing_claim", "conflict_route"])
def test_conflict_queries_equal_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(Q, "_RUN", 7)
    _documents(spark, tmp_path, ["s0", "s0", "s1", None])
    df = Q.QUERIES[name](spark, str(tmp_path))
    sql = duckdb.connect()
    sql.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cursor = sql.execute(Q.ORACLE[name])
    theirs = told([c[0] for c in cursor.description], cursor.fetchall())
    assert told(df.columns, [tuple(r) for r in df.collect()]) == theirs


def test_claims_near_are_claims_of_the_whole(spark, monkeypatch):
    dice = random.Random(5)
    parts = ["the portal", "uses", "is", "are", "a", "b", "redis", "w" * 30, "é", "ö x", "\u3000", "  ", "\n", ".", "hosted on", "using"]
    texts = ["", "is", " is ", "x is y", "portal is", "is redis", *("".join(dice.choice(parts) + dice.choice(["", " ", "   " * 9]) for _ in range(dice.randrange(12))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    whole = {r["i"]: r["c"] for r in rows.select("i", K.claims("t").alias("c")).collect()}
    assert any(whole.values())
    for near in (0, 1, 3, 16):
        monkeypatch.setattr(K, "NEAR", near)
        assert {r["i"]: r["c"] for r in rows.select("i", K.claims("t").alias("c")).collect()} == whole


def test_no_window_holds_texts(spark, tmp_path):
    _documents(spark, tmp_path, ["s0"])
    for name in ("supersede", "negation", "competing_claim"):
        plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and not any("content" in line or "text" in line or " nt" in line for line in windows)
        assert all("run" in line.split("windowspecdefinition", 1)[1] for line in windows)
    assert Q._before(spark, str(tmp_path)).filter(F.col("old_id") >= F.col("doc_id")).count() == 0
