"""Recall against a plain version, on tables and on kept indexes; derived rows by content."""

import brute_recall
import pytest
from pyspark.sql import functions as F

import cairn.plans.store_queries  # noqa: F401
from cairn.functions import text as X
from cairn.operators.derived import Derived
from cairn.plans import recall as R
from cairn.plans.engine import Engine
from cairn.plans.queries import QUERIES
from cairn.sources import files


@pytest.fixture(scope="module")
def memories(spark, sf):
    rows = files.document_memories(spark, sf, with_embedding=True).withColumn("_date", X.short_date("created_at"))
    return brute_recall.Memories([r.asDict() for r in rows.collect()])


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9), r["line"], r["cost"], r["used"]))
    return out


@pytest.mark.parametrize("name, how", [("recall_static", brute_recall.static), ("recall_indexed", brute_recall.static), ("recall_dynamic", brute_recall.dynamic)])
def test_recall_of_documents(spark, sf, memories, name, how):
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    mine = got(QUERIES[name](spark, sf))
    assert mine == {r["item_id"]: found for r in asked if (found := how(memories, r["text"]))}


def test_texts_are_derived_once(spark, tmp_path):
    derived = Derived(spark, f"file://{tmp_path}/d")
    rows = spark.createDataFrame([("a", "Redis stores sessions. We use Kafka."), ("b", "Redis stores sessions. We use Kafka."), ("c", None), ("d", "")], "id string, content string").withColumns({"author": F.lit("me"), "room": F.lit("r"), "created_at": F.lit("2026-01-01").cast("timestamp")})
    assert (derived.fill(rows), derived.fill(rows)) == (2, 0)
    more = rows.withColumn("content", F.when(F.col("id") == "a", "Changed to NATS.").otherwise(F.col("content")))
    assert derived.fill(more) == 1 and Derived(spark, f"file://{tmp_path}/d").state["rows"] == 3
    whole = lambda **o: sorted(map(repr, files.as_memories(more.withColumn("content", F.coalesce("content", F.lit(""))), with_embedding=True, **o).collect()))
    assert whole() == whole(derived=derived)
    searched = lambda **o: sorted(map(repr, files.as_searched(more.withColumn("content", F.coalesce("content", F.lit(""))), **o).collect()))
    assert searched() == searched(derived=derived)
    assert Derived(spark, f"file://{tmp_path}/d", "lite").fill(rows) == 2  # other levels are other rows


def test_an_engine_recalls_by_its_indexes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    for text, author in (("Billing exports run nightly on the third cluster", "ana"), ("Tea is served at four in the hall", "bo"), ("The export of invoices moved to Kafka", "cy")):
        e.remember(text, author=author)
    asked = spark.createDataFrame([(1, "exports of billing"), (2, "tea hall")], "query_id int, query string")
    assert got(e.recall_indexed(asked)) == got(e.recall(asked))
    first = e.store.table("memories").filter("content like 'Tea%'").head()["id"]
    e.forget(first)
    e.remember("Coffee is served at five in the hall", author="bo")
    assert got(e.recall_indexed(asked)) == got(e.recall(asked))
    assert R.candidates(asked, None, indexes=e.indexes()).count() > 0
