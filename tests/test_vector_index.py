"""The kept vector index against the full scan, its changes, and the cells that it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import search as S
from cairn.operators import vector_index as I
from cairn.operators.store import Store

SCHEMA = "id string, embedding array<float>"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 8)
    monkeypatch.setattr(I, "DEAL", 2)
    monkeypatch.setattr(I, "QUERIES", 3)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["sim"], 9)) for r in df.collect())


def clustered(n, seed=0, width=6, clusters=8, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return [[float(np.float32(x)) for x in centres[i % clusters] + spread * rng.normal(size=width)] for i in range(n)]


def test_the_index_follows_changes(spark, tmp_path, small):
    now = {f"v{i:03d}": v for i, v in enumerate(clustered(150))} | {"null": None, "none": [], "zero": [0.0] * 6, "other": [1.0, 2.0], "same1": [1.0] * 6, "same2": [1.0] * 6}
    asked = [(i, v) for i, v in enumerate([*clustered(4, 1), [1.0] * 6, [0.0] * 6, None, [3.0], [-x for x in clustered(1)[0]]])]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    index = I.VectorIndex(spark, f"file://{tmp_path}/i")
    assert index.search(queries, 3).count() == 0

    def same():
        wide = [q for q, v in asked if v is not None and len(v) == 6]
        for k in (1, 4, 500):
            mine, theirs = (rows(df.filter(F.col("query_id").isin(wide))) for df in (index.search(queries, k), S.nearest(queries, spark.createDataFrame(list(now.items()), SCHEMA), k)))
            assert mine == theirs
        # a query of another width is similar to all by 0
        assert {r[3] for r in rows(index.search(queries, 3)) if r[0] not in wide} == {0.0}

    index.upsert(spark.createDataFrame(list(now.items()), SCHEMA).repartition(3))
    assert index.state["rows"] == len(now)
    same()
    change = {"v001": now["v002"], "null": [2.0] * 6, "new": [5.0] + [0.0] * 5}
    now |= change
    index.upsert(spark.createDataFrame(list(change.items()), SCHEMA))
    assert index.delete(spark.createDataFrame([("v005",), ("nobody",)], "id string")) == 1
    del now["v005"]
    same()
    assert index.state["rows"] == len(now) and not index.due()
    written = [p for p in (tmp_path / "i" / "cells").glob(f"of={index.state['segments'][-1]}/cell=*")]
    assert len(written) <= len(change)  # an update writes the cells that it touches
    index.rebuild()
    assert (index.state["rows"], len(index.state["segments"]), index.state["dead"]) == (len(now), 1, [])
    same()
    again = I.VectorIndex(spark, f"file://{tmp_path}/i")
    assert rows(again.search(queries, 4)) == rows(index.search(queries, 4))


def test_cells_are_left_out_of_clustered_vectors(spark, tmp_path):
    vectors = spark.createDataFrame([(f"v{i:05d}", v) for i, v in enumerate(clustered(3000, width=16, clusters=30, spread=0.05))], SCHEMA)
    queries = vectors.filter("id like '%00'").select(F.col("id").alias("query_id"), "embedding")
    index = I.VectorIndex(spark, f"file://{tmp_path}/i")
    index.upsert(vectors)
    assert rows(index.search(queries, 5)) == rows(S.nearest(queries, vectors, 5))
    told = index.report(queries, 5)
    assert told["read"] < 0.25 * told["all"]


def test_embeddings_table(spark, sf, tmp_path):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.format_string("%08d", "vec_id").alias("id"), "embedding")
    queries = vectors.filter("cast(id AS bigint) % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = I.VectorIndex(spark, f"file://{tmp_path}/i")
    index.upsert(vectors)
    assert rows(index.search(queries, 5)) == rows(S.nearest(queries, vectors, 5))


def test_the_index_follows_a_store(spark, tmp_path, small):
    store, index = Store(spark, f"file://{tmp_path}/s"), I.VectorIndex(spark, f"file://{tmp_path}/i")
    rows_ = spark.createDataFrame([(f"m{i}", v, True) for i, v in enumerate(clustered(40))], f"{SCHEMA}, in_index boolean")
    store.upsert("memories", rows_)
    assert index.sync(store, member="in_index") == 40
    store.update("memories", ["m3"], in_index=F.lit(False))
    store.set_embedding("m4", [1.0] * 6)
    assert index.sync(store, member="in_index") == 2
    queries = spark.createDataFrame([(1, [1.0] * 6)], "query_id int, embedding array<float>")
    assert rows(index.search(queries, 6)) == rows(S.nearest(queries, store.index(), 6))
    assert {r["id"] for r in index.ids().collect()} == {r["id"] for r in store.index().select("id").collect()}


def test_a_crowded_cell_is_dealt_out(spark, tmp_path, small):
    """One cell with all rows: its blocks go to several tasks, and nothing is lost."""
    vectors = spark.createDataFrame([(f"v{i:04d}", [1.0, 0.001 * (i % 7)]) for i in range(400)], SCHEMA)
    index = I.VectorIndex(spark, f"file://{tmp_path}/i")
    index.upsert(vectors)
    queries = spark.createDataFrame([(i, [1.0, 0.002 * i]) for i in range(10)], "query_id int, embedding array<float>")
    assert rows(index.search(queries, 20)) == rows(S.nearest(queries, vectors, 20))
    asked = index._asked(queries.select(F.col("query_id").alias("q"), "embedding", F.lit(None).cast("double").alias("bar")), index.state, True, 20)
    assert asked.select("deal").distinct().count() > 1


def test_bounds():
    x = np.array(clustered(200, width=8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = I.fit(x, 10)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)
    assert len(I.fit(np.ones((5, 2)) / np.sqrt(2), 4)) == 1


def test_blocks_are_filled_and_only_what_may_be_best_is_given(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"{i:04d}", [float(x) for x in rng.normal(size=4)]) for i in range(400)], "id string, embedding array<float>").repartition(40)
    index = I.VectorIndex(spark, f"file://{tmp_path}/v")
    index.upsert(rows)
    state = index.state
    assert max(blocks for blocks, _ in state["cells"].values()) <= I.SALT  # not one for each task
    asked = rows.filter("id < '0020'").select(F.col("id").alias("q"), "embedding", F.lit(2.0).alias("bar"))
    assert index._scored(index._asked(asked, state, True, 3), state, 3).count() == 0
