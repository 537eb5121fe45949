"""Nearest vectors in tiles of a group: the same rows, bounded arrays."""

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import search as S


def test_tiles_give_the_rows_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 5)
    monkeypatch.setattr(S, "ROWS", 3)
    vectors = [(i, [float(x) for x in np.random.default_rng(i % 23).integers(-2, 3, 4 if i % 7 else 3)] if i % 11 else None) for i in range(90)]
    df = spark.createDataFrame(vectors, "id int, embedding array<float>")

    def sim(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12) + 0.0

    for k in (1, 6, 200):
        found = S.nearest(df.select(F.col("id").alias("query_id"), "embedding").filter("id % 3 = 0"), df, k)
        got = {(r["query_id"], r["rank"]): (r["id"], round(r["sim"], 9)) for r in found.collect()}
        should = {}
        for q, x in vectors[::3]:
            order = sorted((-sim(x, y), i) for i, y in vectors)[:k]
            should |= {(q, n + 1): (i, round(-s, 9)) for n, (s, i) in enumerate(order)}
        assert {p: v[1] for p, v in got.items()} == {p: v[1] for p, v in should.items()}
        assert sum(got[p][0] != should[p][0] for p in got) == 0
