"""Nearest vectors among themselves: two chunks meet once for both, over several rounds, and the rows are those of all against all."""

import numpy as np

from cairn.operators import search as S


def _vectors():
    dice = np.random.default_rng(11)
    x = dice.normal(size=(260, 8)).round(1)
    x[40:75] = x[40]  # more alike than a chunk holds
    x[120:140] = 2 * x[120]
    rows = [(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)]
    return rows + [(f"w{i:02d}", dice.normal(size=3).round(1).tolist()) for i in range(30)] + [("none", None), ("empty", []), ("zero", [0.0] * 8)]


def test_vectors_among_themselves_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 10)
    monkeypatch.setattr(S, "ROUND", 3)
    rows = _vectors()
    chunks = S.settle(S.packed(spark.createDataFrame(rows, "id string, embedding array<double>").repartition(6), 4))
    assert chunks.count() > 3 * 3 * 3  # four rounds
    got = {}
    for r in S.nearest_among(chunks, 4, 0.3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["sim"]))
    ids = [i for i, _ in rows[:290]]
    for i, v in rows[:290]:
        sims = [(j, round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9)) for j, w in rows[:290] if len(v) == len(w)]
        best = sorted(((j, s) for j, s in sims if s >= 0.3), key=lambda p: (-p[1], p[0]))[:4]
        assert [(n, j, round(s, 9)) for n, j, s in got[i]] == [(n, j, s) for n, (j, s) in enumerate(best, 1)]
    assert set(got) == set(ids)
    assert S.nearest_among(chunks.limit(0), 4, 0.3).count() == 0


def test_ingest_makes_one_product_of_two_chunks(spark, monkeypatch):
    """The pairs of chunks that reach the tasks are half of all, and none is of a chunk with itself."""
    monkeypatch.setattr(S, "CHUNK", 10)
    chunks = S.settle(S.packed(spark.createDataFrame(_vectors(), "id string, embedding array<double>").repartition(4), 4))
    seen = spark.sparkContext.accumulator(0)
    plain = S._both

    def counted(*args):
        seen.add(1)
        return plain(*args)

    monkeypatch.setattr(S, "_both", counted)
    S.nearest_among(chunks, 4, 0.3).count()
    wide = [r["width"] for r in chunks.select("width").collect()]
    assert seen.value == sum(wide.count(w) * (wide.count(w) - 1) // 2 for w in set(wide))


def test_both_ways_of_a_product():
    dice = np.random.default_rng(2)
    x, y = (dice.normal(size=(n, 6)).astype(np.float32).round(1) for n in (700, 90))
    y[:30] = x[3]
    a, b = (S._units(v.tobytes(), v, 6) for v in (x, y))
    bars = [np.full((n, 3), 0.2) for n in (700, 90)]
    known = [np.ones(n, bool) for n in (700, 90)]
    both = S._both((a, known[0]), (b, known[1]), *bars, 3)
    for one, (q, v) in zip(both, ((a, b), (b, a)), strict=True):
        best = np.full((len(q[0]), 3), 0.2)
        plain = S._above(q, v, best, 3)
        pairs = lambda t, best: {(r, round(s, 9)) for r, s in zip(t[0].tolist(), t[2].tolist(), strict=True) if s >= best[r, 0]}
        assert pairs(one, best) == pairs(plain, best)
        taken = bars[0] if len(q[0]) == 700 else bars[1]
        assert np.allclose(taken, best)
