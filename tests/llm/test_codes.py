"""Vector codes against a plain version, and their cases."""

import hashlib
import math

import numpy as np
import pytest

from cairn.llm import codes
from cairn.llm._spark import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int"


def brute(rows):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1])
    at = [p * width // 8 for p in range(9)]
    part = lambda v, p: v[at[p] : at[p + 1]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    nearest = lambda v, p: min((far(part(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            owned = [[] for _ in books[p]]
            for _, v, _ in kept:
                owned[nearest(v, p)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else b for o, b in zip(owned, books[p], strict=True)]
    out, totals = [], {}
    for i, v, lab in kept:
        best = [nearest(v, p) for p in range(8)]
        error = sum(d for d, _ in best)
        totals[lab] = totals.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in best), error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((i, c, e, totals[lab], sha)) for i, c, e, lab in out)


def check(spark, rows):
    df = prepare(spark).createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(3)
    assert sorted(repr(tuple(r)) for r in codes.apply(df).collect()) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])


def test_embeddings(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in prepare(spark).read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("width", [3, 8, 12])
def test_odd_rows(spark, width):
    """Nulls, other widths, ties, repeated ids and rows, null ids and labels, negative components, widths that 8 does not divide."""
    rng = np.random.default_rng(width)
    near = [[float(x) for x in c + rng.integers(-2, 3, width) / 4096] for c in rng.normal(size=(5, width)).round(3) for _ in range(12)]
    rows = [(i // 2 + 3, v, i % 3 or None) for i, v in enumerate(near)] + [(9, near[0], 1), (9, near[0], 1), (None, near[1], None), (1, None, 1), (2, [0.5] * (width - 1) + [None], 1), (2, [math.inf] * width, 2), (2, [math.nan] * width, 2), (70, [1.0] * (width + 1), 1), (71, [], None)]
    check(spark, rows)


def test_few_and_no_rows(spark):
    check(spark, [(5, [0.25] * 8, None), (4, [-0.25] * 8, 1)])
    empty = prepare(spark).createDataFrame([], SCHEMA)
    assert codes.apply(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and codes.apply(empty).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        codes.apply(spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")).collect()


def test_bounds_are_below_and_leave_entries_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-50, 50, (2000, 8))
    entry, far, measured = codes.nearest(x, centres)
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (far == every.min(1)).all()
    assert measured < 0.2 * every.size
    mine, theirs = codes.Bounds(x), codes.Bounds(centres)
    last = 0
    for a, b in zip(mine.levels, theirs.levels, strict=True):
        low = ((a[:, None] - b[None]) ** 2).sum(2)
        assert (low <= every * (1 + 1e-9) + 1e-3).all() and low.sum() >= last
        last = low.sum()


def test_decode():
    books = [np.arange(6).reshape(3, 2), np.arange(3).reshape(3, 1)]
    assert codes.decode("0102", books).tolist() == [2, 3, 2]
