"""The suffix tree's scores against a plain version, and its cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cairn.llm import pst
from cairn.llm._spark import prepare


def train(rows, depth):
    """Counts of runs by length, kept states with the number of their followers, N and V."""
    lists = [(zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [""]) for i, t in rows]
    c = Counter(tuple(w[i : i + k]) for held, w in lists if not held for k in range(1, depth + 2) for i in range(len(w) - k + 1))
    n = sum(x for r, x in c.items() if len(r) == 1)
    v = sum(len(r) == 1 for r in c)
    after = defaultdict(dict)
    for r, x in c.items():
        if len(r) > 1:
            after[r[:-1]][r[-1]] = x
    states = {}
    for s, nexts in after.items():
        if len(s) <= depth and c[s] >= pst.MIN_COUNT:
            share = lambda w, s=s: c[(w,)] / n if len(s) == 1 else c[(*s[1:], w)] / c[s[1:]]
            gain = sum(round(x * math.log(pst.HALF * (x - 1) / ((c[s] - 1) * share(w)) + 1 - pst.HALF) * pst.GRAIN) for w, x in nexts.items())
            if gain >= pst.MIN_GAIN * pst.GRAIN:
                states[s] = len(nexts)
    return lists, c, n, v, states


def share(history, w, c, n, v, states, depth):
    p = (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
    for d in range(1, depth + 1):
        s = tuple(history[-d:])
        if len(history) >= d and s in states:
            p = (c[(*s, w)] + states[s] * p) / (c[s] + states[s])
    return p


def brute(rows, depth=pst.DEPTH):
    lists, c, n, v, states = train(rows, depth)
    out = []
    for (i, _), (held, w) in zip(rows, lists, strict=True):
        base = sum(math.log10((c[(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(share(w[:k], x, c, n, v, states, depth)) for k, x in enumerate(w))
        out.append((i, held, len(w), sum(c[(x,)] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(map(repr, out))


def got(df, **more):
    return sorted(repr((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6))) for r in pst.apply(df, **more).collect())


@pytest.fixture
def small(monkeypatch):
    """Chunks of a few rows, so that runs meet between chunks."""
    monkeypatch.setattr(pst.C, "CHUNK_ROWS", 7)
    monkeypatch.setattr(pst, "JOIN", 2)


def test_documents(spark, sf, small):
    docs = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs) == brute(rows)
    own = pst.apply(docs).groupBy("held_out").sum("score", "base_score").collect()
    assert all(r["sum(score)"] > r["sum(base_score)"] for r in own)


@pytest.mark.parametrize("depth", [1, 3])
def test_odd_texts(spark, small, depth):
    """Null, empty and long texts, null and repeated ids, repeated rows, one word over and over, clashing columns."""
    texts = [None, "", " \n", "The CAT sat on the mat\tthe cat SAT", "é É x", "z " * 3000, "z z z q", "a\x00b \x1c c", "the cat sat down"]
    rows = [(None if i % 13 == 6 else i // 2, t) for i, t in enumerate(texts * 9)]
    df = prepare(spark).createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, chunk string").repartition(3)
    assert got(df, depth=depth) == brute(rows, depth)
    assert pst.apply(df.filter("false")).count() == 0
    held = df.filter("doc_id IS NULL")
    assert got(held) == brute([r for r in rows if r[0] is None])


def test_probabilities_sum_to_one(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in prepare(spark).read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    lists, c, n, v, states = train(rows, 2)
    assert any(len(s) == 2 for s in states)
    for s in [*list(states)[:20], ("no", "such")]:
        total = sum(share(s, w[0], c, n, v, states, 2) for w in c if len(w) == 1) + share(s, "\x00unknown", c, n, v, states, 2)
        assert total == pytest.approx(1)


def test_text_like_the_corpus_scores_better_than_its_shuffle(spark, sf):
    docs = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    long_ = next(r for r in docs.collect() if len((r["text"] or "").split()) > 200)
    other = " ".join(sorted(long_["text"].split()))
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(1_000_003, long_["text"]), (1_000_003, other)], "doc_id long, text string"))
    same = pst.apply(both).filter("doc_id = 1000003").collect()
    assert len({round(r["base_score"], 6) for r in same}) == 1 and same[0]["score"] != same[1]["score"]
