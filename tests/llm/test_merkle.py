"""The manifest against a plain tree, and its cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import merkle
from cairn.llm._spark import prepare

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in NAMES))


def tree(leaves):
    """The root, and for each leaf the (left, right) of every level."""
    paths, of, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, i in zip(paths, range(len(leaves)), strict=True):
            run, at = level[of[i] // 16 * 16 : of[i] // 16 * 16 + 16], of[i] % 16
            path.append(("".join(run[:at]), "".join(run[at + 1 :])))
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        of = [x // 16 for x in of]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        ordered = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        built[s] = ordered, *tree([leaf(r) for r in ordered])
    root, above = tree([built[s][1] for s in names])
    out = []
    for s, top in zip(names, above, strict=True):
        ordered, subroot, paths = built[s]
        for r, path in zip(ordered, paths, strict=True):
            changed = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                changed["text"] = "".join(c.lower() if c.isascii() else c for c in r["text"])
            x = leaf(changed)
            for left, right in path + top:
                x = h(left + x + right)
            proof = h("".join(a + b for a, b in path + top))
            out.append((r["doc_id"], leaf(r), subroot, root, proof, x, x == root))
    return sorted(map(repr, out))


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_documents(spark, sf):
    docs = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    assert sorted(repr(tuple(r)) for r in merkle.digest(docs).collect()) == brute(rows_of(docs))


@pytest.mark.parametrize("sources", [["a"], [None], [f"s{i}" for i in range(40)], ["a"] * 300 + ["b", None] * 9 + ["ä", "z"]])
def test_odd_rows(spark, sources):
    """Lone leaves and groups, many groups, last runs of one, null and repeated ids, like rows, long texts, clashing columns."""
    texts = [None, "", "Ab É", "X" * 20000, "same", "same"]
    data = [(None if i % 11 == 5 else i // 2, s, "en" if i % 3 else None, i if i % 4 else None, texts[i % 6], "x", 1) for i, s in enumerate(sources)]
    df = prepare(spark).createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string, root string, idx int").repartition(3)
    got = merkle.digest(df)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows_of(df))
    assert merkle.digest(df.filter("false")).count() == 0
    assert all(r["verified"] for r in merkle.digest(df.withColumn("text", F.lit("low"))).collect())


def test_a_hot_group_is_numbered_over_tasks(spark):
    df = prepare(spark).range(0, 5000, 1, 8).select(F.lit("1hot").alias("g"), F.col("id"), F.lit("x").alias("d"))
    got = merkle.numbered(df, "g", "id")
    assert all(r["idx"] == r["id"] and r["n"] == 5000 for r in got.collect())
    assert got.select(F.floor(F.col("idx") / 1250)).distinct().count() == 4
