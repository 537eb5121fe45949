"""Ingest against all others: its neighbours, sets of words and verdicts are those of the plain ways, and texts are not kept or sent for pairs."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import conflict as K
from cairn.operators import search as S
from cairn.plans import recall as R
from cairn.plans.queries import QUERIES
from cairn.sources import files

TOPICS = ["Lifts are inspected yearly", "Tea is served at four", "The portal uses redis", "The portal uses mysql", "Retries enabled on the portal", "Retries disabled on the portal", "We now use kafka"]


def _texts(n, words):
    dice = random.Random(7)
    said = []
    for i in range(n):
        old = said[dice.randrange(i)] if i and dice.random() < 0.4 else None
        tail = " ".join(f"word{dice.randrange(400)}" for _ in range(words))
        said.append(f"{TOPICS[i % len(TOPICS)]} {tail}" if old is None else dice.choice([old, old + " really", old.replace("word1", "Word1", 2), old + " and database configuration now"]))
    return said


def _write(spark, folder, texts):
    rows = [(i, t, "en", f"a{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_ingest_keeps_less_than_the_texts(spark, tmp_path):
    texts = _texts(150, 900)
    _write(spark, tmp_path, texts)
    S.settle(spark.range(1))  # names the folder
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = _bytes(folder)
    assert QUERIES["ingest_outcomes"](spark, str(tmp_path)).count() == len(texts)
    assert _bytes(folder) - before < 0.7 * sum(map(len, texts))


def test_outcomes_are_those_of_whole_pairs(spark, tmp_path):
    _write(spark, tmp_path, [*_texts(120, 30), None, "", "the a an", "The A", "Retries enabled on the edge gateway", "Retries disabled on the edge gateway"])
    whole = files.document_memories(spark, str(tmp_path), with_embedding=True).localCheckpoint()
    vectors = {r["id"]: np.array(r["embedding"], float) for r in whole.select("id", "embedding").collect()}
    ids = sorted(vectors)
    x = np.stack([vectors[i] / (np.linalg.norm(vectors[i]) or 1) for i in ids])
    sim = np.round(x @ x.T, 9)
    pairs = []
    for i, own in enumerate(ids):
        near = sorted((j for j in range(len(ids)) if j != i and sim[i, j] >= 0.45), key=lambda j: (-sim[i, j], ids[j]))[:5]
        pairs += [(own, ids[j], k + 1) for k, j in enumerate(near)]
    side = lambda name: whole.select(F.col("id").alias(f"{name}_id"), F.struct("id", "author", "content", "compressed", "created_at").alias(name))
    found = spark.createDataFrame(pairs, "new_id string, old_id string, rank int").join(side("new"), "new_id").join(side("old"), "old_id")
    plain = {r["new_id"]: (r["relation"], r["existing_id"], r["resolution"]) for r in K.analyze(found).withColumn("resolution", K.auto_resolution()).collect()}
    got = {r["id"][1:]: (r["relation"], r["existing_id"], r["resolution"]) for r in QUERIES["ingest_outcomes"](spark, str(tmp_path)).collect()}
    assert set(got) == set(ids) and {v[0] for v in plain.values()} == {"duplicate", "supersede", "contradicts"}
    assert {k: v for k, v in got.items() if v[0]} == plain
    batch = R.ingest_batch(whole.filter("id < '3'").withColumn("id", F.concat(F.lit("x"), "id")), whole).collect()
    assert len(batch) == sum(i < "3" for i in ids) and all(len(r["candidate_ids"] or []) <= 5 for r in batch)


def test_nearest_above_is_brute_force(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(300, 8)).round(1)
    x[50:120] = x[50]  # many alike: the smaller ids come first
    rows = [(f"v{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("empty", []), ("zero", [0.0] * 8), ("other", [1.0, 2.0])]
    for kind in ("float", "double"):
        chunks = S.settle(S.packed(spark.createDataFrame(rows, f"id string, embedding array<{kind}>").repartition(5), 4))
        got = {}
        for r in S.nearest_above(chunks, chunks, 4, 0.3).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        y = x.astype(np.float32).astype(float) if kind == "float" else x
        y = y / np.linalg.norm(y, axis=1, keepdims=True)
        sim = np.round(y @ y.T, 9)
        for i in range(300):
            best = sorted((j for j in range(300) if sim[i, j] >= 0.3), key=lambda j: (-sim[i, j], f"v{j}"))[:4]
            assert got[f"v{i}"] == [f"v{j}" for j in best]
        assert got["other"] == ["other"] and not {"none", "empty", "zero"} & set(got)
        assert S.nearest_above(chunks, chunks.limit(0), 4, 0.3).count() == 0


def test_words_of_compressed_texts(spark):
    odd = ["", None, "the", "The. (a) an, YANG!", "./the a/the the/x the.py the.rs, the.toml", "within order to/x the", "`the code` and `a b` well", "K\u212aonfigurasi \u212aonfigurasi", "mengimplementas\u0130kan m\u0131ddleware MIDDLEWARE..", "a\u0000the the\u0000"]
    odd += ["x\u00a0the\u2003a\x1cthe\x85an", "https://a.b/the C:\\the", "pada dasarnya pada \u017faat ini", "the1 _the_ the-the \u00e9the the\u0301", "database DB configuration, konfigurasi. config", "```the\n a``` the", "at th\u0131s point in time the", "duE To The Fact That the"]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("t", F.array_sort(X.compressed_words("t")).alias("a"), F.array_sort(F.array_distinct(X.words(X.compress("t")))).alias("b"))
    assert [r["t"] for r in df.collect() if r["a"] != r["b"]] == []
