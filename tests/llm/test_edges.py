"""One-row tables without words, clashing column names, repeated rows, empty tables: every operator and stage."""

import hashlib

import corpus_pipeline
import public_tokenizers as P
import pytest

from cairn.llm import bpe, html, neardup, packing, quality, secrets, substring, suffix, topk, toxicity
from cairn.llm._spark import prepare

NOTHING = hashlib.sha256(b"").hexdigest()
#: Names that operators use inside, or add.
CLASHING = ["_id", "_rules", "_gone", "row", "doc", "found", "whole", "body", "chunk", "bucket", "answers", "key", "rep", "comp", "kept", "n_words", "class_id", "secret_spans", "token_ids", "start", "length", "piece", "sequence_id", "f1", "bands"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, schema="doc_id long, text string"):
    return prepare(spark).createDataFrame([(i + 1, t) for i, t in enumerate(texts)], schema)


@pytest.mark.parametrize("text", [None, "", " \n "])
def test_rows_without_words(spark, text):
    df = _docs(spark, [text])
    empty = text or ""
    ids = "" if not empty else None
    got = bpe.digest(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).head()
    assert got["decoded_sha256"] == hashlib.sha256(empty.encode()).hexdigest()
    assert ids is None or (got["n_tokens"], got["ids_sha256"]) == (0, NOTHING)
    assert tuple(substring.digest(df).head()) == (1, 0, 0, NOTHING)
    assert tuple(suffix.digest(df).head()) == (1, len(empty), 0, 0, hashlib.sha256(empty.encode()).hexdigest())
    (piece,) = packing.apply(df, P.path("word_bpe_49k.json")).collect()
    assert (piece["piece"], piece["start"], piece["length"], piece["offset"]) == (0, 0, 1, 0)
    assert tuple(secrets.digest(df).head()) == (1, 0, 0, 0, NOTHING, "")
    assert tuple(neardup.classes(df).head()) == (1, 1)
    assert [tuple(r) for r in html.extract(df.selectExpr("doc_id AS page_id", "'http://h/' AS url", "text AS html")).collect()] == [(1, "http://h/", "", 0)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.apply(df, labels).head()["severity"] == 0
    got = quality.apply(df, clean=True).head()
    assert [got[f.name] for f in quality.FIELDS] == [0, 0, 0, 0, 0, True, 0, False]
    assert topk.search(df.selectExpr("doc_id AS vec_id", "cast(array() AS array<float>) AS embedding")).count() == 0


@pytest.mark.parametrize("texts", [[None], [""], [" "], [None, "", " "], []])
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_without_words(spark, sf, name, texts):
    docs = _docs(spark, texts).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(0 AS long) AS n_chars")
    rows = dict(corpus_pipeline.STAGES)[name](spark, docs, sf).collect()
    if name == "quality_rules":
        assert rows == []
    elif name == "pack_sequences":
        assert [(r["doc_id"], r["length"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(i + 1, 1) for i in range(len(texts))]
    else:
        assert sorted((r["doc_id"], r["text"]) for r in rows) == [(i + 1, t) for i, t in enumerate(texts)] or name == "near_duplicates" and len(rows) == len(texts)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns(spark, sf, name):
    words = " ".join(f"word{i}" for i in range(80)) + "."
    texts = [words, words, f"token = abcdefghijklmnop {words[::-1]}.", None, words]
    rows = [(i // 2 + 1, t, *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert got.columns == docs.columns
    kept = {r["_id"]: r for r in got.collect()}
    assert all(r[c] == c + r["_id"][3:] for r in kept.values() for c in CLASHING)
    assert "_id0" in kept


def test_pipeline_runs(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame(docs.collect(), docs.schema), sf)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
