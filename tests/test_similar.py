"""Words whose numbers clash are numbered anew."""

from cairn.operators import similar


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_clashing_words_are_told_apart(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = rows(similar.similar_documents(docs))
    monkeypatch.setattr(similar, "NUMBER_BITS", 26)  # some 20,000 words among 2^26 numbers: several clashes
    moved, _ = similar._frequencies(docs, "text")
    words = {w for (t,) in docs.select("text").collect() for w in (t or "").split()}
    assert sum(map(len, moved)) >= 1 and {w for m in moved for w in m} <= words
    assert rows(similar.similar_documents(docs)) == whole
