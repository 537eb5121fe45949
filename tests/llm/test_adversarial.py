"""Words, lines, windows and sets that polynomial hashes modulo 2^64 cannot tell apart."""

import brute
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from brute_quality import base as quality_base
from tokenizers import Tokenizer

from cairn.llm import _vector as V
from cairn.llm import neardup, packing, quality, substring
from cairn.llm._spark import prepare


def thue_morse(n, a="a", b="b"):
    """A word of n letters and its complement."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in odd), "".join((b, a)[x] for x in odd)


PAIRS = [thue_morse(1024), thue_morse(4096), thue_morse(1024, "0", "z")]


def frame(spark, texts):
    return prepare(spark).createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("a, b", PAIRS)
def test_substring(spark, a, b):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:30], x, *words[30:]]) for x in (a, b, a)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.digest(frame(spark, texts)).collect()}
    assert got == brute.repeated_words(list(enumerate(texts, 1)))
    assert got[2][1] == 0 and got[3][1] == 61


def test_substring_of_arranged_words(spark):
    odd = [bin(i).count("1") % 2 for i in range(64)]
    texts = [" ".join(("left", "right")[x ^ flip] for x in odd) for flip in (0, 1)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.digest(frame(spark, texts)).collect()}
    assert got == brute.repeated_words(list(enumerate(texts, 1)))


@pytest.mark.parametrize("a, b", PAIRS)
def test_quality(spark, a, b):
    texts = [f"x y {a} k x y {b} " + " ".join(f"w{i}" for i in range(60)), f"{a}\n{b}\n{a} \n{a}\n", f"{a} {b} {a} {b} {a}"]
    for r in quality.apply(frame(spark, texts)).collect():
        assert {k: r[k] for k in quality_base("")} == quality_base(texts[r["doc_id"] - 1])
    first = quality.judge(pa.array(texts))[0]
    assert first["n_repeat_words"][0] == 0 and first["n_dup_lines"].tolist() == [0, 1, 0]


@pytest.mark.parametrize("a, b", PAIRS)
def test_packing(spark, a, b):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pieces(frame(spark, [a, b, f"{a} {b}"]).coalesce(1), P.path("word_bpe_49k.json"), length=1 << 20, want_ids=True).collect()
    assert {r["doc_id"]: list(r["token_ids"]) for r in rows} == {i: [*own.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate([a, b, f"{a} {b}"], 1)}


@pytest.mark.parametrize("a, b", PAIRS)
def test_neardup(spark, a, b):
    texts = [f"{a} {b} {a} {a} {b}", f"{b} {a} {b} {b} {a}", a, b]
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, texts)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert neardup.apply(frame(spark, texts)).count() == 4


def test_windows_are_equal_for_equal_runs():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 3, 5, 25, 50):
        hashes = V.windows(items, width)
        runs = [items[i : i + width].tobytes() for i in range(len(items) - width + 1)]
        assert len(hashes) == len(runs) and len(set(zip(hashes.tolist(), runs, strict=True))) == len(set(runs)) == len(set(hashes.tolist()))
    assert len(V.windows(items[:3], 4)) == 0
