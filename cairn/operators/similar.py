"""Whole similarity joins over sets of words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import values as C
from cairn.sources.shared import forget, settle

#: Sets of one block of those that share a word; blocks of a frequent word meet in different tasks.
BLOCK = 512
#: So many words of a set ask for one more word among the first ones of both that must be common.
MORE_EACH = 40
#: Bits of a word's number; words that share one are told, and all are numbered anew.
NUMBER_BITS = 56
#: Words that are numbered by other seeds at most; chance gives so many to 10^11 words.
MOVED = 1 << 16
#: Places of the table of frequencies, one byte each, and bits of the sketch of a set.
PLACES, SKETCH = 1 << 21, 512
#: Places of the table of sets that have a candidate, and sets of one task that are compared word by word.
MARKS, HELD = 1 << 23, 2048


def _numbered(text_col: str, moved: list[list[str]]) -> Column:
    return F.transform(F.array_distinct(X.words(F.coalesce(F.col(text_col), F.lit("")))), lambda w: _number(w, moved))


def _number(word: Column, moved: list[list[str]]) -> Column:
    """The word's number; those of the k-th list have theirs by another seed."""
    by = lambda seed: F.shiftrightunsigned(F.xxhash64(word, F.lit(seed)), 64 - NUMBER_BITS)
    out = by(0)
    for k, words in enumerate(moved, 1):
        out = F.when(word.isin(words), by(k)).otherwise(out)
    return out


def _frequencies(df: DataFrame, text_col: str) -> tuple[list[list[str]], bytes]:
    """Which words get their numbers by other seeds, so that no two share one, and for each place of numbers how many rows have its words, by steps of a quarter of an octave.

    Of 10^9 words some seven pairs share a number of 56 bits; one of each is moved, and numbers are looked at again.
    """
    words = settle(df.select(F.explode(F.array_distinct(X.words(F.coalesce(F.col(text_col), F.lit(""))))).alias("w")).groupBy("w").agg(F.count("*").alias("df")))
    moved: list[list[str]] = []
    while True:
        numbers = words.groupBy(_number(F.col("w"), moved).alias("h")).agg(F.sum("df").alias("df"), F.count("*").alias("n"), F.min("w").alias("w"))
        place = F.shiftrightunsigned("h", NUMBER_BITS - PLACES.bit_length() + 1).cast("int")
        level = F.least(F.ceil(4 * F.log2(F.sum("df"))), F.lit(127)).cast("tinyint")
        found = numbers.groupBy(place.alias("place")).agg(level.alias("level"), (F.max("n") > 1).alias("clash")).toArrow()  # PLACES rows of some bytes at most
        if not pc.any(found["clash"]).as_py():
            break
        shared = numbers.filter("n > 1").select("h", F.col("w").alias("stays"))
        more = [r["w"] for r in words.withColumn("h", _number(F.col("w"), moved)).join(shared, "h").filter("w <> stays").select("w").limit(MOVED + 1).collect()]
        if len(more) + sum(map(len, moved)) > MOVED:
            raise ValueError(f"more than {MOVED} words share their numbers with others")
        moved = [[w for w in old if w not in more] for old in moved] + [more]
    forget(words)
    table = np.zeros(PLACES, np.int8)
    table[found["place"].to_numpy()] = found["level"].to_numpy()
    return moved, table.tobytes()


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the size of each."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64)


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", above: float = C.DUPLICATE_ABOVE) -> DataFrame:
    """id, class_id and links for every row: the least id with the same set of words, and how many other rows have a Jaccard similarity above the threshold.

    Rows with the same words are one set. A set's words are sorted from rare to
    frequent; sets above the threshold share one of the first few, by which they
    meet; with as many more first words as there are MORE_EACH words in a set, they share
    one more for each. What meets are ids, sizes and places; sizes, places, the number of
    first words shared and then sketches leave out pairs that cannot be above the threshold. Only sets of pairs that are left are
    taken from the texts again, once for each task, and compared word by word; links
    are counted there, not kept. Null and empty texts are the set without words.

    Words are 56-bit numbers that are checked to be distinct, so nothing rests on hashes
    but the class, which is the SHA-256 of a set. The order of words is by frequencies in
    places that words share: any order gives the same links.
    """
    moved, table = _frequencies(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(table)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()

    def described(texts: DataFrame, fields: str) -> DataFrame:
        names = fields.split()
        types = {"id": kind, "f": "binary", "size": "int", "p": "array<bigint>", "sketch": "binary", "h": "array<bigint>"}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level = np.frombuffer(shared.value, np.int8)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    columns = _describe(batch.column(1).slice(at, 1000), level, above) | {"id": batch.column(0).slice(at, 1000)}
                    yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

        return texts.select("id", _numbered("_text", moved).alias("h")).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names))

    rows = settle(described(texts, "id f size p sketch"))
    sets = rows.groupBy("f").agg(F.min("id").alias("class_id"), F.count("*").alias("n"), F.first(F.struct("size", "p", "sketch")).alias("x"))
    sets = settle(sets.select(F.monotonically_increasing_id().alias("s"), "f", "class_id", "n", "x.*"))
    pairs = _likely(_meeting(sets, above), sets, above)
    linked = _linked(pairs, sets, lambda mark: described(texts.filter(mark("id")), "f h"), above)
    counted = sets.join(linked, "s", "left").select("f", "class_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return rows.select("id", "f").join(counted, "f").select(F.col("id").alias(id_col), "class_id", "links")


def _describe(lists: pa.Array, level: np.ndarray, above: float) -> dict[str, pa.Array]:
    """Of each set of numbers: its digest, size, first words from rare to frequent, sketch, and all its words."""
    h, n = _lists(lists)
    row = np.repeat(np.arange(len(n)), n)
    flips = np.bincount(row * SKETCH + h % SKETCH, minlength=len(n) * SKETCH) & 1
    sketch = np.packbits(flips.astype(np.uint8).reshape(len(n), SKETCH), axis=1)
    key = level[h >> (NUMBER_BITS - PLACES.bit_length() + 1)].astype(np.int64) << NUMBER_BITS | h
    key = key[np.lexsort((key, row))]
    ends = np.cumsum(n)
    begins = ends - n
    least = np.ceil(above * n - 1e-9).astype(np.int64)  # words that two linked sets share at least
    few = n - least + np.minimum(1 + n // MORE_EACH, least)
    first = key[np.arange(len(key)) < np.repeat(begins + few, n)]
    many = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))
    sets = [hashlib.sha256(key[a:b].tobytes()).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    return {"f": pa.array(sets, pa.binary()), "size": pa.array(n, pa.int32()), "p": many(first, few), "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()), "h": many(key, n)}


def _meeting(sets: DataFrame, above: float) -> DataFrame:
    """s1, s2 and a word (t) of pairs that share as many first words as linked ones do, and whose sizes and places of them allow the threshold."""
    met = sets.select("s", "size", F.posexplode("p").alias("at", "t"))
    blocks = met.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("sets")).filter("sets > 1").drop("sets")
    met = met.join(blocks, "t")
    own = met.select("t", F.pmod(F.xxhash64("s"), "blocks").cast("int").alias("block"), *(F.col(c).alias(f"{c}1") for c in ("s", "size", "at")))
    other = met.select("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"{c}2") for c in ("s", "size", "at")))
    total = F.col("size1") + F.col("size2")
    most = F.least("at1", "at2") + 1 + F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2")) - 1  # words that may be common
    alike = (F.col("s1") < F.col("s2")) & (F.least("size1", "size2") >= above * F.greatest("size1", "size2")) & (most / (total - most) > above)
    found = own.join(other, ["t", "block"]).filter(alike).groupBy("s1", "s2", F.least("size1", "size2").alias("size")).agg(F.min("t").alias("t"), F.count("*").alias("shared"))
    shared = F.least(1 + F.floor(F.col("size") / MORE_EACH), F.ceil(above * F.col("size") - 1e-9))
    return found.filter(F.col("shared") >= shared).select("s1", "s2", "t")


def _likely(pairs: DataFrame, sets: DataFrame, above: float) -> DataFrame:
    """Those whose sketches allow the threshold: sets differ in as many words at least as their sketches do in bits."""
    side = lambda i: sets.select(F.col("s").alias(f"s{i}"), F.col("size").alias(f"size{i}"), F.col("sketch").alias(f"sketch{i}"))
    names = ["s1", "s2", "t"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            bits = [np.frombuffer(b"".join(column(f"sketch{i}").to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for i in (1, 2)]
            total = sum(np.asarray(column(f"size{i}")).astype(np.int64) for i in (1, 2))
            most = (total - np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)) / 2
            yield pa.RecordBatch.from_arrays([column(c) for c in names], names).filter(pa.array(most / (total - most) > above))

    return settle(pairs.join(side(1), "s1").join(side(2), "s2").mapInArrow(judge, "s1 bigint, s2 bigint, t bigint"))


def _linked(pairs: DataFrame, sets: DataFrame, taken: Callable[[Callable[[str], Column]], DataFrame], above: float) -> DataFrame:
    """s and more: how many rows of other sets are linked with a set, by the words of both.

    Pairs of a word are dealt to one task, or by blocks of both sides where they are many; a task gets each of its
    sets once. ``taken`` gives digest and words of the texts whose id satisfies a condition: a table of hashes, so others may come too.
    """
    spark = pairs.sparkSession
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).cast("int")
    ends = pairs.select(F.col("s1").alias("s"), "t").union(pairs.select(F.col("s2").alias("s"), "t")).distinct()
    crowds = ends.groupBy("t").agg(F.count("*").alias("sets"), F.ceil(F.count("*") / BLOCK).alias("g"))
    cells = max(12, -(-ends.count() // HELD))
    dealt = pairs.join(crowds, "t")
    dealt = dealt.select(F.pmod(F.xxhash64("t", F.pmod(F.xxhash64("s1"), "g"), F.pmod(F.xxhash64("s2"), "g")), F.lit(cells)).cast("int").alias("cell"), "s1", "s2")
    asked = ends.select("s").distinct().join(sets, "s")
    places = asked.select(place("class_id").alias("m")).distinct().toArrow()["m"].to_numpy()  # MARKS numbers at most
    marks = np.zeros(MARKS, bool)
    marks[places] = True
    known = spark.sparkContext.broadcast(np.packbits(marks).tobytes())

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = np.asarray(places).astype(np.int64)
        return pa.array((np.frombuffer(known.value, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    need = dealt.select("cell", F.col("s1").alias("s")).union(dealt.select("cell", F.col("s2").alias("s"))).distinct().join(sets.select("s", "n", "f"), "s")
    held = need.join(taken(lambda c: marked(place(c))), "f").select(F.col("cell").alias("at"), "s", "n", "h")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        first, second = (np.asarray(pc.index_in(a[c].combine_chunks(), b["s"].combine_chunks())) for c in ("s1", "s2"))
        h, size = _lists(b["h"])
        _, word = np.unique(h, return_inverse=True)
        copies, more = b["n"].to_numpy(), np.zeros(b.num_rows, np.int64)
        begin, has = np.cumsum(size) - size, np.zeros(len(word) + 1, bool)
        order = np.argsort(first, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(first[order])) + 1) if len(order) else ():
            i = first[one[0]]
            has[word[begin[i] : begin[i] + size[i]]] = True
            for at in range(0, len(one), 256):
                j = second[one[at : at + 256]]
                ends = np.cumsum(size[j])
                same = np.add.reduceat(has[word[np.arange(ends[-1]) + np.repeat(begin[j] - ends + size[j], size[j])]], ends - size[j], dtype=np.int64)
                j = j[same / (size[i] + size[j] - same) > above]
                more[i] += copies[j].sum()
                np.add.at(more, j, copies[i])
            has[word[begin[i] : begin[i] + size[i]]] = False
        return pa.table([b["s"], pa.array(more)], names=["s", "more"])

    found = dealt.groupBy("cell").cogroup(held.groupBy("at")).applyInArrow(compare, "s bigint, more bigint")
    return found.groupBy("s").agg(F.sum("more").alias("more"))
