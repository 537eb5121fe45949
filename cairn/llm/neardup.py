"""Near-duplicate classes by ProbMinHash over sets of word shingles.

A document is the set of its shingles of WORDS words, all of one weight, as links
are judged by the Jaccard similarity of these sets. Every shingle is a Poisson
process, whose arrivals go to random ones of REGISTERS registers; a register
keeps the earliest. A process ends once its next arrival is later than the
latest register. So two documents agree in a register with their set Jaccard
similarity. Bands of ROWS registers give candidates, which are verified.

Documents with the same set are merged first. In each bucket every member is
compared with one pivot; verified links give components. In buckets that still
hold several components, each member outside the largest one is compared with
all members of other components, in blocks of bounded size, by the exact number
of common shingles, the verified ones alone being emitted. So no link that shares
a bucket is lost; at a similarity of 0.8 two documents share none with a
probability of (1 - 0.8^4)^32 = 5e-8.

Cases: a text of fewer than WORDS words is one shingle; a null or empty text is
in a class by itself; so are documents with null id; ids are whole numbers, others
are an error; rows that share an id are judged each by its text, and class ids may
then name several texts; repeated rows are one class, of which ``apply`` keeps one
row; an empty table gives no rows. Other columns are ignored by ``classes`` and
kept by ``apply``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import _vector as V
from cairn.llm._chunks import pack, unpack
from cairn.llm._spark import prepare, settle
from cairn.llm.components import components

WORDS, SIMILARITY = 5, 0.8
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: Members outside the largest component that one task compares with a bucket.
BLOCK = 1024
_FINE = np.uint64((1 << 48) - 1)


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of all texts, sorted within each; their counts; how many stand before each text."""
    data, offsets = V.buffers(texts)
    starts, ends, first = V.words(data, offsets)
    words = V.word_hashes(data, starts, ends)
    m = len(words)
    at = np.flatnonzero(V.within(first, n, m))
    doc = np.searchsorted(first, at, "right") - 1
    hashes = V.windows(words, n)[at] if m >= n else np.zeros(0, np.uint64)
    for k in range(1, n):
        few = np.flatnonzero(np.diff(first) == k)
        if len(few):
            hashes = np.concatenate([hashes, V.windows(words, k)[first[few]]])
            doc = np.concatenate([doc, few])
    order = np.lexsort((hashes & _FINE, doc))
    hashes, doc = hashes[order] & _FINE, doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(doc))), np.searchsorted(doc[at], np.arange(len(offsets)))


def signatures(hashes: np.ndarray, counts: np.ndarray, before: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For each text, with weights 1 + ln(count), the 32-bit names of the shingles that arrive first at its registers; 0 for texts without shingles."""
    n = len(before) - 1
    doc = np.repeat(np.arange(n), np.diff(before))
    rate = 1.0 + np.log(counts)
    time = np.zeros(len(doc))
    element = np.arange(len(doc))
    earliest = np.full(n * registers, np.inf)
    slots, times, names = [], [], []
    round_ = 0
    while len(element):
        round_ += 1
        x = V.mix(hashes[element] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(round_ * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        time[element] -= np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[element]
        y = V.mix(x)
        slot = doc[element] * registers + (y % np.uint64(registers)).astype(np.int64)
        now = time[element]
        np.minimum.at(earliest, slot, now)
        slots.append(slot)
        times.append(now)
        names.append(hashes[element])
        docs = doc[element]
        present = docs[np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))]
        latest = np.zeros(n)
        latest[present] = earliest.reshape(n, registers)[present].max(1)
        element = element[now < latest[docs]]
    out = np.zeros(n * registers, np.uint32)
    if slots:
        slot, when, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        won = when == earliest[slot]
        out[slot[won]] = (V.mix(name[won]) >> np.uint64(32)).astype(np.uint32)
    return out.reshape(n, registers)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(sigs), 0)
    for i in range(ROWS):
        key = V.mix(key * np.uint64(V._P1) + sigs[:, i::ROWS].astype(np.uint64))
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, hash of the text, two fingerprints of the shingle set (null without words), and the band keys."""
    for batch in batches:
        for part in V.slices(batch, "text"):
            hashes, counts, before = shingles(part.column(1))
            keys = band_keys(signatures(hashes, np.ones_like(counts), before))
            raw = memoryview(hashes).cast("B")
            sets = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
            prints = np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2).T.copy()
            empty = np.diff(before) == 0
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(p, mask=empty) for p in prints), bands], ["doc", "h", "f1", "f2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, its packed shingle hashes."""
    for batch in batches:
        for part in V.slices(batch, "text"):
            hashes, _, before = shingles(part.column(1))
            packed = [pack(hashes[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["doc", "shingles"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes."""
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same) if len(both) else 0.0


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep = [jaccard(unpack(p)[0], unpack(q)[0]) >= least for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Index:
    """The sets of one block, by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def jaccard(self, x: np.ndarray) -> np.ndarray:
        """Of each set with a sorted array of distinct hashes."""
        first = np.searchsorted(self.hashes, x, "left")
        n = np.searchsorted(self.hashes, x, "right") - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = np.bincount(self.owner[at], minlength=len(self.sizes))
        return same / (self.sizes + len(x) - same)


def _search(least: float):
    """Reads the rows of each (key, block): first the block's own documents, then the bucket's members one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, index, linked = None, [], None, set()
        for batch in batches:
            found = []
            for key, block, asks, doc, comp, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, block) != at:
                    at, own, index, linked = (key, block), [], None, set()
                row = (doc, comp, unpack(packed)[0])
                if asks == 0:
                    own.append(row)
                    continue
                if not own:
                    continue
                if index is None:
                    index = _Index([r[2] for r in own])
                for i in np.flatnonzero(index.jaccard(row[2]) >= least).tolist():
                    other = own[i]
                    pair = (min(comp, other[1]), max(comp, other[1]))
                    if pair[0] != pair[1] and pair not in linked:
                        linked.add(pair)
                        found.append((min(doc, other[0]), max(doc, other[0])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def links(docs: DataFrame, reps: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) that connect all representatives (rep, bands) that are connected; docs: doc, text."""
    bands = reps.select("rep", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    shared = settle(bands.join(buckets.drop("n"), "key"))
    needed = shared.select(F.col("rep").alias("doc")).distinct()
    sets = settle(docs.join(needed.hint("shuffle_hash"), "doc", "left_semi").select("doc", "text").mapInArrow(_sets, "doc long, shingles binary"))
    side = lambda name, to: sets.select(F.col("doc").alias(name), F.col("shingles").alias(to))
    pairs = shared.filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    tested = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    first = settle(tested.mapInArrow(_verify(least), "a long, b long"))

    known = components(first)
    members = shared.drop("pivot").join(known, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("key").agg(F.max_by("comp", "n").alias("main"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    rows = members.join(open_, "key").withColumn("blocks", F.ceil(F.col("outside") / BLOCK).cast("int"))
    own = rows.filter("comp <> main").select("key", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(0).alias("asks"), "rep", "comp")
    every = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "rep", "comp")
    loaded = own.union(every).join(sets, F.col("rep") == F.col("doc")).select("key", "block", "asks", "rep", "comp", "shingles")
    dealt = loaded.repartition("key", "block").sortWithinPartitions("key", "block", "asks")
    return first.union(settle(dealt.mapInArrow(_search(least), "a long, b long")))


def _classified(df: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """doc, h (hash of the text), f1 (null without words) and class_id of every row."""
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketch = docs.select("doc", "text", F.xxhash64("text").alias("h")).mapInArrow(_sketch, "doc long, h long, f1 long, f2 long, bands array<long>")
    sketch = settle(sketch)
    usable = sketch.filter("f1 is not null and doc is not null")
    reps = usable.groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"))
    found = links(docs.filter("doc is not null"), reps, least)
    known = components(found)
    of = reps.select("f1", "f2", "rep").join(known, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("comp", "rep").alias("class_id"))
    rows = sketch.select("doc", "h", "f1", "f2").join(of, ["f1", "f2"], "left")
    return rows.select("doc", "h", "f1", F.coalesce("class_id", "doc").alias("class_id"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """id and class_id, the least id of the documents that are connected with it, for every row."""
    return _classified(df, id_col, text_col, least).select(F.col("doc").alias(id_col), "class_id")


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The table with one row of each class, that of the least id, and of rows with that id that of the least hash of its text."""
    found = _classified(df, id_col, text_col, least).filter("doc is not null and f1 is not null")
    texts = settle(found.groupBy("class_id", "doc", "h").agg(F.count("*").alias("n")))
    stays = texts.groupBy("class_id").agg(F.min(F.struct("doc", "h")).alias("first")).select("first.doc", "first.h", F.lit(True).alias("stay"))
    judged = texts.join(stays, ["doc", "h"], "left").select("doc", "h", "n", F.coalesce("stay", F.lit(False)).alias("stay"))  # met by row: a class may hold very many
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("h"))
    left = rows.join(judged.filter("not stay").select("doc", "h").hint("shuffle_hash"), ["doc", "h"], "left_anti")
    again = judged.filter("stay and n > 1").select("doc", "h")
    if not again.isEmpty():  # rows that agree in id and text
        left = left.join(again, ["doc", "h"], "left_anti").union(left.join(again, ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"]))
    return left.select("row.*")
