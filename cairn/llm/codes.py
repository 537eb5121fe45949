"""Codes of a few bytes for vectors, by codebooks of whole numbers.

Vectors are scaled, floored and cut into PARTS consecutive parts. Each part's
codebook begins with that part of the first ENTRIES vectors by id, and in each of
ROUNDS rounds every part goes to its nearest entry, which then becomes the floored
mean of its parts. Nearest entries are found by segment means: with the sums of 1, 2
and then 4 blocks of a part, and the length of what the means leave over, no distance
is below ``sum (sum_a - sum_b)^2 / size + (rest_a - rest_b)^2``. The entry of the least
coarse bound is measured first; entries whose bound is above that distance, at any
resolution, are out, and the survivors get their exact distances in whole numbers.

A round is one pass over the settled whole numbers: each task sums the parts of every
entry, Spark adds these up, and the driver gets one number for each component of the
codebooks, however many vectors there are.

Cases: a vector that is null or holds null or non-finite components is left out, as is
one of another length than the first's (by id, then by components; null ids come last).
Rows that share an id are vectors each; equal distances go to the lower entry; fewer
vectors than entries give smaller codebooks; parts differ by one component at most where the length
is no multiple of PARTS; components so large that distances might not fit 64 bits are
an error. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._spark import prepare, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCKS = (1, 2, 4)
#: Vectors that are assigned at a time.
ROWS = 1 << 12
#: Rows of one label are dealt to so many tasks when they get their label's sum.
SALTS = 16


def cuts(width: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * width // parts


class Bounds:
    """Block sums and lengths of rests of some vectors at each resolution."""

    def __init__(self, x: np.ndarray):
        x = x.astype(np.float64)
        self.levels = []
        whole = np.einsum("ij,ij->i", x, x)
        for blocks in BLOCKS:
            at = np.unique(cuts(x.shape[1], min(blocks, max(1, x.shape[1]))))
            sizes = np.diff(at)
            mean = (np.add.reduceat(x, at[:-1], axis=1) if len(sizes) else np.zeros((len(x), 1))) / np.sqrt(sizes if len(sizes) else 1)
            rest = np.sqrt(np.maximum(whole - np.einsum("ij,ij->i", mean, mean), 0))
            self.levels.append(np.concatenate([mean, rest[:, None]], axis=1))
        #: More than rounding may add to a bound of this vector.
        self.slack = whole * 1e-9


def nearest(x: np.ndarray, book: np.ndarray, bounds: Bounds | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row and the exact squared distance, ties to the lower entry; and how many distances were measured."""
    bounds = bounds or Bounds(book)
    mine = Bounds(x)
    slack = mine.slack[:, None] + bounds.slack[None, :] + 1e-6
    low = ((mine.levels[0][:, None, :] - bounds.levels[0][None, :, :]) ** 2).sum(2) - slack
    exact = lambda row, entry: ((x[row] - book[entry]) ** 2).sum(1)
    every = np.arange(len(x))
    first = low.argmin(1)
    best = exact(every, first)
    row, entry = np.nonzero(low <= best[:, None])
    for mine_, theirs in zip(mine.levels[1:], bounds.levels[1:], strict=True):
        near = ((mine_[row] - theirs[entry]) ** 2).sum(1) - slack[row, entry] <= best[row]
        row, entry = row[near], entry[near]
    far = exact(row, entry)  # the first entry of each row is among them
    begin = np.searchsorted(row, every)
    least = np.minimum.reduceat(far, begin) if len(x) else far
    at = np.where(far == least[row], entry, len(book))
    return (np.minimum.reduceat(at, begin) if len(x) else at), least, len(row) + len(x)


def _whole(scale: float):
    """id, label and whole-number components of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.asarray(lists.is_null())
            bad[owner[~np.isfinite(values)]] = True
            keep = ~bad[owner]
            whole = np.floor(values[keep] * scale)
            if len(whole) and 4.0 * np.square(whole).max() * max(1, sizes.max()) >= 2.0**62:
                raise OverflowError("distances may not fit 64 bits")
            good = pa.array(np.flatnonzero(~bad))
            offsets = np.concatenate([[0], np.cumsum(sizes[~bad])]).astype(np.int32)
            columns = [batch.column(0).take(good), batch.column(1).take(good), pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of up to ROWS vectors (the last column) and their components."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return whole, np.asarray(whole.column(whole.num_columns - 1).flatten()).astype(np.int64).reshape(whole.num_rows, width)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield out()
            held = []
    if held:
        yield out()


def _sums(books: list[np.ndarray], width: int):
    """part, entry, place, total and how many: what a task's vectors add to each entry."""
    at = cuts(width, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(b) for b in books]
        totals, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, x in _blocks(batches, width):
            for p, book in enumerate(books):
                part = x[:, at[p] : at[p + 1]]
                code = nearest(part, book, bounds[p])[0]
                np.add.at(totals[p], code, part)
                counts[p] += np.bincount(code, minlength=len(book))
        rows = [(p, e, i, int(totals[p][e, i]), int(counts[p][e])) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist() for i in range(totals[p].shape[1])]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "entry", "place", "total", "n"])

    return run


def fit(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of settled whole-number vectors (id, v), all of one width."""
    seeds = np.array([r["v"] for r in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()], np.int64).reshape(-1, width)
    at = cuts(width, parts)
    books = [seeds[:, at[p] : at[p + 1]] for p in range(parts)]
    for _ in range(rounds):
        found = vectors.select("v").mapInArrow(_sums(books, width), "part int, entry int, place int, total long, n long")
        books = [b.copy() for b in books]
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # one row for each component of the codebooks
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """id, label, code (two hex digits a part) and error (the sum of the parts' squared distances)."""
    at = cuts(width, len(books))
    kept = vectors.select("id", "label", "v")
    schema = T.StructType([*kept.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(b) for b in books]
        for batch, x in _blocks(batches, width):
            code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                code[:, p], far, _ = nearest(x[:, at[p] : at[p + 1]], book, bounds[p])
                error += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], schema.names)

    return kept.mapInArrow(run, schema)


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([b[e] for b, e in zip(books, bytes.fromhex(code), strict=True)])


def fingerprint(books: list[np.ndarray]) -> str:
    """The digest of all entries' components."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def apply(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = SCALE) -> DataFrame:
    """id, code, error, label_error (of all rows of the label) and codebooks_sha256 of every usable vector."""
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kinds = T.StructType([*rows.schema.fields[:2], T.StructField("v", T.ArrayType(T.IntegerType()))])
    vectors = settle(rows.mapInArrow(_whole(scale), kinds))
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).head()
    if first is None:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kinds[0].dataType), *T.StructType.fromDDL("code string, error long, label_error long, codebooks_sha256 string").fields]))
    width = first[0]
    vectors = vectors.filter(F.size("v") == width)
    books = fit(vectors, width)
    coded = settle(encode(vectors, books, width)).withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    errors = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    errors = errors.withColumn("_dealt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    told = coded.join(errors, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_dealt")))
    return told.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
