"""Exact top-k search by inner product over integer vectors.

Vectors are cut into segments, 1, 4 and then 16 of them. From the mean and the
deviation of each segment follows a lower bound on the distance of two vectors,
d^2 >= sum m * ((mean_a - mean_b)^2 + (dev_a - dev_b)^2), and with
2 * (a.b) = |a|^2 + |b|^2 - d^2 an upper bound on their product. A pair whose
bound at some resolution is below the query's k-th best score so far is out.
Of the pairs that survive the finest one each query's best bounds are scored
first, which raises its k-th best score and drops more pairs; the rest of the
survivors are then scored exactly. Vectors that lie evenly in all directions
leave the bounds nothing to drop; then the scores are one matrix product.

Queries go in blocks against groups of vectors. A task holds one block of
queries and reads its vectors in chunks, so memory does not follow the table.

Cases: a vector that is null, empty or holds null or non-finite components, and
a row without id, takes no part. Only vectors of one length are compared. Equal
scores go to the smaller id. Rows that repeat an id count as one, with the best
score of their vectors, and never answer the query of the same id. Fewer than k candidates give
fewer rows; an empty table gives none. Scaled components of 2^31 or more are an
error, as scores might not fit. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._spark import prepare

RESOLUTIONS = (1, 4, 16)
#: Vectors of one chunk, of one group and queries of one block.
CHUNK, GROUP, BLOCK = 256, 1 << 14, 1 << 11
#: Vectors that are bounded at once, so that the best bounds among many are scored first.
TOGETHER = 1 << 12
#: Share of pairs up to which they are scored one by one; beyond, their rows and columns are multiplied whole.
SPARSE = 1 / 16
#: Lengths' product below which products and sums of doubles are exact whole numbers.
EXACT = 1 << 52
#: Pairs that are scored one by one at a time.
PAIRS = 1 << 16
_PACKED = "dim int, grp int, block int, is_vector int, ids binary, data binary"
_FOUND = "query_id long, vec_id long, score long"


def segments(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of each row's segments, scaled so that their dot product bounds that of the rows."""
    dim = x.shape[1]
    cuts = np.unique(np.linspace(0, dim, min(parts, dim) + 1).astype(int))[:-1]
    sizes = np.diff(np.append(cuts, dim))
    mean = np.add.reduceat(x, cuts, axis=1) / sizes
    square = np.add.reduceat(x * x, cuts, axis=1) / sizes
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    root = np.sqrt(sizes)
    return np.hstack([mean * root, dev * root])


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.exact = data
        self.x = data.astype(np.float64)
        self.stats = [segments(self.x, s) for s in RESOLUTIONS]
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.found = np.zeros((3, 0), np.int64)  # row of the query, score, id
        self.least = np.full(len(ids), -np.inf)
        self.pairs = self.scored = 0  # how many pairs there were, and how many were scored

    def add(self, ids: np.ndarray, data: np.ndarray) -> None:
        y = data.astype(np.float64)
        top = float(self.norm.max(initial=0) * np.sqrt((y * y).sum(1).max(initial=0)))
        if top >= 1 << 62:
            raise OverflowError("scores do not fit 64 bits")
        slack = 1 + 1e-9 * top
        rows, columns = np.arange(len(self.ids)), np.arange(len(ids))
        alive = self.ids[:, None] != ids
        self.pairs += int(alive.sum())
        bound = np.zeros(alive.shape)
        for resolution, mine in zip(RESOLUTIONS, self.stats, strict=True):
            part = alive if alive.size == len(rows) * len(columns) else alive[np.ix_(rows, columns)]
            rows, columns = rows[part.any(1)], columns[part.any(0)]
            if not len(rows):
                return
            theirs = segments(y[columns], resolution).T
            if alive.size == len(rows) * len(columns):  # nothing to leave out, and so nothing to copy
                np.matmul(mine, theirs, out=bound)
                bound += slack
                alive &= bound >= self.least[:, None]
            else:
                block = np.ix_(rows, columns)
                bound[block] = mine[rows] @ theirs + slack
                alive[block] &= bound[block] >= self.least[rows, None]
        bound[~alive] = -np.inf
        best = np.argpartition(bound, max(0, len(ids) - self.k), axis=1)[:, -self.k :]
        row, column = np.repeat(np.arange(len(self.ids)), best.shape[1]), best.ravel()
        first = alive[row, column]
        self._pairs(row[first], column[first], ids, data, y, top)
        alive[row, column] = False
        alive &= bound >= self.least[:, None]
        left = np.count_nonzero(alive)
        if left <= SPARSE * alive.size:
            self._pairs(*np.nonzero(alive), ids, data, y, top)
            return
        self.scored += left
        whole = np.matmul(self.x, y.T, out=bound) if top < EXACT else self.exact.astype(np.int64) @ data.astype(np.int64).T
        alive &= whole >= self.least[:, None]
        row, column = np.nonzero(alive)
        self._merge(np.stack([row, whole[row, column].astype(np.int64), ids[column]]))

    def _pairs(self, row: np.ndarray, column: np.ndarray, ids: np.ndarray, data: np.ndarray, y: np.ndarray, top: float) -> None:
        """Scores pairs one by one and keeps the best."""
        self.scored += len(row)
        parts = [slice(i, i + PAIRS) for i in range(0, len(row), PAIRS)]
        one = lambda p: np.einsum("ij,ij->i", self.x[row[p]], y[column[p]]).astype(np.int64) if top < EXACT else (self.exact[row[p]].astype(np.int64) * data[column[p]]).sum(1)
        score = np.concatenate([one(p) for p in parts]) if parts else np.zeros(0, np.int64)
        keep = score >= self.least[row]
        self._merge(np.stack([row[keep], score[keep], ids[column[keep]]]))

    def _merge(self, new: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.found, new], axis=1)
        order = np.lexsort((-score, ids, row))
        row, score, ids = row[order], score[order], ids[order]
        fresh = np.ones(len(row), bool)  # the best of the vectors of one id
        fresh[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        row, score, ids = row[fresh], score[fresh], ids[fresh]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.found = np.stack([row[keep], score[keep], ids[keep]])
        full = place == self.k - 1
        self.least[row[full]] = score[full]

    def rows(self) -> pa.RecordBatch:
        row, score, ids = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def _pack(groups: int, blocks: int, every: int, scale: float):
    """Chunks of usable vectors for each group, and of queries for each block."""

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple]:
        vectors = batch.column(1)
        sizes = np.asarray(vectors.value_lengths().fill_null(0))
        values = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan))
        starts = np.cumsum(sizes) - sizes
        known = ~np.asarray(batch.column(0).is_null())
        ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero((sizes == dim) & known)
            x = values[starts[at][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(1)
            at, x = at[good], np.floor(x[good] * scale)
            if len(x) and np.abs(x).max() >= 1 << 31:
                raise OverflowError("a scaled component does not fit 32 bits")
            x, own = x.astype(np.int32), ids[at]
            spread = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            asks = own % every == 0
            for is_vector, key, pick in ((1, spread % np.uint64(groups), slice(None)), (0, spread % np.uint64(blocks), asks)):
                key, mine, rows = key[pick].astype(np.int64), own[pick], x[pick]
                for k in np.unique(key).tolist():
                    i = np.flatnonzero(key == k)
                    for c in range(0, len(i), CHUNK):
                        j = i[c : c + CHUNK]
                        yield dim, k if is_vector else None, None if is_vector else k, is_vector, mine[j].tobytes(), rows[j].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in chunks(batch):
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["dim", "grp", "block", "is_vector", "ids", "data"])

    return run


def _score(k: int):
    """Reads the chunks of a key in order, queries first, and gives each query's best of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, held, best = None, [], [], None

        def flush() -> None:
            if held:
                best.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()

        for batch in batches:
            for dim, grp, block, is_vector, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dim, grp, block) != key:
                    if best:
                        flush()
                        yield best.rows()
                    key, asked, best = (dim, grp, block), [], None
                part = np.frombuffer(ids, np.int64), np.frombuffer(data, np.int32).reshape(-1, dim)
                if not is_vector:
                    asked.append(part)
                elif asked:
                    best = best or Best(*(np.concatenate(x) for x in zip(*asked, strict=True)), k)
                    held.append(part)
                    if sum(len(x) for x, _ in held) >= TOGETHER:
                        flush()
        if best:
            flush()
            yield best.rows()

    return run


def search(df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best of all other rows for each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = prepare(df.sparkSession)
    rows = df.count()
    groups, blocks = max(1, -(-rows // GROUP)), max(1, -(-rows // (every * BLOCK)))
    packed = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_pack(groups, blocks, every, scale), _PACKED)
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_vector") == 1, blocks - 1).otherwise(groups - 1)))
    packed = packed.withColumn("other", other).select("dim", F.coalesce("grp", "other").alias("grp"), F.coalesce("block", "other").alias("block"), "is_vector", "ids", "data")
    parts = max(groups * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = packed.repartition(parts, "dim", "grp", "block").sortWithinPartitions("dim", "grp", "block", "is_vector")
    found = dealt.mapInArrow(_score(k), _FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
