"""Exact nearest neighbours, keyword search, fusion and reranking, for many queries at once."""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import values as C
from cairn.sources.shared import forget, settle, sound

#: Vectors of one group and queries of one block, which meet in one task.
GROUP, BLOCK = 1 << 15, 1 << 11
#: Queries that a task compares with its group at a time, and vectors of the group.
ROWS, TILE = 256, 1 << 12
#: Vectors and bytes of one chunk at most, chunks of vectors that a task reads, and pairs that are told exactly at a time.
CHUNK, CHUNK_BYTES, CHUNKS, PAIRS = 1 << 12, 4 << 20, 16, 1 << 11
#: Chunks that have met others after a round, to those before it.
ROUND = 16
#: Phrases of the queries that are sent to the driver and to every task at most, of some 100 bytes each.
BROADCAST_ROWS = 1 << 16
#: Weights of documents by phrases that a task holds at a time.
WEIGHTS = 1 << 23
#: Stands for the document itself among its tokens.
_WHOLE = "\u0000"


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id", vector: str = "embedding", digits: int = 12) -> DataFrame:
    """query id, id, sim and rank of the k most similar vectors; ties go to the smaller id. Similarities are rounded to so many digits before they are ranked.

    Vectors of another width than the query's have similarity 0, as have those
    without length. Queries and vectors are dealt to a grid of blocks and groups of
    bounded size, so neither side is broadcast; a task scores a block against a
    group by one matrix product for each width and gives k rows for each query.
    """
    groups = max(1, -(-vectors.count() // GROUP))
    blocks = max(1, -(-queries.count() // BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("b"), spread(groups).alias("g"), F.col(query_id).alias("q"), F.col(vector).alias("qv"))
    right = vectors.select(F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int").alias("g"), spread(blocks).alias("b"), F.col(id_col).alias("v"), F.col(vector).alias("vv"))
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {vectors.schema[id_col].dataType.simpleString()}, sim double"

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        order = pc.sort_indices(b["v"])
        (n, x), (m, y) = _by_width(a["qv"]), _by_width(b["vv"])
        best = np.full((a.num_rows, min(k, b.num_rows)), -np.inf), np.zeros((a.num_rows, min(k, b.num_rows)), np.int64)
        for first in range(0, b.num_rows if a.num_rows else 0, TILE):  # by id, so that of equals the earlier stay
            tile = order[first : first + TILE].to_numpy()
            for width in np.unique(m[tile]).tolist():
                of = np.flatnonzero(m[tile] == width)
                unit = y(tile[of], width) if width else None
                for at in range(0, a.num_rows, ROWS):
                    rows = np.arange(at, min(at + ROWS, a.num_rows))
                    same = n[rows] == width if width else np.zeros(len(rows), bool)
                    sim = np.zeros((len(rows), len(of)))
                    if same.any():
                        sim[same] = rounded(x(rows[same], width) @ unit.T, digits)
                    _keep(best[0][rows[0] : rows[-1] + 1], best[1][rows[0] : rows[-1] + 1], sim, first + of)
        row = np.repeat(np.arange(a.num_rows), best[0].shape[1])
        return pa.table([a["q"].take(pa.array(row)), b["v"].take(order.take(pa.array(best[1].ravel()))), pa.array(best[0].ravel())], names=[query_id, id_col, "sim"])

    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(score, schema)
    order = Window.partitionBy(query_id).orderBy(F.desc("sim"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rounded(sim: np.ndarray, digits: int) -> np.ndarray:
    """As SQL rounds, halves away from zero; no negative zeros."""
    scaled = sim * 10.0**digits
    whole = np.trunc(scaled)
    whole += np.copysign(np.abs(scaled - whole) >= 0.5, scaled)
    return whole / 10.0**digits + 0.0


def _keep(best: np.ndarray, places: np.ndarray, sim: np.ndarray, columns: np.ndarray) -> None:
    """Takes similarities (rows by columns) into the best of each row and their places; of equals the smaller place stays."""
    k = best.shape[1]
    least = best.min(1)
    if sim.shape[1] > k:  # what is below the k-th of the tile is none of the best
        least = np.maximum(least, np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k])
    row, column = np.nonzero(sim >= least[:, None])
    row, place, value = (np.concatenate(p) for p in ((np.repeat(np.arange(len(best)), k), row), (places.ravel(), columns[column]), (best.ravel(), sim[row, column])))
    order = np.lexsort((place, -value, row))
    row = row[order]
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    best[:], places[:] = value[order].reshape(best.shape), place[order].reshape(best.shape)


def _by_width(column: pa.ChunkedArray):
    """The width of each vector, and a function that gives unit vectors of one width."""
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(lists.flatten().fill_null(0)).astype(np.float64)
    starts = np.cumsum(sizes) - sizes

    def unit(rows: np.ndarray, width: int) -> np.ndarray:
        x = values[starts[rows][:, None] + np.arange(width)]
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(length > 0, length, 1)

    return sizes, unit


def packed(vectors: DataFrame, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Chunks of vectors of one width, sorted by id, for ``nearest_above`` of so many at most.

    Of like vectors of a partition only the first ``k`` by id can be among the nearest ``k``; these are ``listed``.
    Null and empty vectors and those without length are left out, as they are similar to none.
    """
    kind, number = (vectors.schema[c].dataType for c in (id_col, vector))
    form = np.float32 if number.elementType.typeName() == "float" else np.float64
    names = ["chunk", "width", "ids", "listed", "vectors"]

    def chunk(width: int, parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        ids, x = pa.concat_arrays([i for i, _ in parts]), np.concatenate([v for _, v in parts])
        order = pc.sort_indices(ids)
        ids, x = ids.take(order), x[order.to_numpy()]
        seen: Counter[bytes] = Counter()
        listed = []
        for row in x:
            key = row.tobytes()
            seen[key] += 1
            listed.append(seen[key] <= k)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [pa.array([uuid.uuid4().hex]), pa.array([width], pa.int32()), one(ids), one(pa.array(listed)), pa.array([x.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            values = np.asarray(lists.flatten().fill_null(0)).astype(form)
            starts = np.cumsum(sizes) - sizes
            for width in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == width)
                x = values[starts[rows][:, None] + np.arange(width)]
                rows, x = rows[x.any(1)], x[x.any(1)]
                most = max(1, min(CHUNK, CHUNK_BYTES // (x.itemsize * width)))
                while len(rows):
                    parts = held.setdefault(width, [])
                    n = most - sum(len(i) for i, _ in parts)
                    parts.append((batch.column(0).take(pa.array(rows[:n])), x[:n]))
                    if len(rows) >= n:
                        yield chunk(width, held.pop(width))
                    rows, x = rows[n:], x[n:]
        for width, parts in held.items():
            yield chunk(width, parts)

    return vectors.select(id_col, vector).mapInArrow(run, f"chunk string, width int, ids array<{kind.simpleString()}>, listed array<boolean>, vectors binary")


def nearest_above(queries: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """query_id, id, sim and rank of the k most similar of the vectors that have ``least`` (over 0) or more; ties go to the smaller id.

    Both sides are ``packed``, with the ids of the queries and of the vectors. Each chunk of queries meets each chunk of
    vectors; what has been found for a query is the least for the chunks that follow in its task. Products in single
    precision only leave out what is below by more than their error; similarities are those of double precision.
    """
    sound(queries.sparkSession)
    cores, parts = queries.sparkSession.sparkContext.defaultParallelism, max(1, queries.rdd.getNumPartitions())
    left = queries.select("chunk", F.col("width").alias("w"), F.col("ids").alias("asked"), F.col("vectors").alias("x"))
    right = vectors.select(F.col("chunk").alias("other"), "width", "ids", "listed", F.col("vectors").alias("y"))
    right = right.coalesce(max(1, -(-vectors.count() // CHUNKS), -(-3 * cores // parts)))
    asked, known = (df.schema["ids"].dataType.elementType.simpleString() for df in (queries, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[pa.Array, np.ndarray, list]] = {}
        x = y = (None,)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, w, mine, data, other, width, ids, listed, others = (c[i] for c in batch.columns)
                if w.as_py() != width.as_py():
                    continue
                if x[0] != chunk.as_py():
                    x = (chunk.as_py(), *_units(data.as_py(), mine.values, w.as_py()))
                if y[0] != other.as_py():
                    taken = listed.values.to_numpy(zero_copy_only=False)
                    y = (other.as_py(), ids.values.filter(listed.values), *(a if taken.all() else a[taken] for a in _units(others.as_py(), ids.values, w.as_py())))
                _, best, hits = found.setdefault(x[0], (mine.values, np.full((len(x[1]), k), least, np.float64), []))
                row, column, sim = _above(x[1:], y[2:], best, k)
                hits.append((row, sim, y[1].take(pa.array(column))))
        for mine, best, hits in found.values():
            row, sim = (np.concatenate([h[j] for h in hits]) for j in (0, 1))
            keep = sim >= best[row, 0]
            ids = pa.concat_arrays([h[2] for h in hits]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([mine.take(pa.array(row[keep])), ids, pa.array(sim[keep])], ["query_id", "id", "sim"])

    near = left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, f"query_id {asked}, id {known}, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_among(vectors: DataFrame, k: int, least: float) -> DataFrame:
    """What ``nearest_above`` of ``packed`` vectors among themselves gives, each with itself too; two chunks meet once, for the vectors of both.

    Chunks meet in rounds, each of ROUND times as many as before. The k-th best so far is the least that the next round
    looks for, so a round gives some ROUND times k rows for a vector, however many chunks there are.
    """
    spark = sound(vectors.sparkSession)
    n, cores = vectors.count(), spark.sparkContext.defaultParallelism
    parts = max(1, -(-2 * n // CHUNKS), min(n, math.isqrt(3 * cores) + 1))
    kind = vectors.schema["ids"].dataType.elementType.simpleString()
    schema = f"chunk string, at int, query_id {kind}, id {kind}, sim double"
    per = Window.partitionBy("chunk", "at").orderBy(F.desc("sim"), "id")

    def rows(chunk: str, ids: pa.Array, best: np.ndarray, hits: list) -> pa.RecordBatch:
        hits = _kept(hits, best)
        row, sim = (np.concatenate([h[j] for h in hits]) for j in (0, 1))
        other = pa.concat_arrays([h[3].take(pa.array(h[2])) for h in hits])
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(row), pa.string()), pa.array(row, pa.int32()), ids.take(pa.array(row)), other, pa.array(sim)], ["chunk", "at", "query_id", "id", "sim"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, width, ids, listed, data in zip(*batch.columns, strict=True):
                x, taken = _units(data.as_py(), ids.values, width.as_py()), listed.values.to_numpy(zero_copy_only=False)
                best = np.full((len(taken), k), least, np.float64)
                row, column, sim = _above(x, tuple(a[taken] for a in x), best, k)
                yield rows(chunk.as_py(), ids.values, best, [(row, sim, column, ids.values.filter(listed.values))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[pa.Array, np.ndarray, list]] = {}
        x = y = (None,)

        def side(chunk: str, width: int, ids: pa.Array, listed: pa.Array, data: bytes, ats: pa.Array, bars: pa.Array) -> tuple:
            if chunk not in held:
                best = np.full((len(ids), k), least, np.float64)
                best[ats.to_numpy()] = bars.to_numpy()[:, None]
                held[chunk] = ids, best, []
            return chunk, _units(data, ids, width), listed.to_numpy(zero_copy_only=False)

        for batch in batches:
            for i in range(batch.num_rows):
                mine, theirs = ([c[i] for c in batch.columns[j : j + 7]] for j in (0, 7))
                plain = lambda v: v.values if isinstance(v, pa.ListScalar) else v.as_py()
                x = x if x[0] == mine[0].as_py() else side(*map(plain, mine))
                y = y if y[0] == theirs[0].as_py() else side(*map(plain, theirs))
                a, b = held[x[0]], held[y[0]]
                for one, (row, column, sim), other in zip((a, b), _both(x[1:], y[1:], a[1], b[1], k), (b, a), strict=True):
                    one[2].append((row.astype(np.int32), sim, column.astype(np.int32), other[0]))
                    if sum(len(h[0]) for h in one[2]) > 4 * k * len(one[0]):
                        one[2][:] = _kept(one[2], one[1])
        for chunk, (ids, best, hits) in held.items():
            yield rows(chunk, ids, best, hits)

    found = settle(vectors.select("chunk", "width", "ids", "listed", "vectors").mapInArrow(own, schema))
    met = 1
    while met < n:
        bars = found.withColumn("rank", F.row_number().over(per)).filter(F.col("rank") == k).groupBy("chunk").agg(F.collect_list(F.struct("at", "sim")).alias("b"))
        bars = bars.select("chunk", F.col("b.at").alias("ats"), F.col("b.sim").alias("bars"))
        empty = [F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in (("ats", "int"), ("bars", "double"))]
        chunks = settle(vectors.join(bars.hint("shuffle_hash"), "chunk", "left").select("chunk", "width", "ids", "listed", "vectors", *empty).coalesce(parts))  # chunks are large, so they are not sorted
        other = chunks.select(*(F.col(c).alias(f"{c}2") for c in chunks.columns))
        first, second = F.least("chunk", "chunk2"), F.greatest("chunk", "chunk2")
        turn = F.pmod(F.xxhash64(first, second), F.lit(n))
        now = (F.col("width") == F.col("width2")) & (F.col("chunk") != F.col("chunk2")) & ((F.col("chunk") < F.col("chunk2")) == (F.pmod(F.xxhash64(second, first), F.lit(2)) == 0))
        now &= (turn >= (0 if met == 1 else met)) & (turn < met * ROUND)
        more = chunks.hint("shuffle_replicate_nl").join(other, now).mapInArrow(run, schema)
        before = found
        found = settle(found.union(more).withColumn("rank", F.row_number().over(per)).filter(F.col("rank") <= k).drop("rank"), free=True)
        forget(chunks)
        forget(before)
        met *= ROUND
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.select("query_id", "id", "sim").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _kept(hits: list[tuple], best: np.ndarray) -> list[tuple]:
    """Hits (rows, similarities, rows of others and their ids) that are not below what is now the least of their row."""
    keep = [h[1] >= best[h[0], 0] for h in hits]
    return [(h[0][on], h[1][on], h[2][on], h[3]) for h, on in zip(hits, keep, strict=True)]


def _units(vectors: bytes, ids: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a chunk, their lengths, and single unit vectors."""
    x = np.frombuffer(vectors, np.float32 if len(vectors) == 4 * width * len(ids) else np.float64).reshape(-1, width)
    double = x.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", double, double))[:, None]
    length[length == 0] = 1
    return x, length, (x / length.astype(x.dtype)).astype(np.float32)


def _error(width: int) -> float:
    """Twice what rounding to single precision may change of a similarity, and more."""
    return (width + 16) * 2.0**-23


def _above(queries: tuple, vectors: tuple, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of vectors (vectors, lengths and single unit vectors each) and similarities that are not below the query's least in ``best`` (k in ascending order), k of each query at most; ``best`` takes them in."""
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(queries[0]), ROWS):
        sim = queries[2][at : at + ROWS] @ vectors[2].T
        row, column = _hits(sim, best[at : at + ROWS, 0], k, _error(vectors[0].shape[1]))
        for some, a in zip(found, _told(queries, vectors, at + row, column, best, k), strict=True):
            some.append(a)
    return tuple(np.concatenate(some) for some in found)


def _both(mine: tuple, theirs: tuple, best: np.ndarray, their_best: np.ndarray, k: int) -> tuple[tuple, tuple]:
    """``_above`` of two chunks (their units, and which rows are listed) for each in the other, by one product."""
    (x, known), (y, others) = mine, theirs
    found = tuple(([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]) for _ in range(2))
    error = _error(x[0].shape[1])
    for at in range(0, len(x[0]), ROWS):
        sim = x[2][at : at + ROWS] @ y[2].T
        row, column = _hits(sim, best[at : at + ROWS, 0], k, error)
        on = others[column]
        told = _told(x, y, at + row[on], column[on], best, k)
        column, row = _hits(sim, their_best[:, 0], k, error, axis=0)
        on = known[at + row]
        for lists, values in zip(found, (told, _told(y, x, column[on], at + row[on], their_best, k)), strict=True):
            for some, a in zip(lists, values, strict=True):
                some.append(a)
    return tuple(tuple(np.concatenate(some) for some in lists) for lists in found)


def _hits(sim: np.ndarray, least: np.ndarray, k: int, error: float, axis: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places in them (columns and places, by axis 0) of similarities that are not below the row's least by more than the error; where they are many, nor below the k-th of the row."""
    bar = (least - error).astype(np.float32)
    some = np.flatnonzero(np.fmax.reduce(sim, axis) >= bar) if sim.size else np.zeros(0, np.int64)
    sim = sim[some] if axis else np.ascontiguousarray(sim[:, some].T)
    hits = np.flatnonzero(sim >= bar[some, None])
    if len(hits) > 4 * k * len(some) and sim.shape[1] > k:
        reached = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
        hits = np.flatnonzero(sim >= (np.maximum(least[some], reached.astype(np.float64)) - error)[:, None])
    row, place = np.divmod(hits, max(sim.shape[1], 1))
    return some[row], place


def _told(queries: tuple, vectors: tuple, row: np.ndarray, column: np.ndarray, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows those with similarities, in double precision, that are not below the query's least, k of each query at most; ``best`` takes them in."""
    (x, long, _), (y, wide, _) = queries, vectors
    exact = np.zeros(len(row))
    for i in range(0, len(row), PAIRS):
        one, other = row[i : i + PAIRS], column[i : i + PAIRS]
        exact[i : i + PAIRS] = np.round(np.einsum("ij,ij->i", x[one] / long[one], y[other] / wide[other]), 12)
    keep = exact >= best[row, 0]
    row, column, exact = row[keep], column[keep], exact[keep]
    order = np.lexsort((column, -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column, exact, place = (a[place < k] for a in (row, column, exact, place))
    asked, of = np.unique(row, return_inverse=True)
    more = np.full((len(asked), k), -np.inf)
    more[of, place] = exact
    best[asked] = np.sort(np.concatenate([best[asked], more], axis=1), axis=1)[:, k:]
    return row, column, exact


def _fold_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is an ASCII letter and marks, and these letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and all(unicodedata.combining(m) for m in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLD = _fold_table()


def fts_tokens(text: Column | str) -> Column:
    """Lower-case tokens without diacritics."""
    text = X.col(text)
    return X.tokens(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, *_FOLD)))  # ASCII alone has no diacritics


def escape_query(text: Column | str) -> Column:
    """The query as an OR of quoted words."""
    quoted = F.transform(F.filter(F.transform(X.words(text), lambda w: F.replace(w, F.lit('"'))), lambda w: w != ""), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    return F.array_join(quoted, " OR ")


def searchable(memories: DataFrame) -> DataFrame:
    """id and the tokens of all searched fields, in order."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("content", "summary")] + [F.array_join(F.coalesce(F.col(c), F.array()), " ") for c in ("tags", "entities")]
    return memories.select("id", fts_tokens(F.concat_ws(" ", *fields)).alias("tokens"))


def keyword(queries: DataFrame, memories: DataFrame, k: int, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query id, id, score and rank by BM25 of an OR of the query's words.

    A word of several tokens is a phrase. Each word of the query counts, repeated
    ones too. Documents are tokenised once: their tokens meet the phrases of all
    queries, and counts by phrase and document are settled before they are weighed.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.explode(X.words(query)).alias("word"))
    asked = asked.select("q", fts_tokens("word").alias("parts")).filter(F.size("parts") > 0)
    asked = settle(asked.groupBy("q", F.array_join("parts", " ").alias("phrase")).agg(F.count("*").alias("times")))
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = _scored(asked, searchable(memories), k, query_id)
    else:
        found = _joined(asked, queries, memories, query_id)
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _trie(phrases: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all phrases; sorted steps (node times the number of tokens, plus token), the node of each step, and the phrase that ends at each node, or -1."""
    parts = [p.split(" ") for p in phrases]
    tokens = sorted({t for p in parts for t in p})
    number = {t: i for i, t in enumerate(tokens)}
    steps: dict[int, int] = {}
    ends = {}
    for i, p in enumerate(parts):
        node = 0
        for t in p:
            node = steps.setdefault(node * len(tokens) + number[t], len(steps) + 1)
        ends[node] = i
    keys = np.array(sorted(steps), np.int64)
    return tokens, keys, np.array([steps[x] for x in keys.tolist()], np.int64), np.array([ends.get(i, -1) for i in range(len(steps) + 1)], np.int64)


def _scored(asked: DataFrame, tokens: DataFrame, k: int, query_id: str) -> DataFrame:
    """query id, id and score: of each block of documents the best k by score, for queries that fit in a broadcast.

    A task finds all phrases in its documents at once; then weights of documents by phrases meet those of phrases by queries in matrix products.
    """
    spark = asked.sparkSession
    sound(spark)
    rows = asked.toArrow()  # BROADCAST_ROWS rows at most
    coded, terms = rows["phrase"].combine_chunks().dictionary_encode(), rows["q"].combine_chunks().dictionary_encode()
    phrases, queries, times = coded.dictionary.to_pylist(), terms.dictionary, rows["times"].to_numpy()
    phrase, asker = (x.indices.to_numpy().astype(np.int64) for x in (coded, terms))
    trie = spark.sparkContext.broadcast(_trie(phrases))
    id_type, q_type = (df.schema[c].dataType.simpleString() for df, c in ((tokens, "id"), (asked, "q")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, nodes, ends = trie.value
        width, known = len(known), pa.array(known, pa.string())
        for batch in batches:
            words = batch.column(1).flatten().dictionary_encode()
            number = pc.fill_null(pc.index_in(words.dictionary.cast(pa.string()), known), -1).to_numpy().astype(np.int64)
            token = number[words.indices.to_numpy()]
            sizes = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at, node, depth, hits = np.arange(len(token)), np.zeros(len(token), np.int64), 0, [np.zeros((2, 0), np.int64)]
            while len(at) and len(keys):
                step = node * width + token[at + depth]
                found = np.minimum(np.searchsorted(keys, step), len(keys) - 1)
                go = (keys[found] == step) & (token[at + depth] >= 0)
                at, node, depth = at[go], nodes[found[go]], depth + 1
                hits.append(np.stack([row[at], ends[node]])[:, ends[node] >= 0])
                more = at + depth < len(token)
                more[more] &= row[at[more] + depth] == row[at[more]]
                at, node = at[more], node[more]
            pair, tf = np.unique(np.concatenate(hits, axis=1).T @ np.array([len(ends), 1]), return_counts=True)
            bounds = np.searchsorted(pair, np.arange(len(sizes) + 1) * len(ends))
            many = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), many(pair % len(ends)), many(tf)], ["id", "dl", "phrase", "tf"])

    counted = settle(tokens.select("id", "tokens").mapInArrow(count, f"id {id_type}, dl bigint, phrase array<int>, tf array<int>"))
    n, mean = counted.agg(F.count("*"), F.avg("dl")).head()
    df = np.zeros(len(phrases))
    for p, c in counted.select(F.explode("phrase").alias("p")).groupBy("p").count().collect():
        df[p] = c
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    shared = spark.sparkContext.broadcast((phrase, asker, times * idf[phrase], queries))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase, asker, weight, queries = shared.value
        blocks = []
        for first in range(0, len(queries), ROWS):
            mine = np.flatnonzero((asker >= first) & (asker < first + ROWS))
            used, column = np.unique(phrase[mine], return_inverse=True)
            wanted = np.zeros((len(used), min(ROWS, len(queries) - first)))
            wanted[column, asker[mine] - first] = weight[mine]
            blocks.append((first, used, wanted, np.zeros(wanted.shape[1])))
        some = max(16, min(4 * ROWS, WEIGHTS // max((len(used) for _, used, _, _ in blocks), default=1)))
        for batch in (whole.slice(at, some) for whole in batches for at in range(0, whole.num_rows, some)):
            table = pa.Table.from_batches([batch]).sort_by("id")
            dl = table["dl"].to_numpy()
            lists = [table[c].combine_chunks() for c in ("phrase", "tf")]
            row = np.repeat(np.arange(len(dl)), lists[0].value_lengths().to_numpy())
            found, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            part = tf * (C.K1 + 1) / (tf + C.K1 * (1 - C.B + C.B * dl[row] / (mean or 1)))
            for first, used, wanted, bar in blocks:
                place = np.minimum(np.searchsorted(used, found), len(used) - 1)
                on = used[place] == found
                weights = np.zeros((len(dl), len(used)))
                weights[row[on], place[on]] = part[on]
                scores = weights @ wanted
                take = min(k, len(scores))
                if take == k:  # k documents have the bar's score at least; what is below it by more than rounding is none of the best
                    np.maximum(bar, np.partition(scores, len(scores) - take, axis=0)[len(scores) - take], out=bar)
                column, document = np.nonzero(((scores > 0) & (scores >= bar - 1e-8)).T)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(first + column)), table["id"].take(pa.array(document)).combine_chunks(), pa.array(scores[document, column])], [query_id, "id", "score"])

    return counted.mapInArrow(score, f"{query_id} {q_type}, id {id_type}, score double")


def _joined(asked: DataFrame, queries: DataFrame, memories: DataFrame, query_id: str) -> DataFrame:
    """query id, id and score of all that share a phrase, by joins, for queries of any number."""
    phrases = asked.select("phrase").distinct().withColumn("parts", F.split("phrase", " "))
    phrases = phrases.union(queries.sparkSession.range(1).select(F.lit(_WHOLE).alias("phrase"), F.array(F.lit(_WHOLE)).alias("parts")))
    parts = phrases.select("phrase", F.size("parts").alias("m"), F.posexplode("parts").alias("j", "token"))
    tokens = searchable(memories).select("id", F.size("tokens").alias("dl"), F.posexplode(F.concat("tokens", F.array(F.lit(_WHOLE)))).alias("place", "token"))
    start = F.when(F.col("m") == 1, 0).otherwise(F.col("place") - F.col("j"))
    met = tokens.join(parts, "token").groupBy("phrase", "id", "dl", "m", start.alias("start")).agg(F.count("*").alias("n"))
    tf = met.filter((F.col("m") == 1) | (F.col("n") == F.col("m"))).groupBy("phrase", "id", "dl").agg(F.sum(F.when(F.col("m") == 1, F.col("n")).otherwise(1)).alias("tf"))
    tf = settle(tf)
    whole = tf.filter(F.col("phrase") == _WHOLE).agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    tf = tf.filter(F.col("phrase") != _WHOLE)
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("times") * idf * F.col("tf") * (C.K1 + 1) / (F.col("tf") + C.K1 * (1 - C.B + C.B * F.col("dl") / F.col("avgdl")))
    weighed = asked.join(df, "phrase").join(F.broadcast(whole))  # whole is one row
    return tf.join(weighed, "phrase").groupBy(F.col("q").alias(query_id), "id").agg(F.sum(weight).alias("score"))


def fuse(lists: list[DataFrame], k: int = 60, query_id: str = "query_id") -> DataFrame:
    """query id, id, base: the sum of 1 / (k + rank) over lists with ranks from 1."""
    parts = [x.select(query_id, "id", (1.0 / (F.lit(float(k)) + F.col("rank"))).alias("part")) for x in lists]
    sound(parts[0].sparkSession)
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(query_id, "id").agg(F.sum("part").alias("base"))


def pool_size(limit: int, factor: int = 4) -> int:
    return max(limit * max(factor, 1), 10)


def metadata_score(base: Column | str, as_of: str) -> Column:
    """The base score raised by recency, importance and confidence, and a little by use."""
    days = F.greatest(F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400), F.lit(0))
    recency = 1 / (1 + days / C.RECENCY_DAYS)
    boost = 1 + C.RECENCY_WEIGHT * recency + C.IMPORTANCE_WEIGHT * F.col("importance") + C.CONFIDENCE_WEIGHT * F.col("confidence")
    return X.col(base) * boost + C.ACCESS_WEIGHT * F.log(1 + F.col("access_count").cast("double"))


def lexical(pool: DataFrame, queries: DataFrame, weight: float = 0.5, query_id: str = "query_id") -> DataFrame:
    """Replaces ``score`` in a pool of candidates by a mix of its own share and that of BM25 within the pool.

    A query without terms, or with one candidate, keeps its scores.
    """
    weight = min(max(weight, 0.0), 1.0)
    per = Window.partitionBy(query_id)
    asked = queries.select(query_id, X.terms("query").alias("_q"))
    words = X.terms(F.concat_ws(" ", "content", "headline", F.array_join("tags", " ")))
    rows = pool.join(asked, query_id).withColumn("_t", words).withColumn("_dl", F.size("_t"))
    rows = rows.withColumn("_n", F.count("*").over(per)).withColumn("_avg", F.greatest(F.avg("_dl").over(per), F.lit(1.0)))
    counted = F.transform("_q", lambda q: F.struct(q.alias("term"), F.size(F.filter("_t", lambda t: t == q)).alias("tf")))
    hits = rows.select(query_id, "id", "_dl", "_n", "_avg", F.explode(F.filter(counted, lambda p: p["tf"] > 0)).alias("p")).select("*", "p.term", "p.tf")  # counts move, tokens stay
    df = rows.select(query_id, F.explode(F.array_intersect("_q", "_t")).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (C.K1 + 1) / (F.col("tf") + C.K1 * (1 - C.B + C.B * F.col("_dl") / F.col("_avg")))
    lex = hits.join(df, [query_id, "term"]).groupBy(query_id, "id").agg(F.sum(part).alias("_lex"))
    rows = rows.join(lex, [query_id, "id"], "left").withColumn("_lex", F.coalesce("_lex", F.lit(0.0)))
    share = lambda c: F.col(c) / F.greatest(F.max(c).over(per), F.lit(1e-6))
    mixed = weight * share("_lex") + (1 - weight) * share("score")
    rows = rows.withColumn("_new", F.when((F.size("_q") > 0) & (F.col("_n") > 1), mixed).otherwise(F.col("score")))
    return rows.withColumn("score", F.col("_new")).drop("_q", "_t", "_dl", "_n", "_avg", "_lex", "_new")


def ranked(pool: DataFrame, limit: int, query_id: str = "query_id", score: str = "score") -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round(score, 12)), "id")
    return pool.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
