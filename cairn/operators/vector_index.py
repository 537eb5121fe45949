"""A kept vector index: cells around centroids, exact search by the triangle inequality.

Centroids are fitted to at most SAMPLE vectors, chosen by the hashes of their ids; every row is in
the cell of its nearest centroid, in blocks of bounded size, and a commit says how far a
cell's rows are from its centroid at most. An insertion writes blocks of the cells that it touches,
a deletion the places of dead rows; ``rebuild`` fits and deals anew once much has changed.

A search measures the angles between queries and centroids. The nearest PROBE cells of a query come first
and give its k-th best similarity; then all other cells whose rows may be that near, as
no row of a cell is nearer than the angle to the centroid less the cell's radius. So
results are those of a full scan, on any data; how many cells that takes depends on the data, and
``report`` tells. Queries meet blocks on the number of the cell, and cells of many blocks are dealt out,
so no task holds a cell.

Cases: null, empty and zero vectors and those of another length than the index's are similar to all by 0,
as in a scan; they are in a cell of their own. Ties go to the smaller id. Ids are distinct within a commit. An empty index gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.kept import Kept
from cairn.operators.search import rounded
from cairn.sources.shared import forget, settle

#: Vectors that centroids are fitted to, cells, steps of the fit, vectors of a block, blocks of one deal, queries of a block, cells that are read first.
SAMPLE, CELLS, STEPS, BLOCK, DEAL, QUERIES, PROBE = 1 << 14, 1 << 10, 8, 1 << 10, 16, 256, 2
#: Tasks that write one cell at most.
SALT = 4
#: The cell of vectors that are similar to none.
ODD = -1
#: More than rounding may change an angle's cosine.
SLACK = 1e-7
#: Changes since the fit, as a share of the rows, at which a rebuild is due.
DRIFT = 0.5
_BLOCKS = "cell int, block string, ids array<string>, body binary, radius double"
_DEAD = "segment string, block string, row int"
_EMPTY = {"segments": [], "dead": [], "width": 0, "centroids": [], "cells": {}, "rows": 0, "changed": 0, "synced": 0}


def _fold(state: dict[str, Any], version: int, entry: dict[str, Any]) -> dict[str, Any]:
    if entry["op"] == "rebuild":
        return {**_EMPTY, **{k: v for k, v in entry.items() if k != "op"}, "synced": state["synced"]}
    cells = dict(state["cells"])
    for cell, (blocks, radius) in entry["cells"].items():
        had = cells.get(cell, [0, 0.0])
        cells[cell] = [had[0] + blocks, max(had[1], radius)]
    return {
        **state, "segments": state["segments"] + entry["segments"], "dead": state["dead"] + entry["dead"], "cells": cells, "rows": state["rows"] + entry["rows"],
        "changed": state["changed"] + entry["changed"], "synced": max(state["synced"], entry.get("synced", 0)),
    }


def units(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the width and a length, and these as unit vectors."""
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(0))
    starts = (np.cumsum(sizes) - sizes)[sizes == width] if width else np.zeros(0, np.int64)
    x = values[starts[:, None] + np.arange(width)]
    length = np.sqrt((x * x).sum(1))
    good = np.zeros(len(sizes), bool)
    good[np.flatnonzero(sizes == width)[length > 0] if width else []] = True
    return good, x[length > 0] / length[length > 0][:, None]


def fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(0)
    centres = distinct[np.sort(rng.choice(len(distinct), min(cells, len(distinct)), replace=False))]
    for _ in range(STEPS):
        of = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        length = np.sqrt((sums * sums).sum(1))
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


def _placed(centres: np.ndarray, width: int):
    """(id, embedding) with the cell of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = units(batch.column(1), width)
            cell = np.full(len(good), ODD, np.int32)
            if len(x):
                cell[good] = (x @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "embedding", "cell"])

    return run


def _blocks(centres: np.ndarray, width: int):
    """Blocks of (id, embedding) by cell: rows of _BLOCKS; a task holds a block of each cell at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[list[str], np.ndarray, float]]] = {}

        def out(cell: int) -> pa.RecordBatch:
            parts = held.pop(cell)
            ids = pa.array([i for p in parts for i in p[0]], pa.string())
            body = np.concatenate([p[1] for p in parts]).astype("<f8").tobytes()
            row = [cell], [uuid.uuid4().hex], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), [body], [max(p[2] for p in parts)]
            kinds = pa.int32(), pa.string(), None, pa.binary(), pa.float64()
            return pa.RecordBatch.from_arrays([v if k is None else pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["cell", "block", "ids", "body", "radius"])

        for batch in batches:
            good, x = units(batch.column(1), width)
            ids = np.array(batch.column(0).to_pylist(), object)
            cosine = x @ centres.T if len(x) else np.zeros((0, 1))
            nearest = cosine.argmax(1)
            angle = np.arccos(np.clip(cosine.max(1), -1, 1))
            cells = [(int(c), ids[good][nearest == c], x[nearest == c], float(angle[nearest == c].max())) for c in np.unique(nearest)]
            if not good.all():
                cells.append((ODD, ids[~good], np.zeros((int((~good).sum()), 0)), 0.0))
            for cell, own, rows, far in cells:
                while len(own):
                    n = BLOCK - sum(len(p[0]) for p in held.get(cell, []))
                    held.setdefault(cell, []).append((own[:n].tolist(), rows[:n], far))
                    own, rows = own[n:], rows[n:]
                    if sum(len(p[0]) for p in held[cell]) >= BLOCK:
                        yield out(cell)
        for cell in list(held):
            yield out(cell)

    return run


def _most(sim: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row that are not below its bar; of equals the earlier columns."""
    keep = sim >= bar
    some = np.flatnonzero(keep.sum(1) > k)
    if len(some):
        least = np.partition(sim[some], sim.shape[1] - k, axis=1)[:, sim.shape[1] - k, None]
        more, level = sim[some] > least, sim[some] == least
        keep[some] &= more | level & (np.cumsum(level, axis=1) <= k - more.sum(1, keepdims=True))
    return np.nonzero(keep)


class VectorIndex(Kept):
    """The index below one folder, which may be on any file system of Spark's. Ids are strings."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, _fold, _EMPTY)

    def _all(self, state: dict[str, Any]) -> DataFrame:
        """Blocks with their segment in ``segment`` and the numbers of their dead rows in ``dead``."""
        blocks = self.rows("cells", state["segments"], _BLOCKS).withColumnRenamed("of", "segment")
        if not state["dead"]:
            return blocks.withColumn("dead", F.array().cast("array<int>"))
        dead = self.rows("dead", state["dead"], _DEAD).groupBy("segment", "block").agg(F.collect_set("row").alias("dead"))  # BLOCK rows at most
        return blocks.join(dead, ["segment", "block"], "left").withColumn("dead", F.coalesce("dead", F.array().cast("array<int>")))

    def _places(self, state: dict[str, Any]) -> DataFrame:
        """id, segment, block, row of living rows."""
        rows = self._all(state).select("segment", "block", "dead", F.posexplode("ids").alias("row", "id"))
        return rows.filter(~F.array_contains("dead", F.col("row"))).select("id", "segment", "block", "row")

    def ids(self) -> DataFrame:
        return self._places(self.state).select("id")

    def _write(self, vectors: DataFrame, centres: np.ndarray, width: int) -> tuple[str | None, int, dict[str, Any]]:
        """Writes rows aside by cell: the segment's name, how many, and blocks and radius by cell."""
        name = uuid.uuid4().hex
        rows = vectors.select(F.col("id").cast("string").alias("id"), "embedding")
        number = vectors.schema["embedding"].dataType.simpleString()
        dealt = rows.mapInArrow(_placed(centres, width), f"id string, embedding {number}, cell int").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SALT)))  # else each task leaves a small block of each cell
        packed = dealt.select("id", "embedding").mapInArrow(_blocks(centres, width), _BLOCKS)
        packed.write.partitionBy("cell").parquet(f"{self.path}/cells/of={name}")
        found = self.rows("cells", [name], _BLOCKS).groupBy("cell").agg(F.count("*").alias("blocks"), F.max("radius").alias("radius"), F.sum(F.size("ids")).alias("n")).collect()  # a row for each cell
        return (name if found else None), sum(r["n"] for r in found), {str(r["cell"]): [r["blocks"], r["radius"]] for r in found}

    def _bury(self, ids: DataFrame, state: dict[str, Any]) -> tuple[str | None, int]:
        """Writes the places of living rows with these ids aside: the deletion's name and how many."""
        name = uuid.uuid4().hex
        self._places(state).join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").drop("id").write.parquet(f"{self.path}/dead/of={name}")
        n = self.rows("dead", [name], _DEAD).count()
        return (name if n else None), n

    def _fitted(self, vectors: DataFrame) -> tuple[np.ndarray, int]:
        """Centroids and the width most sampled vectors have."""
        n = vectors.count()
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()  # SAMPLE rows at most
        sizes = np.asarray(sample.value_lengths().fill_null(0)).astype(np.int64)
        width = int(np.bincount(sizes[sizes > 0]).argmax()) if (sizes > 0).any() else 0
        good, x = units(sample, width)
        return fit(x, min(CELLS, max(1, math.isqrt(n)))) if len(x) else np.zeros((0, width)), width

    # changes

    def rebuild(self, vectors: DataFrame | None = None) -> None:
        """Fits centroids and deals all rows anew: those given, or those of the index."""
        state = self.state
        rows = vectors if vectors is not None else self.vectors(state)
        rows = settle(rows.select("id", "embedding"))
        centres, width = self._fitted(rows)
        name, n, cells = self._write(rows, centres, width)
        forget(rows)
        entry = {"op": "rebuild", "segments": [name] if name else [], "width": width, "centroids": centres.tolist(), "cells": cells, "rows": n}
        if not self.log.put(entry) and vectors is not None:
            raise RuntimeError("the index was changed meanwhile")

    def vectors(self, state: dict[str, Any] | None = None) -> DataFrame:
        """id and (unit) embedding of living rows; of those that are similar to none an empty one."""
        state = state or self.state
        width = state["width"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell, ids, body, dead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    live = np.setdiff1d(np.arange(len(ids)), dead)
                    size = 0 if cell == ODD else width
                    x = np.frombuffer(body, "<f8").reshape(len(ids), size)[live]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(live) + 1) * size, pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in live.tolist()], pa.string()), lists], ["id", "embedding"])

        return self._all(state).select("cell", "ids", "body", "dead").mapInArrow(run, "id string, embedding array<double>")

    def upsert(self, rows: DataFrame, synced: int = 0) -> None:
        """Takes in rows (id, embedding), in place of those of the same ids; the first ones are what the centroids are fitted to."""
        rows = settle(rows.select("id", "embedding"))
        if not self.state["segments"] and not rows.isEmpty():
            self.rebuild(rows)
        centres, width = self._centres(self.state)
        fresh = rows.join(self.ids(), "id", "left_anti") if self.state["changed"] == 0 and self.state["rows"] == rows.count() else rows
        name, n, cells = self._write(fresh, centres, width)

        def made(state: dict[str, Any]) -> dict[str, Any]:
            dead, less = self._bury(fresh, state)
            return {"op": "change", "segments": [name] if name else [], "dead": [dead] if dead else [], "cells": cells, "rows": n - less, "changed": n + less, "synced": synced}

        self.commit(made)
        forget(rows)

    def delete(self, ids: DataFrame) -> int:
        """Takes out the rows with these ids; returns how many there were."""
        gone = 0

        def made(state: dict[str, Any]) -> dict[str, Any] | None:
            nonlocal gone
            dead, gone = self._bury(ids, state)
            return {"op": "change", "segments": [], "dead": [dead], "cells": {}, "rows": -gone, "changed": gone} if dead else None

        self.commit(made)
        return gone

    def due(self) -> bool:
        """Whether so much has changed since the fit that a rebuild would be worth while."""
        state = self.state
        return state["changed"] > DRIFT * max(1, state["rows"])

    # search

    @staticmethod
    def _centres(state: dict[str, Any]) -> tuple[np.ndarray, int]:
        return np.array(state["centroids"], float).reshape(-1, state["width"]), state["width"]

    def _asked(self, queries: DataFrame, state: dict[str, Any], first: bool, k: int, digits: int = 12) -> DataFrame:
        """Queries in packed blocks by cell and deal: those of the cells that are read first, or of the others that may hold one of the k best (by ``bar``)."""
        centres, width = self._centres(state)
        known = sorted(int(c) for c in state["cells"])
        radius = np.array([state["cells"][str(c)][1] for c in known])
        deals = {c: -(-state["cells"][str(c)][0] // DEAL) for c in known}
        named = np.array([c for c in known if c != ODD], np.int64)
        slack = SLACK + 0.5 / 10.0**digits  # a bar is rounded

        def cells(x: np.ndarray, bar: np.ndarray) -> np.ndarray:
            """Queries (rows) by known cells (columns) to be read."""
            angle = np.arccos(np.clip(x @ centres[named].T, -1, 1))
            bound = np.ones((len(x), len(known)))
            bound[:, [c != ODD for c in known]] = np.cos(np.maximum(angle - radius[[c != ODD for c in known]] - SLACK, 0)) + SLACK
            bound[:, [c == ODD for c in known]] = 0.0
            near = np.zeros_like(bound, bool)
            if len(named):
                take = np.argsort(angle, axis=1, kind="stable")[:, :PROBE]
                near[np.arange(len(x))[:, None], np.flatnonzero([c != ODD for c in known])[take]] = True
            return near if first else ~near & (bound >= bar[:, None] - slack)

        kind = queries.schema["q"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, x = units(batch.column(1), width)
                bar = np.asarray(batch.column(2).fill_null(-np.inf)).astype(float)
                want = np.zeros((batch.num_rows, len(known)), bool)
                want[good] = cells(x, bar[good])
                want[~good] = not first  # similar to all by 0
                whole = np.zeros((batch.num_rows, width))
                whole[good] = x
                for j, c in enumerate(known):
                    at = np.flatnonzero(want[:, j])
                    for i in range(0, len(at), QUERIES):
                        part = at[i : i + QUERIES]
                        ids = batch.column(0).take(pa.array(part))
                        n = deals[c]
                        one = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids)
                        yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.concat_arrays([one] * n), *(pa.array([a[part].tobytes()] * n, pa.binary()) for a in (whole, bar))], ["cell", "deal", "qs", "x", "bars"])

        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("deal", T.IntegerType()), T.StructField("qs", T.ArrayType(kind)), T.StructField("x", T.BinaryType()), T.StructField("bars", T.BinaryType())])
        return queries.select("q", "embedding", "bar").mapInArrow(run, schema)

    def _scored(self, asked: DataFrame, state: dict[str, Any], k: int, digits: int = 12) -> DataFrame:
        """q, id and sim of the k best of each block for each query, of those that are not below its bar."""
        width, kind = state["width"], asked.schema["qs"].dataType.elementType
        most = {int(c): -(-b // DEAL) for c, (b, _) in state["cells"].items()}
        deals = F.coalesce(*(F.when(F.col("cell") == c, n) for c, n in most.items() if n > 1), F.lit(1))
        blocks = self._all(state).withColumn("deal", F.pmod(F.xxhash64("block"), deals.cast("long")).cast("int"))
        met = asked.join(blocks.select("cell", "deal", "ids", "body", "dead"), ["cell", "deal"]).select("cell", "qs", "x", "bars", "ids", "body", "dead")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    cell, qs, x, bars, ids, body, dead = (c[i] for c in batch.columns)
                    own = ids.values
                    x = np.frombuffer(x.as_py(), float).reshape(len(qs.values), width)
                    y = np.frombuffer(body.as_py(), "<f8").reshape(len(own), -1) if cell.as_py() != ODD else np.zeros((len(own), width))
                    sim = rounded(x @ y.T, digits)
                    bar = np.frombuffer(bars.as_py(), float)[:, None]
                    if not (sim >= bar).any():
                        continue
                    live = np.ones(len(own), bool)
                    live[dead.values.to_numpy() if dead.is_valid else []] = False
                    order = pc.sort_indices(own).to_numpy()  # by id, so that ties go to the smaller
                    order = order[live[order]]
                    row, column = _most(sim[:, order], bar, k)
                    yield pa.RecordBatch.from_arrays([qs.values.take(pa.array(row)), own.take(pa.array(order[column])), pa.array(sim[row, order[column]])], ["q", "id", "sim"])

        return met.mapInArrow(run, T.StructType([T.StructField("q", kind), T.StructField("id", T.StringType()), T.StructField("sim", T.DoubleType())]))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", digits: int = 12) -> DataFrame:
        """query id, id, sim and rank of the k most similar rows, as ``search.nearest`` of the indexed rows gives them, rounded to so many digits."""
        state = self.state
        asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("embedding"), F.lit(None).cast("double").alias("bar"))
        if not state["cells"]:
            return self.spark.createDataFrame([], T.StructType([T.StructField(query_id, asked.schema["q"].dataType), *T.StructType.fromDDL("id string, sim double, rank int").fields]))
        order = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
        best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        first = settle(best(self._scored(self._asked(asked, state, True, k, digits), state, k, digits)))
        bars = first.filter(F.col("rank") == k).select("q", F.col("sim").alias("bar"))
        rest = self._asked(asked.drop("bar").join(bars, "q", "left"), state, False, k, digits)
        found = first.drop("rank").unionByName(self._scored(rest, state, k, digits))
        return best(found).select(F.col("q").alias(query_id), "id", "sim", "rank")

    def report(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding") -> dict[str, int]:
        """Pairs of queries and cells that a search reads, and that there are."""
        state = self.state
        asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("embedding"), F.lit(None).cast("double").alias("bar"))
        bars = self.search(queries, k, query_id, vector).groupBy(F.col(query_id).alias("q")).agg(F.min(F.when(F.col("rank") == k, F.col("sim"))).alias("bar"))
        pairs = lambda rows: rows.filter("deal = 0").agg(F.coalesce(F.sum(F.size("qs")), F.lit(0))).head()[0]
        read = pairs(self._asked(asked, state, True, k)) + pairs(self._asked(asked.drop("bar").join(bars, "q", "left"), state, False, k))
        return {"read": read, "all": queries.count() * len(state["cells"])}
