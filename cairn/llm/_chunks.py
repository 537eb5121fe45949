"""Chunks of a table, and exchanges between chunks and hash buckets.

A chunk is a row that holds a bounded slice of the table, all its columns, as
compressed Arrow. Chunks are written to the shared checkpoint folder, so each
later pass sees the same ones, on whichever executor. A pass turns every chunk
into one packed row for each hash bucket; a bucket answers each chunk with one
packed row; the answers go back by chunk. The rows of an exchange are counted
in chunks times buckets, not in words or bytes of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import _vector as V
from cairn.llm._spark import BUCKET_BYTES, buckets, settle

#: Rows and bytes of text of one chunk, unless one text alone is longer.
CHUNK_ROWS, CHUNK_BYTES = 256, 1 << 20
_MESSAGE = "bucket int, chunk long, body binary"
_squeeze = zstandard.ZstdCompressor(level=1)
_expand = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; sorted unsigned arrays get small as differences, byte plane by byte plane."""
    out = []
    for a in arrays:
        kind = a.dtype.kind.encode() + bytes([a.dtype.itemsize])
        if a.dtype.kind == "u" and a.ndim == 1 and a.dtype.itemsize > 1 and len(a) and (a[1:] >= a[:-1]).all():
            kind = b"d" + kind[1:]
            a = np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, a.dtype.itemsize).T
        body = np.ascontiguousarray(a).tobytes()
        out.append(kind + len(body).to_bytes(8, "little") + body)
    return _squeeze.compress(b"".join(out))


def unpack(body: bytes) -> list[np.ndarray]:
    raw, at, out = _expand.decompress(body), 0, []
    while at < len(raw):
        kind, size, n = raw[at : at + 1], raw[at + 1], int.from_bytes(raw[at + 2 : at + 10], "little")
        part = raw[at + 10 : at + 10 + n]
        at += 10 + n
        if kind == b"d":
            a = np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(size, -1).T).view(f"<u{size}")[:, 0]
            out.append(np.cumsum(a, dtype=a.dtype))
        else:
            out.append(np.frombuffer(part, np.dtype(kind.decode() + str(size))))
    return out


class Chunk:
    """A slice of the table with what every pass needs of it."""

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str):
        self.batch = batch
        self.data, self.offsets = V.buffers(batch.column(batch.schema.get_field_index(text_col)))
        ids = batch.column(batch.schema.get_field_index(id_col))
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.cast(pa.int64()).fill_null(0)).astype(np.int64)


def make(df: DataFrame, text_col: str = "text", join: int = 1) -> DataFrame:
    """chunk long, body binary; settled. A chunk is up to ``join`` slices of CHUNK_ROWS and CHUNK_BYTES, at most join * CHUNK_BYTES if there are more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
        held, size = [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for part in held:
                    writer.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                for part in V.slices(batch.slice(at, CHUNK_ROWS), text_col, CHUNK_BYTES):
                    more = part.column(part.schema.get_field_index(text_col)).nbytes
                    if held and (len(held) == join or size + more > join * CHUNK_BYTES):
                        yield out()
                        held, size, count = [], 0, count + 1
                    held.append(part)
                    size += more
        if held:
            yield out()

    return settle(df.mapInArrow(run, "chunk long, body binary"))


def buckets_for(chunks: DataFrame, per_bucket: int = BUCKET_BYTES) -> int:
    """As many buckets as the chunks' bytes ask for."""
    return buckets(chunks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).head()[0], per_bucket)


def _open(body: bytes, id_col: str, text_col: str) -> Chunk:
    with pa.ipc.open_stream(body) as reader:
        return Chunk(pa.RecordBatch.from_struct_array(pa.concat_arrays([b.to_struct_array() for b in reader])), id_col, text_col)


def send(chunks: DataFrame, features: Callable[..., Iterator[tuple[int, bytes]]], id_col: str, text_col: str) -> DataFrame:
    """A message of each chunk to every bucket that ``features(chunk, answers)`` names."""
    answered = "answers" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column(2).to_pylist() if answered else [None] * batch.num_rows
            for number, body, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), answers, strict=True):
                rows = list(features(_open(body, id_col, text_col), answer or []))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([m for _, m in rows], pa.binary())], ["bucket", "chunk", "body"])

    return chunks.select("chunk", "body", *["answers"] * answered).mapInArrow(run, _MESSAGE)


def answer(messages: DataFrame, count: int, judge: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Deals the messages out, a bucket a task; ``judge`` sees all of one bucket and answers each, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, bodies = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            said = [(n, a) for n, a in zip(numbers, judge(bodies), strict=True) if a is not None] if bodies else []
            if said:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(said), pa.int32()), pa.array([n for n, _ in said], pa.int64()), pa.array([a for _, a in said], pa.binary())], ["bucket", "chunk", "body"])

        for batch in batches:
            for bucket, number, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != key:
                    yield from out()
                    key, numbers, bodies = bucket, [], []
                numbers.append(number)
                bodies.append(body)
        yield from out()

    return messages.repartitionById(count, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, _MESSAGE)


def back(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with all their answers as ``answers``, an array of (phase, bucket, body)."""
    if "phase" not in answers.columns:
        answers = answers.withColumn("phase", F.lit(1))
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct("phase", "bucket", "body")).alias("answers"))
    return chunks.join(grouped.hint("shuffle_hash"), "chunk", "left").select("chunk", "body", "answers")


def finish(chunks: DataFrame, apply: Callable[..., pa.RecordBatch], schema, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``apply(chunk, answers)`` of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, answers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield apply(_open(body, id_col, text_col), answers or [])

    return chunks.mapInArrow(run, schema)


def by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted 64-bit keys, where each bucket (their top bits) begins and ends; buckets without keys have equal bounds."""
    if not bits:
        return np.array([0]), np.array([len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    cuts = np.searchsorted(keys, edges)
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


def covered(hits: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n items that lies in a window of that width from one of the hits."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, hits, 1)
    np.add.at(step, np.minimum(hits + width, n), -1)
    return np.cumsum(step[:n]) > 0
