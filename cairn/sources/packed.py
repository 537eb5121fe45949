"""Packed vector files as a data source: each task reads a part of a file and writes files of its own.

A file is a magic, the width (u32) and the number of rows (u64), then of each row the length of
its id (u16), the id and the width's little-endian floats. A path is a file or a folder
of them. The offsets that a writer leaves beside its file (``.offsets``: the rows between two, then
each) tell where parts begin. A file without them is one part, unless its size is that of
rows as long as the first, as ids of one length give: then it is split by their number, and that size
is checked at each row. A part is read in pieces of bounded size, and none goes through the driver,
which looks at headers and offsets alone.

A writing task cuts its rows into files of FILE_BYTES; they are written aside and get their
names when all tasks are done, so that a failed job leaves nothing and a task that ran twice counts once.

Cases: an empty table is a folder with a file of no rows, and so is one whose vectors are all null;
rows without id or vector are left out; a vector of another width than the first (or than the
option ``dim``) is an error, as are another magic and a file that ends within a row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cairn.functions import values as C

HEAD = 16
#: Rows between two offsets that are kept, bytes of a part, of a read and of a file.
STRIDE, PART_BYTES, READ_BYTES, FILE_BYTES = 1 << 12, 64 << 20, 4 << 20, 256 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _head(raw: bytes) -> tuple[int, int]:
    if raw[:4] != C.VECTOR_MAGIC or len(raw) < HEAD:
        raise ValueError("not a vector file")
    return struct.unpack_from("<IQ", raw, 4)


@dataclass
class Part(InputPartition):
    """``rows`` rows of a file from an offset on; ``size`` bytes each if they must all have that size."""

    path: str
    dim: int
    start: int
    rows: int
    size: int | None

    def __init__(self, path: str, dim: int, start: int, rows: int, size: int | None):
        super().__init__((path, dim, start, rows, size))
        self.path, self.dim, self.start, self.rows, self.size = path, dim, start, rows, size


def _batch(ids: list[bytes], vectors: list[bytes] | np.ndarray, dim: int) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(vectors), "<f4") if isinstance(vectors, list) else vectors.ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), pa.array(flat, pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([i.decode() for i in ids], pa.string()), lists], ["id", "embedding"])


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.part = options["path"], int(options.get("partbytes", PART_BYTES))
        self.varying = options.get("rows") == "varying"

    def partitions(self) -> list[Part]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        found = system.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._" and not f.base_name.endswith(".offsets"))
        out = [p for path, size in files for p in self._parts(system, path, size)]
        return out or [Part(root, 0, HEAD, 0, None)]

    def _parts(self, system: fs.FileSystem, path: str, size: int) -> Iterator[Part]:
        with system.open_input_file(path) as f:
            dim, count = _head(f.read_at(HEAD, 0))
            first = struct.unpack("<H", f.read_at(2, HEAD))[0] if count else 0
        each = 2 + first + 4 * dim
        if not count:
            return
        beside = f"{path}.offsets"
        if system.get_file_info(beside).type != fs.FileType.File:
            if self.varying or HEAD + count * each != size:
                yield Part(path, dim, HEAD, count, None)
                return
            step = max(1, self.part // each)
            for at in range(0, count, step):
                yield Part(path, dim, HEAD + at * each, min(step, count - at), each)
            return
        with system.open_input_file(beside) as f:
            stride, *offsets = np.frombuffer(f.read(), "<u8").tolist()
        begin = 0
        for i in range(1, len(offsets) + 1):
            if i == len(offsets) or offsets[i] - offsets[begin] >= self.part:
                yield Part(path, dim, offsets[begin], min(count, i * stride) - begin * stride, None)
                begin = i

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start)
            yield from self._sized(f, partition) if partition.size else self._stepped(f, partition)

    @staticmethod
    def _sized(f: Any, part: Part) -> Iterator[pa.RecordBatch]:
        size, width = part.size or 0, (part.size or 0) - 2 - 4 * part.dim
        step = max(1, READ_BYTES // size)
        for at in range(0, part.rows, step):
            n = min(step, part.rows - at)
            raw = np.frombuffer(f.read(n * size), np.uint8)
            if len(raw) != n * size:
                raise ValueError("the file ends within a row")
            rows = raw.reshape(n, size)
            if (rows[:, 0].astype(int) + 256 * rows[:, 1].astype(int) != width).any():
                raise ValueError("rows of other sizes than the first; read them with the option rows=varying")
            ids = np.ascontiguousarray(rows[:, 2 : 2 + width])
            names = [ids[i].tobytes() for i in range(n)]
            yield _batch(names, np.ascontiguousarray(rows[:, 2 + width :]).view("<f4"), part.dim)

    @staticmethod
    def _stepped(f: Any, part: Part) -> Iterator[pa.RecordBatch]:
        left, raw, at = part.rows, b"", 0
        ids: list[bytes] = []
        vectors: list[bytes] = []
        while left:
            need = 2 if len(raw) - at < 2 else 2 + int.from_bytes(raw[at : at + 2], "little") + 4 * part.dim
            if len(raw) - at < need:
                more = f.read(max(READ_BYTES, need))
                if not more:
                    raise ValueError("the file ends within a row")
                raw, at = raw[at:] + more, 0
                if ids:
                    yield _batch(ids, vectors, part.dim)
                    ids, vectors = [], []
                continue
            if need == 2:
                need = 2 + int.from_bytes(raw[at : at + 2], "little") + 4 * part.dim
                if len(raw) - at < need:
                    continue
            name = need - 4 * part.dim
            ids.append(raw[at + 2 : at + name])
            vectors.append(raw[at + name : at + need])
            at, left = at + need, left - 1
        if ids:
            yield _batch(ids, vectors, part.dim)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task that have no names yet, and their rows and width."""

    files: list[str]
    rows: int
    dim: int | None


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.dim = int(options["dim"]) if "dim" in options else None
        self.most, self.stride = int(options.get("filebytes", FILE_BYTES)), int(options.get("stride", STRIDE))
        self.aside = f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(f"{root}/{self.aside}", recursive=True)
        files: list[str] = []
        dim, total = self.dim, 0
        held: list[bytes] = []
        offsets, size = [], HEAD

        def flush() -> None:
            nonlocal held, offsets, size
            if held:
                name = uuid.uuid4().hex
                with system.open_output_stream(f"{root}/{self.aside}/{name}") as f:
                    f.write(C.VECTOR_MAGIC + struct.pack("<IQ", dim, len(held)))
                    for row in held:
                        f.write(row)
                with system.open_output_stream(f"{root}/{self.aside}/{name}.offsets") as f:
                    f.write(np.array([self.stride, *offsets], "<u8").tobytes())
                files.append(name)
            held, offsets, size = [], [], HEAD

        for batch in iterator:
            batch = batch.select(["id", "embedding"])
            vectors = batch.column(1)
            good = np.flatnonzero(~(np.asarray(batch.column(0).is_null()) | np.asarray(vectors.is_null())))
            ids, lists = batch.column(0).take(pa.array(good)).to_pylist(), vectors.take(pa.array(good))
            sizes = np.asarray(lists.value_lengths()).astype(int)
            flat = np.asarray(lists.flatten().cast(pa.float32()).fill_null(np.nan)).astype("<f4")
            if len(sizes) and dim is None:
                dim = int(sizes[0])
            if (sizes != dim).any():
                raise ValueError(f"a vector of another width than {dim}")
            for i, name in enumerate(ids):
                key = name.encode()
                row = struct.pack("<H", len(key)) + key + flat[i * dim : (i + 1) * dim].tobytes()
                if len(held) % self.stride == 0:
                    offsets.append(size)
                held.append(row)
                size += len(row)
                total += 1
                if size >= self.most:
                    flush()
        flush()
        return Written(files, total, dim)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        widths = {m.dim for m in messages if m and m.rows}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError("vectors of several widths")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.File:
                    system.delete_file(old.path)
        names = [n for m in messages if m for n in m.files]
        for name in names:
            system.move(f"{root}/{self.aside}/{name}.offsets", f"{root}/{name}.bin.offsets")
            system.move(f"{root}/{self.aside}/{name}", f"{root}/{name}.bin")
        if not names:
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/none.bin") as f:
                f.write(C.VECTOR_MAGIC + struct.pack("<IQ", self.dim or 0, 0))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        if system.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.aside}")


class PackedVectors(DataSource):
    """``spark.read.format("packed_vectors").load(path)`` and ``df.write.format("packed_vectors").save(path)``; options partBytes, fileBytes, stride, dim."""

    @classmethod
    def name(cls) -> str:
        return "packed_vectors"

    def schema(self) -> str:
        return "id string, embedding array<float>"

    def reader(self, schema: Any) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)
