"""Byte-level BPE encoding and decoding.

Each pre-token is a row of parts over its byte positions. A segment tree over
these positions holds, at its root, the least pair rank and the leftmost place
that has it. A merge renames one part, removes its right neighbour and makes
three point updates of logarithmic cost. Trees of many pre-tokens of a like
length are rows of one array, so each round merges once in every row.

Cases: null text counts as empty; an empty text has no ids; repeated rows and
ties of ids are encoded row by row; an empty table gives an empty table; other
columns are kept by ``encode`` and ``decode`` (they must not be called
``token_ids`` or ``decoded``, else the old column is replaced). Memory follows
the longest single text and ``CACHE_WORDS``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cairn.llm import _vector as V
from cairn.llm._spark import read_once

#: Pre-tokens whose ids a worker remembers between slices; on overflow it starts anew.
CACHE_WORDS = 200_000
#: Longer pre-tokens get a tree of their own.
LONG = 128
_NONE = np.int64(1) << np.int64(62)
_POS = 24


class Codec:
    """Ranks of a vocabulary, the pattern that splits texts, and the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.bytes_of = dict(map(reversed, ranks.items()))
        size = max(ranks.values()) + 1
        lengths = np.zeros(size + 1, np.int64)
        for t, r in ranks.items():
            lengths[r + 1] = len(t)
        self.starts = np.cumsum(lengths)
        self.lengths = lengths[1:]
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.names = [str(i) for i in range(size)]
        keys, values = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        self.pairs = dict(zip(keys, values, strict=True))
        self._table(np.array(keys, np.int64), np.array(values, np.int64))
        self.forget()

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing, filled in rounds."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several, the last stays
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, or _NONE."""
        keys = (a << np.int64(32)) | b
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows: byte values, padded; returns ids of the live parts of all rows one after another, and counts."""
        n, width = rows.shape
        leaves = 1 << max(1, (width - 1).bit_length())
        ids = np.zeros((n, width + 1), np.int64)
        ids[:, :width] = self.single[rows]
        column = np.arange(width)
        live = column < lengths[:, None]
        after = np.where(column + 1 < lengths[:, None], column + 1, width)
        before = np.broadcast_to(column - 1, (n, width)).copy()
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        r, c = np.nonzero(column[: width - 1] + 1 < lengths[:, None])
        ranks = self.rank(ids[r, c], ids[r, c + 1])
        tree[r, leaves + c] = np.where(ranks < _NONE, (ranks << _POS) | c, _NONE)
        step = leaves
        while step > 1:
            step //= 2
            tree[:, step : 2 * step] = np.minimum(tree[:, 2 * step : 4 * step : 2], tree[:, 2 * step + 1 : 4 * step : 2])
        r = np.arange(n)

        def put(r: np.ndarray, c: np.ndarray, value: np.ndarray) -> None:
            at = leaves + c
            tree[r, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        def pair(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            """The leaf of the part at c and the one after it."""
            right = after[r, c]
            rank = self.rank(ids[r, c], ids[r, right])
            return np.where((rank < _NONE) & (right < width), (rank << _POS) | c, _NONE)

        while True:
            top = tree[r, 1]
            r, top = r[top < _NONE], top[top < _NONE]
            if not len(r):
                break
            c = top & ((1 << _POS) - 1)
            gone = after[r, c]
            ids[r, c] = top >> _POS
            live[r, gone] = False
            follows = after[r, gone]
            after[r, c] = follows
            inner = follows < width
            before[r[inner], follows[inner]] = c[inner]
            put(r, gone, np.full(len(r), _NONE))
            put(r, c, pair(r, c))
            left = before[r, c]
            has = left >= 0
            if has.any():
                put(r[has], left[has], pair(r[has], left[has]))
        return ids[:, :width][live], live.sum(1)

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with one tree in plain lists, for a long pre-token."""
        n = len(word)
        leaves = 1 << (n - 1).bit_length()
        none = int(_NONE)
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)

        def leaf(i: int) -> int:
            j = after[i]
            rank = self.pairs.get(ids[i] << 32 | ids[j]) if j < n else None
            return none if rank is None else rank << 32 | i

        def put(i: int, value: int) -> None:
            i += leaves
            tree[i] = value
            while i > 1:
                i >>= 1
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    break
                tree[i] = value

        for i in range(n):
            tree[leaves + i] = leaf(i)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i] = tree[1] >> 32
            ids[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in any order; for each pre-token where its own start, and how many they are."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts, counts, flat, used = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        classes = np.where(lengths > LONG, -1, np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
        for k in np.unique(classes):
            members = np.flatnonzero(classes == k)
            width = 1 << max(0, int(k))
            parts = [members[i : i + 1] for i in range(len(members))] if k < 0 else np.array_split(members, -(-len(members) * width // (1 << 18)))
            for part in parts:
                if k < 0:
                    ids = np.array(self._merge_long(words[part[0]]), np.int64)
                    n = np.array([len(ids)])
                else:
                    rows = np.zeros((len(part), width), np.uint8)
                    rows[np.arange(width) < lengths[part][:, None]] = np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8)
                    ids, n = self._merge_rows(rows, lengths[part])
                starts[part], counts[part] = used + np.cumsum(n) - n, n
                flat.append(ids)
                used += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), starts, counts

    def _learn(self, new: list[str]) -> None:
        """Remembers the ids of pre-tokens, and their text in decimal."""
        ids, starts, counts = self.merge([w.encode() for w in new])
        known = len(self.lines)
        self.cache.update(zip(new, range(known, known + len(new)), strict=True))
        names = [self.names[i] for i in ids.tolist()]
        self.lines += [" ".join(names[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
        self.spans = np.concatenate([self.spans, np.stack([len(self.pool) + starts, counts], 1)])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each text its ids in decimal, joined by a space; all ids; how many each text has."""
        if len(self.cache) > CACHE_WORDS or len(self.pool) > 8 * CACHE_WORDS:
            self.forget()
        found = [self.find(t) for t in texts]
        if new := set().union(*found).difference(self.cache):
            self._learn(list(new))
        sizes = [len(ws) for ws in found]
        at = list(map(self.cache.__getitem__, chain.from_iterable(found)))
        spans = self.spans[np.array(at, np.int64)]
        ends = np.cumsum(sizes)
        lines, begin = [], 0
        for end in ends.tolist():
            lines.append(" ".join(map(self.lines.__getitem__, at[begin:end])))
            begin = end
        totals = np.concatenate([[0], np.cumsum(spans[:, 1])])[ends] if len(ends) else np.zeros(0, np.int64)
        return lines, self.pool[V.gather(spans[:, 0], spans[:, 1])], np.diff(totals, prepend=0)

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.lines: list[str] = []
        self.spans = np.zeros((0, 2), np.int64)
        self.pool = np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and how many each has."""
        sizes = self.lengths[ids]
        return self.flat[V.gather(self.starts[ids], sizes)], sizes


def load_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_codecs: dict[str, Codec] = {}


def _codec(key: str, data: bytes, pattern: str) -> Codec:
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(data), pattern)
    return _codecs[key]


def _broadcast(spark: SparkSession, path: str, pattern: str):
    """The rank file goes to the executors once; its size is that of the vocabulary."""
    data = read_once(path)
    return spark.sparkContext.broadcast((hashlib.sha256(data + pattern.encode()).hexdigest(), data, pattern))


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``token_ids`` (array<int>) to every row."""
    shared = _broadcast(df.sparkSession, path, pattern)
    df = df.drop("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            for part in V.slices(batch, text_col):
                _, ids, counts = codec.encode(_texts(part, text_col))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "token_ids"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids; null ids count as none. An id outside the vocabulary is an error."""
    shared = _broadcast(df.sparkSession, path, pattern)
    df = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            out = [codec.decode(np.array(ids or [], np.int64))[0].tobytes() for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digest(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids, and returns both as digests: id, n_tokens, ids_sha256, decoded_sha256."""
    shared = _broadcast(df.sparkSession, path, pattern)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            for part in V.slices(batch, text_col):
                lines, ids, counts = codec.encode(_texts(part, text_col))
                data, sizes = codec.decode(ids)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)].tolist()
                raw, begin, decoded = memoryview(data), 0, []
                for end in ends:
                    decoded.append(sha(raw[begin:end]))
                    begin = end
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts.astype(np.int64)), pa.array([sha(x.encode()) for x in lines]), pa.array(decoded)],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_col].dataType
    fields = [(id_col, kind), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return df.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(a, b) for a, b in fields]))
