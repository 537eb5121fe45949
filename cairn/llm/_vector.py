"""Array kernels over batches of texts: bytes, words, rolling hashes.

Words are told by their bytes inside a slice (``numbered_words``) and by a seeded digest (xxh3) of
their bytes elsewhere (``word_hashes``); runs of words by hashes of hashes
(``windows``). The polynomial hashes of bytes collide for texts that are made to
(two letters in the order of Thue and Morse), so what they bring together must be compared.

All functions work on one bounded slice of an Arrow batch (see ``slices``), so
their memory follows ``SLICE_BYTES`` or the longest single text, never the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest as _digest

#: Bytes of text that one slice holds, unless one text alone is longer.
SLICE_BYTES = 2 << 20
#: Odd multipliers of the polynomial hashes (fixed, so that any executor gets the same hash).
_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
#: Seed of the words' digests (fixed, as are the multipliers).
_SEED = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers; the argument is not changed."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = {p: mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(p)) for p in (_P1, _P2)}


def powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i < n at least."""
    have = _powers.get(p)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for base in (p, pow(p, -1, 1 << 64)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[p] = (out[0], out[1])
    return have


def prefix(values: np.ndarray, p: int) -> np.ndarray:
    """Prefix sums of values[i] * p^i, one longer than values."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(p, len(values))[0][: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: int) -> np.ndarray:
    """Hashes of values[start:end], equal for equal contents wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(p, len(sums))[1][starts])


def rolling(sums: np.ndarray, width: int, p: int) -> np.ndarray:
    """Hashes of every window of that width over the whole array."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    return mix((sums[width:] - sums[:n]) * powers(p, len(sums))[1][:n])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the offset of each; null counts as empty."""
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=kind, count=n + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1] - offsets[0]), offset=int(offsets[0])) if data else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    yield batch.slice(at)


def words(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than ASCII white space, and how many words stand before each text; words end at ``cuts`` too."""
    full = ~_SPACE[data]
    n = len(full)
    begin, end = full.copy(), full.copy()
    if n:
        begin[1:] &= ~full[:-1]
        end[:-1] &= ~full[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        if cuts is not None:
            edges = np.concatenate([edges, cuts])
        begin[edges] = full[edges]
        end[edges - 1] = full[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` items, by hashing pairs of runs of half the width; no sum, so that no arrangement of items cancels out."""
    n = len(values) - width + 1
    if n <= 0 or not width:
        return np.empty(0, np.uint64)
    out, at, run, size = None, 0, values, 1
    while True:
        if width & size:
            part = run[at : at + n]
            out = part if out is None else mix(out * np.uint64(_P1) + part)
            at += size
        if 2 * size > width:
            return out if out is not values else out.copy()
        run = mix(run[:-size] * np.uint64(_P2) + run[size:])
        size *= 2


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each span's bytes among the distinct ones, in the order they come, and these; told by their bytes."""
    return _numbered(np.ascontiguousarray(data[gather(starts, ends - starts)]), ends - starts)


def numbered_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The same of all words of the data, which hold every byte that is not white space."""
    return _numbered(data[~_SPACE[data]], ends - starts)


def _numbered(joined: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A seeded digest of 64 bits of each word; each distinct one is digested once."""
    number, words = numbered_words(data, starts, ends)
    return np.fromiter(map(_digest, words.to_numpy(zero_copy_only=False).tolist(), repeat(_SEED)), np.uint64, len(words))[number]


def owners(counts: np.ndarray) -> np.ndarray:
    """For texts with so many items each, the index of the text of every item."""
    return np.repeat(np.arange(len(counts)), counts)


def within(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of the n - width + 1 windows that lies in one text; offsets count items before each text."""
    m = max(0, n - width + 1)
    ok = np.ones(m + 1, dtype=np.int32)
    ok[:] = 0
    cuts = offsets[(offsets > 0) & (offsets < n)]
    np.add.at(ok, np.clip(cuts - width + 1, 0, m), 1)
    np.add.at(ok, np.clip(cuts, 0, m), -1)
    return np.cumsum(ok)[:m] == 0
