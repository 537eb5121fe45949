"""Removal of passages of ``WINDOW`` words that start in a document of a smaller id.

Fixed-block anchors: every document's words are cut into blocks of ``BLOCK``
words that do not overlap; as WINDOW >= 2 * BLOCK - 1, each window of WINDOW
words has a whole block in it. All blocks are indexed by hash and probed with
the hash of every rolling window of BLOCK words. Around each hit, the windows
that hold the block at each of its BLOCK places are compared with those of the
other hits of the same block, which extends the hit to both sides as far as a
smaller document has the same words: the union of the matching windows is the
maximal repeat. Hits that agree in all places within a chunk are merged first,
so a passage that many documents share is a few rows for each chunk.

Words are runs of other bytes than ASCII white space. Windows agree if both the
64-bit hash of the block and that of the whole window do; these are hashes of
hashes of seeded digests of the words' bytes, so equal ones cannot be made by arranging
words or letters, and are as rare as chance has it.

Cases: null text has no words, and null stays null in ``apply``; texts of fewer
words than a window keep all; documents of equal ids do not count against each
other; a null id is neither reference nor judged; repeated rows with different
ids lose all windows but the first row's; empty tables give no rows. ``apply``
keeps every column and row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import _chunks as C
from cairn.llm import _vector as V
from cairn.llm._spark import settle
from cairn.llm._vector import gather

WINDOW, BLOCK = 50, 25


class _View:
    """Words, their hashes, and the rolling block hashes of a chunk."""

    def __init__(self, chunk: C.Chunk):
        self.chunk = chunk
        self.starts, self.ends, self.first = V.words(chunk.data, chunk.offsets)
        self.words = V.word_hashes(chunk.data, self.starts, self.ends)
        self.n = len(self.words)
        self.rolling = V.windows(self.words, BLOCK)
        at = np.flatnonzero(V.within(self.first, BLOCK, self.n))
        self.doc = np.searchsorted(self.first, at, "right") - 1
        usable = chunk.known[self.doc]
        self.at, self.doc = at[usable], self.doc[usable]
        self.hash = self.rolling[self.at]
        self.is_block = (self.at - self.first[self.doc]) % BLOCK == 0
        self.order = np.argsort(self.hash, kind="stable")
        h = self.hash[self.order]
        self.new = np.ones(len(h), bool)
        self.new[1:] = h[1:] != h[:-1]
        self.unique = h[self.new]
        self.group = np.cumsum(self.new) - 1  # of each place in ``order``


def _probes(bits: int):
    """To each bucket: the block hashes of the chunk, which are blocks, which occur in two documents."""

    def features(chunk: C.Chunk, _) -> Iterator[tuple[int, bytes]]:
        v = _View(chunk)
        if not len(v.unique):
            return
        begin = np.flatnonzero(v.new)
        doc = chunk.ids[v.doc[v.order]]
        many = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
        block = np.maximum.reduceat(v.is_block[v.order].astype(np.uint8), begin)
        keys = ((v.unique << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        for b, (lo, hi) in enumerate(zip(*C.by_bucket(v.unique, bits), strict=True)):
            if hi > lo:
                yield b, C.pack(keys[lo:hi], np.packbits(block[lo:hi]), np.packbits(many[lo:hi]))

    return features


def _match(bodies: list[bytes]) -> list[bytes | None]:
    """Which hashes of each message are a block somewhere and occur in two documents."""
    parts = []
    for body in bodies:
        keys, block, many = C.unpack(body)
        parts.append((keys, np.unpackbits(block, count=len(keys)), np.unpackbits(many, count=len(keys))))
    keys, block, many = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    size = np.diff(np.append(begin, len(keys)))
    good = (np.maximum.reduceat(block[order], begin) > 0) & ((size > 1) | (np.maximum.reduceat(many[order], begin) > 0))
    hit = np.zeros(len(keys), bool)
    hit[order] = np.repeat(good, size)
    out, at = [], 0
    for part in parts:
        own = hit[at : at + len(part[0])]
        at += len(part[0])
        out.append(C.pack(np.packbits(own)) if own.any() else None)
    return out


def _hits(v: _View, bits: int, answers: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hits of the chunk sorted by block hash and surroundings, merged where these agree: for each hit its
    place and the number of its merged row; for each row its block hash, least id, and window hashes."""
    good = np.zeros(len(v.unique), bool)
    lo, hi = C.by_bucket(v.unique, bits)
    for a in answers:
        if a["phase"] == 1:
            b = a["bucket"]
            good[lo[b] : hi[b]] = np.unpackbits(C.unpack(a["body"])[0], count=hi[b] - lo[b])
    chosen = v.order[good[v.group]]
    at, doc = v.at[chosen], v.doc[chosen]
    start = at[:, None] - np.arange(BLOCK)
    inside = (start >= v.first[doc][:, None]) & (start + WINDOW <= v.first[doc + 1][:, None])
    place = np.clip(start, 0, max(0, v.n - WINDOW))
    if len(place) and v.n >= WINDOW:  # a window is two blocks
        around = V.mix(v.rolling[place] * np.uint64(V._P1) + v.rolling[place + WINDOW - BLOCK])
    else:
        around = np.zeros(place.shape, np.uint64)
    around[~inside] = 0
    anchor = v.hash[chosen]
    whole = V.mix(anchor)
    for o in range(BLOCK):
        whole = V.mix(whole ^ around[:, o])
    ids = v.chunk.ids[doc]
    order = np.lexsort((ids, whole, anchor))
    at, ids, anchor, whole, around = at[order], ids[order], anchor[order], whole[order], around[order]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    return at, np.cumsum(new) - 1, anchor[new], ids[new], around[new]


def _surroundings(bits: int):
    """To the bucket of each hit's block: the hash, the least document, and the hashes of the windows around it."""

    def features(chunk: C.Chunk, answers: list) -> Iterator[tuple[int, bytes]]:
        if not answers:
            return
        _, _, anchor, ids, around = _hits(_View(chunk), bits, answers)
        for b, (lo, hi) in enumerate(zip(*C.by_bucket(anchor, bits), strict=True)):
            if hi > lo:
                yield b, C.pack(anchor[lo:hi], ids[lo:hi], around[lo:hi].ravel())

    return features


def _extend(bodies: list[bytes]) -> list[bytes | None]:
    """For each hit, at which of its places a smaller document has the same window."""
    parts = [C.unpack(b) for b in bodies]
    anchor, ids, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    around = around.reshape(-1, BLOCK)
    found = np.zeros(len(anchor), np.uint32)
    by_anchor = np.argsort(anchor, kind="stable")
    run = anchor[by_anchor]
    lone = np.ones(len(run), bool)
    lone[1:] &= run[1:] != run[:-1]
    lone[:-1] &= run[:-1] != run[1:]
    rows = by_anchor[~lone]
    for o in range(BLOCK):
        r = rows[around[rows, o] != 0]
        if not len(r):
            continue
        r = r[np.lexsort((ids[r], around[r, o], anchor[r]))]
        block, window = anchor[r], around[r, o]
        begin = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (window[1:] != window[:-1])]))
        least = np.repeat(ids[r][begin], np.diff(np.append(begin, len(r))))
        found[r[ids[r] > least]] |= np.uint32(1 << o)
    out, at = [], 0
    for part in parts:
        own = found[at : at + len(part[0])]
        at += len(part[0])
        out.append(C.pack(own) if own.any() else None)
    return out


def _removed(chunk: C.Chunk, bits: int, answers: list) -> tuple[_View, np.ndarray]:
    """Which words of the chunk go."""
    v = _View(chunk)
    if not answers:
        return v, np.zeros(v.n, bool)
    at, row, anchor, least, around = _hits(v, bits, answers)
    mask = np.zeros(len(anchor), np.uint32)
    lo, hi = C.by_bucket(anchor, bits)
    for a in answers:
        if a["phase"] == 2:
            mask[lo[a["bucket"]] : hi[a["bucket"]]] = C.unpack(a["body"])[0]
    doc = np.searchsorted(v.first, at, "right") - 1
    later = chunk.ids[doc] > least[row]  # the chunk itself has the same windows in a smaller document
    starts = [at[hit] - o for o in range(BLOCK) if (hit := (around[row, o] != 0) & (later | ((mask[row] >> np.uint32(o)) & np.uint32(1) > 0))).any()]
    return v, C.covered(np.concatenate(starts) if starts else np.zeros(0, np.int64), WINDOW, v.n)


def _run(df: DataFrame, apply, schema: T.StructType, id_col: str, text_col: str) -> DataFrame:
    chunks = C.make(df, text_col)
    count = C.buckets_for(chunks)
    bits = count.bit_length() - 1
    first = settle(C.answer(C.send(chunks, _probes(bits), id_col, text_col), count, _match)).withColumn("phase", F.lit(1))
    second = C.answer(C.send(C.back(chunks, first), _surroundings(bits), id_col, text_col), count, _extend).withColumn("phase", F.lit(2))
    done = C.back(chunks, first.unionByName(second))
    return C.finish(done, lambda chunk, answers: apply(chunk, *_removed(chunk, bits, answers)), schema, id_col, text_col)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def rows(chunk: C.Chunk, v: _View, gone: np.ndarray) -> pa.RecordBatch:
        keep = np.flatnonzero(~gone)
        sizes = v.ends[keep] - v.starts[keep] + 1
        text = np.append(chunk.data, np.uint8(0))[gather(v.starts[keep], sizes)]
        ends = np.cumsum(sizes)
        text[ends - 1] = 0x20
        bounds = np.concatenate([[0], ends])[np.searchsorted(keep, v.first)].tolist()
        raw = memoryview(text)
        shas = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[v.first])
        ids = chunk.batch.column(chunk.batch.schema.get_field_index(id_col))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(v.first).astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(shas)], schema.names)

    return _run(df.select(id_col, text_col), rows, schema, id_col, text_col)


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with its texts cut: a removed word goes with the white space after it; texts without repeats stay as they are."""

    def rows(chunk: C.Chunk, v: _View, gone: np.ndarray) -> pa.RecordBatch:
        at = chunk.batch.schema.get_field_index(text_col)
        texts = chunk.batch.column(at).to_pylist()
        drop = np.flatnonzero(gone)
        doc = np.searchsorted(v.first, drop, "right") - 1
        nexts = np.append(v.starts, len(chunk.data))[drop + 1] if v.n else drop
        nexts = np.minimum(nexts, chunk.offsets[doc + 1])
        keep = ~C.covered(np.zeros(0, np.int64), 1, len(chunk.data))
        keep[gather(v.starts[drop], nexts - v.starts[drop])] = False
        for i in np.unique(doc).tolist():
            a, b = chunk.offsets[i], chunk.offsets[i + 1]
            texts[i] = chunk.data[a:b][keep[a:b]].tobytes().decode()
        columns = list(chunk.batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, chunk.batch.schema.names)

    return _run(df, rows, df.schema, id_col, text_col)
