"""Removal of byte strings of ``WINDOW`` bytes that start in a document of a smaller id.

A window of WINDOW bytes picks the least hash among its k-grams; equal windows
pick the same. Windows in a row with one pick make a segment of at most
2 * WINDOW - GRAM bytes. Chunks exchange the hashes of their picks, which only
tell what must meet: the bytes of every segment whose pick two chunks, or two
documents of one, share go to that pick's bucket, one copy of each distinct
segment of a chunk. Segments are called equal where their bytes are.

A pick that more than about HOT distinct segments share (it stands at the edge of
a passage that very many documents have; they are counted on one hash in SAMPLED)
is split: every window of its segments is dealt out by its own hash, one copy of
each distinct window of a chunk, so what one key gathers is counted in chunks.

There, the distinct segments of a bucket form one text, and from its Burrows-Wheeler
transform the intervals of all strings are expanded breadth first: an interval
of a string of length l, extended backward by each of its symbols, closes a
common prefix of exactly l where none is closed yet. Prefix lengths so come out
by increasing value, and the expansion stops at WINDOW: what is still open are
suffixes with WINDOW bytes in common. The text is sorted to DEPTH symbols,
which is all that backward extension up to WINDOW needs.

Cases: null text is empty (and stays null in ``apply``); texts of fewer bytes
than a window keep all; documents of equal ids do not count against each other;
a null id is neither reference nor judged; copies lose all but what is shorter
than a window; an empty table gives no rows. ``apply`` keeps every column and row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import _chunks as C
from cairn.llm import _vector as V
from cairn.llm._spark import settle
from cairn.llm._vector import gather

WINDOW, GRAM = 50, 25
#: Symbols to which suffixes are sorted: 7 packed ones, tripled twice.
DEPTH = 63
#: Bytes of one transform, unless the segments of a single pick are more.
TEXT_BYTES = 1 << 20
#: Compressed bytes of the table that one bucket stands for; more than elsewhere, as each message of a chunk to a bucket costs some 70 bytes of its own.
BUCKET_BYTES = 16 << 20
#: Slices of the table in one chunk, for the same reason.
JOIN = 8
#: Bytes that are hashed or compared at a time.
PART_BYTES = 1 << 18
#: Distinct segments of one pick from which its windows are dealt out one by one.
HOT = 1 << 13
#: One segment hash in so many goes out with the picks, to count the distinct segments of each.
SAMPLED = 16
#: Top bits of a pick that are kept; segments are sorted by them and the other bits of their own hash in one number.
_PICK = np.uint64(0xFFFFFFFFFFF00000)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _in_order(key: np.ndarray) -> np.ndarray:
    """A stable argsort: the fast one's order of equal keys depends on the processor, so these are put in place again."""
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    order[tied] = order[tied][np.lexsort((order[tied], ranked[tied]))]
    return order


def _parts(size: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Where to cut pieces of these sizes into runs of at most so many bytes, or one piece, as arrays of numbers take many times their bytes."""
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def _hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of pieces of data."""
    out = np.empty(len(begin), np.uint64)
    for lo, hi in _parts(size):
        n = size[lo:hi]
        at = np.cumsum(n) - n
        out[lo:hi] = V.spans_hash(V.prefix(V._BYTE[V._P1][data[gather(begin[lo:hi], n)]], V._P1), at, at + n, V._P1)
    return out


def _fresh(data: np.ndarray, begin: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of pieces of data sorted by keys: which have other bytes than the one before."""
    new = np.ones(len(begin), bool)
    if not len(begin):
        return new
    new[1:] = size[1:] != size[:-1]
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    alike = np.flatnonzero(~new)
    for lo, hi in _parts(size[alike]):
        some = alike[lo:hi]
        n = size[some]
        differ = data[gather(begin[some], n)] != data[gather(begin[some - 1], n)]
        if differ.any():
            new[some[np.add.reduceat(differ, np.cumsum(n) - n) > 0]] = True
    return new


class _View:
    """The segments of a chunk, merged where pick and bytes agree."""

    def __init__(self, chunk: C.Chunk):
        self.chunk = chunk
        data, n = chunk.data, len(chunk.data)
        self.begin = self.end = self.row = np.zeros(0, np.int64)
        self.pick = self.picks = self.hash = np.zeros(0, np.uint64)
        self.ids = self.group = np.zeros(0, np.int64)
        self.several = np.zeros(0, bool)
        if n < WINDOW:
            return
        found = []
        for lo, hi in _parts(np.diff(chunk.offsets), C.CHUNK_BYTES):
            at = chunk.offsets[lo]
            a, b, doc, pick, whole = self._slice(data[at : chunk.offsets[hi]], chunk.offsets[lo : hi + 1] - at, chunk.known[lo:hi])
            found.append((a + at, b + at, chunk.ids[lo + doc], pick, whole))
        a, b, ids, pick, whole = (np.concatenate(x) for x in zip(*found, strict=True))
        key = pick & _PICK | whole >> np.uint64(44)
        order = _in_order(key)
        a, b, key, whole, ids = a[order], b[order], key[order], whole[order], ids[order]
        new = _fresh(data, a, b + WINDOW - 1 - a, key)
        self.begin, self.end, self.row, self.own = a, b + WINDOW - 1, np.cumsum(new) - 1, ids
        self.first = np.flatnonzero(new)
        self.pick, self.hash = key[new] & _PICK, whole[new]
        if not len(key):
            return
        self.ids = np.minimum.reduceat(ids, self.first)
        other = np.concatenate([[True], self.pick[1:] != self.pick[:-1]])
        at = np.flatnonzero(other)
        self.picks, self.group = self.pick[at], np.cumsum(other) - 1
        self.several = np.minimum.reduceat(self.ids, at) != np.maximum.reduceat(self.ids, at)

    @staticmethod
    def _slice(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of some documents of the chunk the first and the last window of every segment, its document, pick and hash."""
        n = len(data)
        if n < WINDOW:
            return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
        sums = V.prefix(V._BYTE[V._P1][data], V._P1)
        grams = V.rolling(sums, GRAM, V._P1)
        high = np.uint64(0xFFFFFFFF00000000)
        least = _least((grams & high) | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1)
        ok = V.within(offsets, WINDOW, n)
        change = np.ones(len(ok) + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
        edges = np.flatnonzero(change)
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(offsets, a, "right") - 1
        use = ok[a] & known[doc]
        a, b, doc = a[use], b[use], doc[use]
        pick = V.mix(grams[(least[a] & ~high).astype(np.int64)])  # least hashes are small ones; mixed anew they fill all buckets alike
        whole = V.spans_hash(sums, a, b + WINDOW - 1, V._P1) ^ V.mix((b - a).astype(np.uint64))
        return a, b, doc, pick, whole


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of sorted keys after those that name the bucket."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _segments(bits: int):
    """To each bucket: the chunk's picks, which of them two of its documents have, and the sampled segment hashes with their picks' places."""

    def features(chunk: C.Chunk, _) -> Iterator[tuple[int, bytes]]:
        v = _View(chunk)
        keys = _short(v.picks, bits)
        some = np.flatnonzero(v.hash % np.uint64(SAMPLED) == 0)
        place, whole = v.group[some].astype(np.uint32), (v.hash[some] >> np.uint64(32)).astype(np.uint32)
        for b, (lo, hi) in enumerate(zip(*C.by_bucket(v.picks, bits), strict=True)):
            if hi > lo:
                i, j = np.searchsorted(place, (lo, hi))
                yield b, C.pack(keys[lo:hi], np.packbits(v.several[lo:hi]), place[i:j] - np.uint32(lo), whole[i:j])

    return features


def _share(bodies: list[bytes], hot: int = HOT) -> list[bytes | None]:
    """For each pick: is it shared by two documents, so that bytes must be compared; is it hot."""
    keys, several, seen = [], [], []
    for body in bodies:
        k, two, place, whole = C.unpack(body)
        keys.append(k)
        several.append(np.unpackbits(two, count=len(k)))
        seen.append(k[place].astype(np.uint64) << np.uint64(32) | whole)
    sizes = [len(k) for k in keys]
    key, two = np.concatenate(keys), np.concatenate(several)
    order = np.argsort(key, kind="stable")
    key = key[order]
    group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # one pick
    length = np.diff(np.append(group, len(key)))
    shared = (length > 1) | (np.maximum.reduceat(two[order], group) > 0)
    counted = np.searchsorted(key[group], (np.unique(np.concatenate(seen)) >> np.uint64(32)).astype(np.uint32))
    distinct = np.bincount(counted, minlength=len(group)) * SAMPLED
    found = np.zeros((2, len(key)), bool)
    found[0, order], found[1, order] = np.repeat(shared, length), np.repeat(shared & (distinct > hot), length)
    out, at = [], 0
    for n in sizes:
        own = found[:, at : at + n]
        at += n
        out.append(C.pack(*(np.packbits(x) for x in own)) if own.any() else None)
    return out


def _verdicts(v: _View, bits: int, answers: list) -> np.ndarray:
    """Of the merged segments: which are compared, which of these have a hot pick."""
    found = np.zeros((2, len(v.picks)), bool)
    lo, hi = C.by_bucket(v.picks, bits)
    for a in answers:
        if a["phase"] == 1:
            b = a["bucket"]
            for to, part in zip(found, C.unpack(a["body"]), strict=True):
                to[lo[b] : hi[b]] = np.unpackbits(part, count=hi[b] - lo[b])
    return found[:, v.group]


class _Asked:
    """What a chunk has compared, sorted by key: its segments of other picks, and the distinct windows of those of hot picks."""

    def __init__(self, v: _View, ask: np.ndarray, hot: np.ndarray):
        begin, end = v.begin[v.first], v.end[v.first]
        self.rows = np.flatnonzero(ask & ~hot)
        wide = np.flatnonzero(hot)
        count = end[wide] - begin[wide] - WINDOW + 1
        self.of, self.place = np.repeat(wide, count), gather(np.zeros(len(wide), np.int64), count)
        at = begin[self.of] + self.place
        windows = _hashes(v.chunk.data, at, np.full(len(at), WINDOW))
        order = np.lexsort((v.ids[self.of], windows))
        new = _fresh(v.chunk.data, at[order], np.full(len(order), WINDOW), windows[order])
        one = order[new]
        self.window = np.zeros(len(order), np.int64)
        self.window[order] = np.cumsum(new) - 1
        self.later = v.ids[self.of] > v.ids[self.of[one]][self.window]
        pick = np.concatenate([v.pick[self.rows], windows[one]])
        self.order = np.argsort(pick, kind="stable")
        self.pick = pick[self.order]
        self.ids = np.concatenate([v.ids[self.rows], v.ids[self.of[one]]])[self.order]
        self.begin = np.concatenate([begin[self.rows], at[one]])[self.order]
        self.end = np.concatenate([end[self.rows], at[one] + WINDOW])[self.order]

    def masks(self, found: np.ndarray, segments: int) -> np.ndarray:
        """From the bits found for what was compared, those of all the chunk's merged segments."""
        own = np.zeros(len(found), np.uint32)
        own[self.order] = found
        out = np.zeros(segments, np.uint32)
        out[self.rows] = own[: len(self.rows)]
        hit = self.later | (own[len(self.rows) :][self.window] > 0)
        np.bitwise_or.at(out, self.of[hit], np.uint32(1) << self.place[hit].astype(np.uint32))
        return out


def _contents(bits: int):
    """To the bucket of each key: the bytes of segments and windows that must be compared."""

    def features(chunk: C.Chunk, answers: list) -> Iterator[tuple[int, bytes]]:
        if not answers:
            return
        v = _View(chunk)
        if not len(v.pick):
            return
        asked = _Asked(v, *_verdicts(v, bits, answers))
        keys = _short(asked.pick, bits)
        for b, (lo, hi) in enumerate(zip(*C.by_bucket(asked.pick, bits), strict=True)):
            if hi > lo:
                size = asked.end[lo:hi] - asked.begin[lo:hi]
                names, index = np.unique(asked.ids[lo:hi], return_inverse=True)
                index = index.astype(np.uint8 if len(names) <= 256 else np.uint32)
                yield b, C.pack(keys[lo:hi], index[:, None], names.astype(np.uint64) ^ np.uint64(1 << 63), size.astype(np.uint8)[:, None], chunk.data[gather(asked.begin[lo:hi], size)])

    return features


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of symbols below 512, sorted by their first DEPTH symbols."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(DEPTH, np.uint16)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << np.uint64(9) | padded[i : i + n]
    width, parts = 7, 3 if n < (1 << 21) - 2 else 2  # so many ranks fit into one number
    while True:
        order = np.argsort(key)
        if width >= DEPTH:
            return order
        s = key[order]
        rank = np.zeros(n + width * (parts - 1), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]]))
        key = rank[:n]
        for i in range(1, parts):
            key = key * np.uint64(n + 2) + rank[i * width : i * width + n]
        width *= parts


def common_prefixes(transform: np.ndarray, stop: int) -> np.ndarray:
    """For each place between sorted suffixes the length of their common prefix if it is below ``stop``, else -1.

    ``transform`` is the symbol before each sorted suffix. Place 0 is before the first.
    """
    n = len(transform)
    lcp = np.full(n + 1, -1, np.int16)
    by_symbol = np.argsort(transform, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix with the symbol put before it stands
    back[by_symbol] = np.arange(n)
    same = transform[by_symbol][1:] == transform[by_symbol][:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)  # the same symbol's neighbours
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    lcp[0] = 0
    low, high = np.array([0]), np.array([n])
    for length in range(stop):
        if not len(low):
            break
        size = high - low
        place = gather(low, size)
        of = np.repeat(np.arange(len(low)), size)
        final = after[place] >= high[of]
        last, owner = place[final], of[final]
        close = back[last] + 1
        fresh = lcp[close] < 0
        last, owner, close = last[fresh], owner[fresh], close[fresh]
        lcp[close] = length
        begin = before[place] < low[of]
        start, whose = place[begin], of[begin]
        name = whose << 10 | transform[start]
        order = np.argsort(name)
        low = back[start[order[np.searchsorted(name[order], owner << 10 | transform[last])]]]
        high = close
    return lcp


def shared_windows(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each segment a bit for every window of it that a segment of a smaller document has too."""
    n = len(sizes)
    text = np.zeros(int(sizes.sum()) + n, np.uint16)  # a 0 ends each segment
    begin = np.cumsum(sizes + 1) - sizes - 1
    text[gather(begin, sizes)] = data.astype(np.uint16) + 1
    order = suffix_order(text)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(common_prefixes(text[order - 1], window)[:-1] >= 0)
    count = sizes - window + 1
    row, place = np.repeat(np.arange(n), count), gather(np.zeros(n, np.int64), count)
    group = group[begin[row] + place]
    least = np.full(len(text) + 2, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids[row])
    out = np.zeros(n, np.uint32)
    dup = ids[row] > least[group]
    np.bitwise_or.at(out, row[dup], np.uint32(1) << place[dup].astype(np.uint32))
    return out


def _compare(bodies: list[bytes]) -> list[bytes | None]:
    """For each segment of a bucket a bit for every window that a smaller document has.

    Equal segments are told by their bytes; the transform runs over the distinct ones
    that share a pick with others, cut where a new pick begins.
    """
    parts = [C.unpack(b) for b in bodies]
    pick, size, data = (np.concatenate([p[i] for p in parts]) for i in (0, 3, 4))
    ids = np.concatenate([(p[2] ^ np.uint64(1 << 63)).astype(np.int64)[p[1]] for p in parts])
    counts = [len(p[0]) for p in parts]
    del parts
    size = size.astype(np.int64)
    at = np.cumsum(size) - size
    whole = _hashes(data, at, size)
    key = pick.astype(np.uint64) << np.uint64(32) | whole >> np.uint64(32)
    order = np.argsort(key)
    new = _fresh(data, at[order], size[order], key[order])
    one = order[new]  # a copy of each distinct segment
    of = np.zeros(len(pick), np.int64)
    of[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    starts = np.flatnonzero(np.concatenate([[True], pick[one][1:] != pick[one][:-1]]))
    many = np.repeat(np.diff(np.append(starts, len(one))) > 1, np.diff(np.append(starts, len(one))))
    rows, masks = one[many], np.zeros(len(one), np.uint32)
    edges = np.append(np.flatnonzero(np.concatenate([[True], pick[rows][1:] != pick[rows][:-1]])), len(rows)) if len(rows) else np.zeros(1, np.int64)
    total = np.concatenate([[0], np.cumsum(size[rows])])
    met = np.zeros(len(rows), np.uint32)
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(total[edges], total[edges[i]] + TEXT_BYTES, "right")) - 1)
        some = rows[edges[i] : edges[j]]
        met[edges[i] : edges[j]] = shared_windows(data[gather(at[some], size[some])], size[some], least[of[some]])
        i = j
    masks[many] = met
    found = masks[of]
    later = ids > least[of]
    found[later] |= ((np.uint64(1) << (size[later] - WINDOW + 1).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    out, k = [], 0
    for n in counts:
        own = found[k : k + n]
        k += n
        out.append(C.pack(own[:, None]) if own.any() else None)
    return out


def _removed(chunk: C.Chunk, bits: int, answers: list) -> np.ndarray:
    """Which bytes of the chunk go."""
    v, n = _View(chunk), len(chunk.data)
    step = np.zeros(n + 1, np.int32)
    if len(v.pick):
        ask, hot = _verdicts(v, bits, answers)
        whole = v.own > v.ids[v.row]
        np.add.at(step, v.begin[whole], 1)
        np.add.at(step, v.end[whole], -1)
        asked = _Asked(v, ask, hot)
        mask = np.zeros(len(asked.pick), np.uint32)
        lo, hi = C.by_bucket(asked.pick, bits)
        for a in answers:
            if a["phase"] == 2:
                mask[lo[a["bucket"]] : hi[a["bucket"]]] = C.unpack(a["body"])[0]
        own = asked.masks(mask, len(v.pick))[v.row]
        own[whole] = 0
        for i in range(WINDOW - GRAM + 1):
            hit = v.begin[(own >> np.uint32(i)) & np.uint32(1) > 0] + i
            np.add.at(step, hit, 1)
            np.add.at(step, hit + WINDOW, -1)
    return np.cumsum(step[:n]) > 0


def _run(df: DataFrame, apply, schema: T.StructType, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    chunks = C.make(df, text_col, JOIN)
    count = C.buckets_for(chunks, BUCKET_BYTES)
    bits = count.bit_length() - 1
    first = settle(C.answer(C.send(chunks, _segments(bits), id_col, text_col), count, partial(_share, hot=hot)), free=True).withColumn("phase", F.lit(1))
    second = C.answer(C.send(C.back(chunks, first), _contents(bits), id_col, text_col), count, _compare).withColumn("phase", F.lit(2))
    done = C.back(chunks, first.unionByName(second))
    return C.finish(done, lambda chunk, answers: apply(chunk, _removed(chunk, bits, answers)), schema, id_col, text_col)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def rows(chunk: C.Chunk, gone: np.ndarray) -> pa.RecordBatch:
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < len(gone))]
        begins[inner] = gone[inner]
        per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[chunk.offsets])
        kept = chunk.data[~gone]
        bounds = np.concatenate([[0], np.cumsum(~gone)])[chunk.offsets].tolist()
        raw = memoryview(kept)
        shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ids = chunk.batch.column(chunk.batch.schema.get_field_index(id_col))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (np.diff(chunk.offsets), per(gone), per(begins))), pa.array(shas)], schema.names)

    return _run(df.select(id_col, text_col), rows, schema, id_col, text_col, hot)


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with its texts cut; a character of which only some bytes are covered stays whole."""

    def rows(chunk: C.Chunk, gone: np.ndarray) -> pa.RecordBatch:
        lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
        size = np.diff(np.append(lead, len(gone)))
        keep = np.repeat(np.logical_or.reduceat(~gone, lead), size) if len(lead) else ~gone
        at = chunk.batch.schema.get_field_index(text_col)
        texts = chunk.batch.column(at).to_pylist()
        for i, (a, b) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)):
            if not keep[a:b].all():
                texts[i] = chunk.data[a:b][keep[a:b]].tobytes().decode()
        columns = list(chunk.batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, chunk.batch.schema.names)

    return _run(df, rows, df.schema, id_col, text_col)
