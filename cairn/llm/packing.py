"""Best-fit packing of token sequences by fitted patterns.

A pattern is a handful of lengths that fill one sequence. All patterns of at
most ``DEPTH`` length classes are enumerated, so each class is in very many of
them; non-negative least squares fits how often each is used to the histogram of
lengths; the counts are rounded down and each pattern's lengths are chosen to
leave as little as can be. What is left over, and documents too short for a
pattern, are packed best-fit, longest first, also into the slack of the patterns.
All of that works on the histogram, whose size is that of a sequence and not of
the table. Documents then get their places by length and rank.

Words are encoded once a worker, told by their bytes; added tokens of the vocabulary that
a text holds as they are written are words of their own.

Cases: null and empty texts are one piece of the closing id alone; texts longer
than a sequence are cut into full pieces and a rest; repeated rows are packed
each; ties go by id and content; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import _vector as V
from cairn.llm._spark import prepare, read_once, settle

LENGTH = 2048
#: Width of the length classes of the fit, and documents of one pattern.
WIDTH, DEPTH = 16, 4
#: Documents of at most this share of a sequence are no part of patterns but fill what these leave.
SHORT = 1 / 8
#: Tokens that a pattern may leave free; else its documents are packed one by one.
SLACK = 16
#: Words whose ids a worker remembers between slices.
CACHE_WORDS = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


class Words:
    """Ids of whole texts from the ids of their words.

    The tokenizer drops white space and never joins a letter or digit with a
    sign beside it, so both cut a text into words that can be encoded alone.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.mark = self._ids("\x01")
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile(b"|".join(regex.escape(t.encode()) for t in added)) if added else None
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.pool, self.used = np.zeros(1 << 12, np.uint32), 0

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where tokens of the vocabulary stand that are taken as they are written, text by text."""
        raw = data.tobytes()
        if self.added is None or not self.added.search(raw):
            return []
        return [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.added.finditer(raw, a, b)]

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and how many stand before each text."""
        letter = _LETTER[data]
        wide = np.flatnonzero(data == 0xC3)  # the letters U+00C0 to U+00FF but for two signs
        wide = wide[wide + 1 < len(data)]
        wide = wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]
        letter[wide] = letter[wide + 1] = True
        sign = _SIGN[data]
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        for a, b in self._specials(data, offsets):
            cut[a : b + 1] = False
            cut[[a, b]] = True
        cut[[0, -1]] = False
        cuts = np.flatnonzero(cut)
        return V.words(data, offsets, cuts)

    def _learn(self, words: list[bytes]) -> None:
        """Adds new words."""
        flat, counts = [], np.zeros(len(words), np.int64)
        texts = [w.decode() for w in words]
        alone = np.flatnonzero(np.array(["\x01" in t for t in texts], bool)).tolist()
        many = np.flatnonzero(~np.isin(np.arange(len(words)), alone))
        order: list[int] = []
        for at in range(0, len(many), 2048):
            part = many[at : at + 2048]
            ids = np.array(self._ids(" \x01 ".join([texts[i] for i in part.tolist()])), np.uint32)
            m = len(self.mark)
            hit = np.ones(max(0, len(ids) - m + 1), bool)
            for j, x in enumerate(self.mark):
                hit &= ids[j : j + len(hit)] == x
            ends = np.append(np.flatnonzero(hit), len(ids))
            begins = np.append(0, ends[:-1] + m)
            if len(ends) != len(part):  # a vocabulary that joins words over the mark: one by one then
                alone += part.tolist()
                continue
            counts[part] = ends - begins
            order += part.tolist()
            flat.append(ids[V.gather(begins, ends - begins)])
        for i in alone:
            flat.append(np.array(self._ids(texts[i]), np.uint32))
            counts[i] = len(flat[-1])
            order.append(i)
        n, new = len(self.known), np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        self.begin, self.size = (_room(x, n + len(words)) for x in (self.begin, self.size))
        self.begin[n:][order] = self.used + np.cumsum(counts[order]) - counts[order]
        self.size[n : n + len(words)] = counts
        self.pool = _room(self.pool, self.used + len(new))
        self.pool[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by 0, and how many each text has with it."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        data, offsets = V.buffers(texts)
        starts, ends, first = self.cut(data, offsets)
        number, distinct = V.numbered_words(data, starts, ends)
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([words[i] for i in new.tolist()])
        place = at[number]
        sizes = self.size[place]
        ids = self.pool[V.gather(self.begin[place], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])[first]
        ends = np.zeros(len(ids) + len(before) - 1, bool)
        ends[before[1:] + np.arange(len(before) - 1)] = True  # the closing id of each text
        out = np.zeros(len(ends), np.uint32)
        out[~ends] = ids
        return out, np.diff(before) + 1


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n items at least, twice as large if it had less."""
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


_words: dict[int, Words] = {}


def pieces(df: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", want_ids: bool = False) -> DataFrame:
    """Documents cut into pieces of at most ``length`` ids: id, piece, start, length, ids_crc32, and the ids if wanted."""
    shared = df.sparkSession.sparkContext.broadcast(read_once(path))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])
    if want_ids:
        schema.add("token_ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        if (key := hash(data)) not in _words:
            _words[key] = Words(data)
        words = _words[key]
        for batch in batches:
            for part in V.slices(batch, text_col):
                ids, counts = words.encode(part.column(1))
                n = -(-counts // length)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * length
                size = np.minimum(length, counts[row] - start)
                begin = (np.cumsum(counts) - counts)[row] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if want_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def enumerate_patterns(classes: int, depth: int) -> np.ndarray:
    """Every way to add up to ``classes`` by at most ``depth`` classes: a row each, largest first, 0 for none."""
    found = []
    heads, rest, most = np.zeros((1, 0), np.int64), np.array([classes]), np.array([classes])
    for k in range(depth):
        high = np.minimum(rest, most)
        count = np.maximum(high - -(-rest // (depth - k)) + 1, 0)
        row = np.repeat(np.arange(len(rest)), count)
        most = high[row] - V.gather(np.zeros(len(count), np.int64), count)
        heads, rest = np.hstack([heads[row], most[:, None]]), rest[row] - most
        full = rest == 0
        found.append(np.pad(heads[full], ((0, 0), (0, depth - k - 1))))
        heads, rest, most = heads[~full], rest[~full], most[~full]
    return np.concatenate(found)


def nnls(patterns: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """How often each pattern is used, at least 0 times, so that the classes come as near to the target as can be.

    An active set grows by the pattern whose classes lack most, and shrinks where a count would turn negative.
    """
    scale = max(1.0, float(target.max(initial=0)))
    goal = target / scale
    on: list[int] = []
    columns, x = np.zeros((len(goal), 0)), np.zeros(0)
    for _ in range(rounds):
        slope = np.append(0.0, goal - columns @ x)[patterns].sum(1)
        slope[on] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-7:
            break
        on.append(j)
        columns, x = np.hstack([columns, np.bincount(patterns[j], minlength=len(goal) + 1)[1:, None]]), np.append(x, 0.0)
        while True:
            gram, wanted = columns.T @ columns, columns.T @ goal
            try:
                z = np.linalg.solve(gram, wanted)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(columns, goal, rcond=None)[0]
            bad = z <= 1e-9
            if not bad.any():
                x = z
                break
            x = x + np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)) * (z - x)
            keep = ~bad | (x > 1e-9)
            if keep.all():
                keep[np.argmin(np.where(bad, x, np.inf))] = False
            on = [i for i, k in zip(on, keep.tolist(), strict=True) if k]
            columns, x = columns[:, keep], np.maximum(x[keep], 0)
    out = np.zeros(len(patterns))
    out[on] = x * scale
    return out


def _choose(parts: list[int], left: np.ndarray, width: int) -> tuple[int, ...]:
    """Lengths that are left for the classes of a pattern, the last two so that they leave the least; empty if there are none that leave SLACK at most."""
    taken: list[int] = []
    space = len(left) - 1

    def first(part: int, most: int, *more: int) -> int:
        return next((n for n in range(min(most, space), (part - 1) * width, -1) if left[n] > taken.count(n) + more.count(n)), 0)

    for part in parts[:-2]:
        taken.append(first(part, part * width))
        if not taken[-1]:
            return ()
        space -= taken[-1]
    if len(parts) == 1:
        n = first(parts[0], space)
        return (n,) if n else ()
    best: tuple[int, ...] = ()
    for n in range(min(parts[-2] * width, space - 1), (parts[-2] - 1) * width, -1):
        if left[n] > taken.count(n) and (last := first(parts[-1], space - n, n)) and n + last > sum(best):
            best = (n, last)
            if n + last == space:
                break
    return (*taken, *best) if best and space - sum(best) <= SLACK else ()


def plan(histogram: dict[int, int], length: int = LENGTH, width: int = WIDTH, depth: int = DEPTH, fit=nnls) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, covering the histogram exactly."""
    left = np.zeros(length + 1, np.int64)
    for n, count in histogram.items():
        left[n] += count
    done: list[tuple[tuple[int, ...], int]] = [((length,), int(left[length]))] * bool(left[length])
    left[length] = 0
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # bins by free space

    def keep(pattern: tuple[int, ...], count: int) -> None:
        space = length - sum(pattern)
        (open_.setdefault(space, []) if space else done).append((pattern, count))

    short = int(length * SHORT)
    fillers = left[: short + 1].copy()
    left[: short + 1] = 0
    classes = -(-length // width)
    target = np.bincount(-(-np.arange(length + 1) // width), weights=left, minlength=classes + 1)[1:]
    patterns = enumerate_patterns(classes, depth)
    times = np.floor(fit(patterns, target) + 1e-6).astype(np.int64) if target.any() else np.zeros(len(patterns), np.int64)
    for j in np.flatnonzero(times).tolist():
        parts, open_times = patterns[j][patterns[j] > 0].tolist(), int(times[j])
        while open_times and (pattern := _choose(parts, left, width)):
            need = {n: pattern.count(n) for n in pattern}
            used = min(open_times, min(int(left[n]) // m for n, m in need.items()))
            for n, m in need.items():
                left[n] -= m * used
            open_times -= used
            keep(pattern, used)
    left[: short + 1] += fillers
    for n in range(length - 1, 0, -1):
        while left[n]:
            space = min((s for s in open_ if s >= n), default=None)
            if space is None:
                each = min(length // n, int(left[n]))
                bins = int(left[n]) // each
                left[n] -= each * bins
                keep((n,) * each, bins)
                continue
            pattern, count = open_[space].pop()
            if not open_[space]:
                del open_[space]
            each = min(space // n, int(left[n]))
            bins = min(count, int(left[n]) // each)
            left[n] -= each * bins
            if bins < count:
                open_.setdefault(space, []).append((pattern, count - bins))
            keep(pattern + (n,) * each, bins)
    return done + [x for bins in open_.values() for x in bins]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranges of ranks of each length: first (length << 40 | rank), sequence of it, offset."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for n in pattern:
            rank = seen.get(n, 0)
            rows.append((n << 40 | rank, sequence, offset))
            seen[n] = rank + count
            offset += n
        sequence += count
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def pack(parts: DataFrame, length: int = LENGTH, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length``; the pieces are read twice, so settle them first.

    The ranks of a length are counted in as many parts as the root of its count, so a
    length that most pieces have is dealt out too; parts and their sums meet by shuffle.
    """
    spark = parts.sparkSession
    counted = settle(parts.groupBy("length").count())
    histogram = {int(r["length"]): int(r["count"]) for r in counted.collect()}  # LENGTH rows at most
    places = spark.sparkContext.broadcast(_places(plan(histogram, length)))  # some rows for each length and pattern
    roots = counted.select("length", F.ceil(F.sqrt("count")).alias("_parts"))
    keyed = parts.join(F.broadcast(roots), "length").withColumn("_part", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("_parts")))
    before = keyed.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = before.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy(id_col, "piece", "ids_crc32")
    ranked = keyed.withColumn("_own", F.row_number().over(own) - 1).join(before.hint("merge"), ["length", "_part"])
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, offset = places.value
        for batch in batches:
            n, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "_rank"))
            key = n << 40 | rank
            i = np.searchsorted(first, key, "right") - 1
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[i] + key - first[i]), pa.array(offset[i])], schema.names)

    return ranked.select(*names, (F.col("_own") + F.col("_before")).alias("_rank")).mapInArrow(run, schema)


def apply(df: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents to packed pieces: id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(df.sparkSession)
    return pack(settle(pieces(df, path, length, id_col, text_col)), length, id_col)
