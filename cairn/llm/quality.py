"""Quality rules, lines first.

Every line with a word is judged by itself; failing lines are removed, and a
document that loses more than ``MAX_LOST`` of its words is rejected. Before
that, two base rules on whole documents reject short and repetitive texts.

Cases: null text has no words, so it fails the base rules; so does an empty
text. Very long texts are judged whole, one at a time. Repeated rows are judged
alike. An empty table gives an empty table. Columns that ``apply`` adds replace
columns of the same name; ``passed`` adds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm import _vector as V

#: A document with fewer words, or with a larger share of repeated words, fails at once.
MIN_WORDS, MAX_REPEATED = 50, 0.5
#: Share of words that may go with failing lines.
MAX_LOST = 0.5
#: A line fails with more of these characters for each word,
MAX_SYMBOLS, MAX_SHOUTS = 0.5, 0.5
#: with so many separators and one for so many words at least,
NAV_LEAST, NAV_WORDS = 2, 4
#: with a smaller share of distinct words if it has so many words,
MIN_DISTINCT, DISTINCT_WORDS = 0.3, 10
#: without closing punctuation and with fewer words,
OPEN_WORDS = 4
#: or with one of these phrases and at most so many words.
BOILERPLATE_WORDS = 25
PHRASES = [b"all rights reserved", b"click here", b"cookie policy", b"enable javascript", b"lorem ipsum", b"privacy policy", b"sign up for our", b"subscribe to our", b"terms of service", b"terms of use", b"use of cookies", b"use cookies"]

_SYMBOL, _SHOUT, _BAR, _CLOSE = (np.zeros(256, np.int32) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_SHOUT[list(b"!")] = 1
_BAR[list(b"|")] = 1
_CLOSE[list(b".!?:;\"')]")] = 1
#: Closing punctuation outside ASCII: ellipsis, right quotes, ideographic full stop, full-width ! and ?.
_CLOSE_WIDE = [int.from_bytes(c.encode(), "big") for c in "…”’»。！？"]

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS += [T.StructField("base_failed", T.BooleanType()), T.StructField("n_lost_words", T.LongType()), T.StructField("kept", T.BooleanType())]


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more; which of these are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def _joined(keys: np.ndarray, numbers: np.ndarray, most: int) -> np.ndarray:
    """One whole number for each pair, exactly; keys that would not fit are numbered anew."""
    if len(keys) and int(keys.max()) >= (1 << 62) // max(most, 1):
        keys = np.unique(keys, return_inverse=True)[1]
    return keys * most + numbers


def judge(texts: pa.Array) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Columns of FIELDS for each text; its bytes, and of all lines: start, end, failed."""
    data, offsets = V.buffers(texts)
    n = len(offsets) - 1
    starts, ends, first = V.words(data, offsets)
    words, distinct_words = V.numbered_words(data, starts, ends)
    per_text = lambda at_bytes: np.diff(at_bytes[offsets])
    n_words = np.diff(first)
    symbols, shouts, bars = (_sums(lut[data]) for lut in (_SYMBOL, _SHOUT, _BAR))
    chars = _sums(((data & 0xC0) != 0x80) & ~V._SPACE[data])

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    nexts = np.append(line_start[1:], len(data))
    line_end = nexts - ((nexts > line_start) & (data[np.maximum(nexts, 1) - 1] == 10)) if len(line_start) else nexts
    owner = np.searchsorted(offsets, line_start, "right") - 1
    w0, w1 = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    count = w1 - w0
    full = count > 0

    lines = np.zeros(len(count), np.int64)
    lines[full] = V.numbered(data, line_start[full], line_end[full])[0]
    n_dup = np.bincount(owner[full][_repeated((owner * len(lines) + lines)[full])[1]], minlength=n)

    m = len(words)
    covered = np.zeros(m + 1, np.int64)
    if m >= 3:
        ok = np.flatnonzero(V.within(first, 3, m))
        of = np.searchsorted(first, ok, "right") - 1
        three = _joined(_joined(_joined(of, words[ok], len(distinct_words)), words[ok + 1], len(distinct_words)), words[ok + 2], len(distinct_words))
        twice = ok[_repeated(three)[0]]
        step = np.zeros(m + 1, np.int64)
        step[twice] += 1
        step[twice + 3] -= 1
        covered[1:] = np.cumsum(np.cumsum(step)[:m] > 0)
    n_repeat = np.diff(covered[first])

    last = np.where(full, ends[np.maximum(w1, 1) - 1] if m else 0, 1) - 1
    at = lambda back: data[np.maximum(last - back, 0)].astype(np.int64) if len(data) else np.zeros(len(last), np.int64)
    byte = at(0)
    wide = (at(2) << 16) + (at(1) << 8) + byte
    closed = (_CLOSE[byte] > 0) | np.isin(wide, _CLOSE_WIDE) | np.isin(wide & 0xFFFF, _CLOSE_WIDE)
    line_of_word = np.repeat(np.arange(len(count)), count)
    distinct = count - np.bincount(line_of_word[_repeated(line_of_word * len(distinct_words) + words)[1]], minlength=len(count)) if m else count
    span = lambda sums: sums[line_end] - sums[line_start]
    boiler = np.zeros(len(count), bool)
    low = data.tobytes().lower()
    for phrase in PHRASES:
        at = low.find(phrase)
        while at >= 0:
            i = np.searchsorted(line_start, at, "right") - 1
            boiler[i] |= at + len(phrase) <= line_end[i]
            at = low.find(phrase, at + 1)
    failed = full & (
        (span(symbols) > MAX_SYMBOLS * count)
        | (span(shouts) > MAX_SHOUTS * count)
        | ((span(bars) >= NAV_LEAST) & (span(bars) * NAV_WORDS >= count))
        | ((count >= DISTINCT_WORDS) & (distinct < MIN_DISTINCT * count))
        | (~closed & (count < OPEN_WORDS))
        | (boiler & (count <= BOILERPLATE_WORDS))
    )
    lost = np.bincount(owner[failed], weights=count[failed], minlength=n).astype(np.int64)
    base = (n_words < MIN_WORDS) | (n_repeat > MAX_REPEATED * n_words)
    out = {"n_words": n_words, "word_chars": per_text(chars), "n_symbols": per_text(symbols), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
    out |= {"base_failed": base, "n_lost_words": lost, "kept": ~base & (lost <= MAX_LOST * n_words)}
    return out, (data, line_start, line_end, failed)


def _cleaned(texts: pa.Array, lines: tuple[np.ndarray, ...], lost: np.ndarray) -> list[str | None]:
    """The texts without their failing lines."""
    data, start, end, failed = lines
    out, offsets = texts.to_pylist(), V.buffers(texts)[1]
    for i in np.flatnonzero(lost).tolist():
        a, b = np.searchsorted(start, offsets[i]), np.searchsorted(start, offsets[i + 1])
        keep = [data[start[k] : end[k]].tobytes() for k in range(a, b) if not failed[k]]
        out[i] = b"\n".join(keep).decode()
    return out


def apply(df: DataFrame, text_col: str = "text", clean: bool = False) -> DataFrame:
    """Adds FIELDS to every row; with ``clean`` the text loses its failing lines."""
    added = {f.name for f in FIELDS}
    df = df.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in V.slices(batch, text_col):
                found, lines = judge(part.column(at))
                columns = list(part.columns)
                if clean:
                    columns[at] = pa.array(_cleaned(part.column(at), lines, found["n_lost_words"]), pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[f.name]) for f in FIELDS)], [*part.schema.names, *(f.name for f in FIELDS)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *FIELDS]))


def passed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, all columns as they are, but for the text, which loses its failing lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in V.slices(batch, text_col):
                found, lines = judge(part.column(at))
                columns = list(part.columns)
                columns[at] = pa.array(_cleaned(part.column(at), lines, found["n_lost_words"]), pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(found["kept"]))

    return df.mapInArrow(run, df.schema)
