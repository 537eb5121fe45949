"""Expected severity of toxic language by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight for each word, shared by
all ordered thresholds; x is 1 for every word that a text has. Grades come from
the labels alone: 0 for rows that are not toxic, 1 for toxic ones, 2 for toxic
ones whose quality is labelled 0; without a quality label, or without such rows,
there is no grade 2. All words of the sampled rows that are more or less frequent
in toxic rows than chance explains take part, for and against. The output is the
expected grade, the sum over thresholds of P(grade > k), and the grade, which is
how many thresholds are passed with a chance that CLEAN of the sampled rows that
are not toxic do not reach at the first.

Only the fit uses a sample: at most SAMPLE labelled rows, those of the least hash
of their id. Every document is scored whole.

Cases: a null or empty text has no words and gets the severity of none; rows with
a null label or id are not learned from; rows that repeat an id are learned from
each with that id's label; without toxic or without other labels nothing is
learned and every severity is 0; long texts and ties need nothing special; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import _vector as V
from cairn.llm._spark import prepare, settle

#: Labelled rows that are learned from at most.
SAMPLE = 16_000
#: A word takes part if it is in so many sampled rows and so many deviations off its share of toxic ones.
MIN_ROWS, MIN_DEVIATIONS = 3, 3.5
#: Weight of the squared weights in the fit, and its steps.
RIDGE, STEPS = 3e-3, 400
#: Share of the sampled rows of grade 0 that must stay below the chance that counts as passing a threshold.
CLEAN = 0.999

_LOWER = np.full(256, 0x20, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalpha():
        _LOWER[_c] = ord(chr(_c).lower())
    elif _c >= 0x80 or chr(_c).isdigit():
        _LOWER[_c] = _c


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct lower-case words of each text, their counts, and how many stand before each text."""
    data, offsets = V.buffers(texts)
    data = _LOWER[data]
    starts, ends, first = V.words(data, offsets)
    hashes = V.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(doc))), np.searchsorted(doc[at], np.arange(len(offsets)))


class Model:
    """Words, their weights, the thresholds between grades, and the chance that passes one."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, cut: float):
        self.words, self.weights, self.thresholds, self.cut = words, weights, thresholds, cut

    def grades(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and grade of each text."""
        hashes, _, before = word_counts(texts)
        n = len(before) - 1
        if not len(self.words):
            return np.zeros(n), np.zeros(n, np.int32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        part = np.where(self.words[at] == hashes, self.weights[at], 0.0)
        doc = np.repeat(np.arange(n), np.diff(before))
        above = chances(np.bincount(doc, weights=part, minlength=n), self.thresholds)
        return above.sum(1), (above >= self.cut).sum(1).astype(np.int32)


def chances(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for every threshold k."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -60, 60)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, grade: np.ndarray, width: int, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative logit, by adaptive gradient steps on the likelihood.

    ``row`` and ``column`` say where x is 1; grades from 0 up must all occur.
    """
    n, grades = len(grade), int(grade.max()) + 1
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    z = np.concatenate([np.zeros(width), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(z), np.zeros_like(z)
    at = np.arange(n)
    for t in range(1, steps + 1):
        gaps = np.exp(z[width + 1 :])
        theta = z[width] + np.concatenate([[0], np.cumsum(gaps)])
        s = 1 - chances(np.bincount(row, weights=z[column], minlength=n), theta)
        bounds = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        chance = np.maximum(bounds[at, grade + 1] - bounds[at, grade], 1e-9)
        to_theta = np.zeros((n, grades + 1))
        to_theta[at, grade + 1] += slope[at, grade + 1] / chance
        to_theta[at, grade] -= slope[at, grade] / chance
        to_theta = to_theta[:, 1:-1]
        g_theta = -to_theta.sum(0) / n
        g_words = np.bincount(column, weights=to_theta.sum(1)[row], minlength=width) / n + ridge * z[:width]
        g = np.concatenate([g_words, [g_theta.sum()], [g_theta[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z = z - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return z[:width], z[width] + np.concatenate([[0], np.cumsum(np.exp(z[width + 1 :]))])


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice of sampled rows its words, in how many rows they are and in how many toxic ones."""
    for batch in batches:
        for part in V.slices(batch, "text"):
            hashes, _, before = word_counts(part.column(0))
            toxic = np.repeat(np.asarray(part.column(1)).astype(np.int64) > 0, np.diff(before))
            words, index = np.unique(hashes, return_inverse=True)
            sums = np.bincount(index, weights=toxic, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(index, minlength=len(words))), pa.array(sums)], ["word", "held", "marked"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quality_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Words are counted and rows turned into features on the executors; the driver gets the chosen words and ``sample`` rows of their places."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 1.0)
    poor = F.coalesce(F.col(quality_col) == 0, F.lit(False)) if quality_col in labels.columns else F.lit(False)
    grade = F.when(F.col(label_col) == 0, 0).when(poor, 2).otherwise(1)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), grade.alias("grade"))
    sampled = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # so many small rows are broadcast at most
    rows = settle(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sampled), "id").select("text", "grade"))
    n, marked = rows.agg(F.count("*"), F.count_if(F.col("grade") > 0)).head()
    if not 0 < marked < n:
        return none
    rate = marked / n
    words = rows.mapInArrow(_sampled_words, "word long, held long, marked long").groupBy("word").agg(F.sum("held").alias("held"), F.sum("marked").alias("marked"))
    deviation = (F.col("marked") - F.col("held") * rate) / F.sqrt(F.col("held") * rate * (1 - rate))
    chosen = words.filter((F.col("held") >= MIN_ROWS) & (F.abs(deviation) >= MIN_DEVIATIONS)).select("word").collect()  # words of the sample that mark or clear
    if not chosen:
        return none
    vocabulary = np.sort(np.array([r["word"] for r in chosen], np.int64).view(np.uint64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text"):
                hashes, _, before = word_counts(part.column(0))
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[at] == hashes
                places = [at[i:j][hit[i:j]].astype("<u4").tobytes() for i, j in zip(before[:-1], before[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.binary()), part.column(1)], ["places", "grade"])

    got = sorted((r["places"], r["grade"]) for r in rows.mapInArrow(features, "places binary, grade int").collect())
    grades = np.array([g for _, g in got])
    grades = np.searchsorted(np.unique(grades), grades)  # without gaps
    places = [np.frombuffer(p, "<u4") for p, _ in got]
    row, column = np.repeat(np.arange(len(got)), [len(p) for p in places]), np.concatenate(places).astype(np.int64)
    weights, thresholds = fit_ordinal(row, column, grades, len(vocabulary))
    first = np.sort(chances(np.bincount(row, weights=weights[column], minlength=len(got)), thresholds)[grades == 0, 0])
    return Model(vocabulary, weights, thresholds, float(np.nextafter(first[int(CLEAN * (len(first) - 1))], 1.0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity (expected grade), grade and toxic (a grade of 1 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.thresholds, model.cut))  # words of SAMPLE rows at most
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in V.slices(batch, text_col):
                severity, grade = own.grades(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(severity), pa.array(grade), pa.array(grade > 0)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    prepare(docs.sparkSession)
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
