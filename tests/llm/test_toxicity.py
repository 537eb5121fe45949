import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import toxicity
from cairn.llm._spark import prepare

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Trained without every fifth labelled document, and judged on those."""
    read = prepare(spark).read
    docs, labels = read.parquet(f"{DATA}/documents.parquet"), read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 5 <> 0"))
    judged = toxicity.score(docs.join(labels.filter("doc_id % 5 = 0").select("doc_id"), "doc_id", "left_semi"), model)
    rows = judged.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    caught = [r["toxic"] for r in rows if r["label"]]
    wrong = [r["toxic"] for r in rows if not r["label"]]
    print(f"recall {np.mean(caught):.3f} of {len(caught)}, clean ones marked {np.mean(wrong):.4f} of {len(wrong)}, {len(model.words)} words")
    assert np.mean(caught) >= 0.9
    assert np.mean(wrong) < 0.01
    assert (np.diff(model.thresholds) > 0).all()
    assert (model.weights > 0).any()
    assert (model.weights < 0).any()


def test_learns_from_tables(spark):
    """Words that mark toxic rows raise the severity, one that others have lowers it; long and repeated rows are scored alike."""
    rng = random.Random(6)
    plain = [f"plain{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = rng.sample(plain, 30) + (rng.sample([f"vile{k}" for k in range(6)], 3) if toxic else ["kind"] * (i % 2))
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(toxic), int(i % 10 != 0)))
    docs = prepare(spark).createDataFrame([*rows, (0, rows[0][1], "again"), (700, "vile1 vile2 vile3 " + "plain1 " * 50000, "x"), (701, "", "x"), (702, None, "x")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.apply(docs, labels).collect()
    assert len(got) == len(rows) + 4
    of = {r["doc_id"]: r for r in got}
    assert all(of[i]["toxic"] == (i % 5 == 0) for i in range(600) if i)
    assert of[700]["toxic"]
    assert of[701]["severity"] == of[702]["severity"] < of[0]["severity"]
    assert len({r["severity"] for r in got if r["doc_id"] == 0}) == 1
    assert len(toxicity.train(docs, labels).thresholds) == 2
    assert len(toxicity.train(docs, labels.drop("quality")).thresholds) == 1


def test_ordinal_fit_orders_severity():
    """Rows of grade k have the first k words."""
    grade = np.repeat(np.arange(4), 50)
    row, column = zip(*[(i, k) for i, g in enumerate(grade.tolist()) for k in range(g)], strict=True)
    weights, thresholds = toxicity.fit_ordinal(np.array(row), np.array(column), grade, 3, ridge=1e-3)
    severity = toxicity.chances(np.concatenate([[0], np.cumsum(weights)]), thresholds).sum(1)
    assert (np.diff(thresholds) > 0).all()
    assert (np.diff(severity) > 0.5).all()


@pytest.mark.parametrize("rows", [[], [(1, 0)], [(None, 1), (1, None)]])
def test_nothing_to_learn(spark, rows):
    docs = prepare(spark).createDataFrame([(1, "a bad word", "x"), (2, None, "y"), (None, "", "z"), (2, None, "y")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = toxicity.apply(docs, labels).collect()
    assert len(got) == 4
    assert not any(r["toxic"] or r["severity"] for r in got)
    assert toxicity.apply(docs.limit(0), labels).count() == 0
