"""The corpus pipeline: each stage takes documents and returns what it keeps of them.

All stages but the last return the columns of documents; ``n_chars`` follows the
text. Documents are lost only to the quality rules and to near-duplicate
classes, of which the least id stays. Texts lose lines that fail the quality
rules, passages of 50 words that a smaller document has, and secrets.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import neardup, packing, quality, secrets, substring
from cairn.llm._spark import prepare, shared_folder

#: Subword merges and hashes of whole texts are beyond SQL.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """The documents with ``n_chars``, if there, counted anew."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines.

    Null, empty and wordless texts go; very long ones are judged whole; repeated rows
    are judged alike; an empty table gives none; other columns stay as they are.
    """
    prepare(spark)
    return _measured(quality.passed(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the least id.

    Rows without words or without id are kept; of rows that agree in id and text one
    stays, rows that share an id alone are judged each by its text; an empty table
    gives none; other columns stay as they are.
    """
    prepare(spark)
    return neardup.apply(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without passages of 50 words that also start in a row of a smaller id.

    Null stays null; rows of one id do not count against each other and rows without
    id neither; an empty table gives none; other columns stay as they are.
    """
    prepare(spark)
    return _measured(substring.apply(docs).select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with [REDACTED] for each secret.

    Null stays null; very long texts are scanned whole; ids may be null or repeated;
    an empty table gives none; other columns stay as they are.
    """
    prepare(spark)
    return _measured(secrets.redact(docs).select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places.

    Null and empty texts are one piece of the closing id; long ones are cut; repeated
    rows are packed each; an empty table gives none; other columns are left out.
    """
    prepare(spark)
    return packing.apply(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again.

    A stage's folder goes once the next is written; that of the last holds the result.
    """
    folder = f"{shared_folder(prepare(spark))}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
