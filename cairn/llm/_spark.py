"""What the operators need of the session: sizes, checkpoints, Arrow batches, the driver's files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cairn.sources.files import read_table
from cairn.sources.shared import settle as _settle
from cairn.sources.shared import shared_folder, sound

#: Rows of one Arrow batch. Long texts make large batches, so the count is small.
BATCH_ROWS = 500
#: Bytes of one Arrow batch, as far as more than one row is concerned.
BATCH_BYTES = 8 << 20
#: Compressed bytes of the table that one hash bucket of an exchange should stand for.
BUCKET_BYTES = 4 << 20


def read_once(path: str) -> bytes:
    """A small file that the driver sees, such as a vocabulary."""
    return Path(path).read_bytes()


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the Arrow batch size, and a checkpoint folder only where none is configured."""
    sound(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(prepare(spark), sf_dir, name)


def buckets(total: int, per_bucket: int = BUCKET_BYTES, least: int = 64) -> int:
    """A power of two that grows with the bytes, so that a bucket's share stays the same."""
    return 1 << (max(least, min(1 << 24, total // per_bucket)) - 1).bit_length()


def settle(df: DataFrame, free: bool = False) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage there; with ``free`` also deletes what was shuffled for them."""
    prepare(df.sparkSession)
    return _settle(df, free)
