"""The folder that driver and executors share, and results that are kept there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: For sessions on one machine that name no folder, such as tests.
LOCAL = "/tmp/checkpoints"
#: Rows and bytes of one Arrow batch.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Spark's switch for deleting a plan's shuffle files when its action ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; else one of this machine if it runs everything, or one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return LOCAL if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path there that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sound(spark: SparkSession) -> SparkSession:
    """Turns off the planner's claim that a union is partitioned as its inputs are.

    Spark 4.1 takes partitions of the inputs as matching even where adaptive reads have
    coalesced one of them, so that an aggregate over the union gives a key twice.
    Also bounds the Arrow batches, which by default may have 10,000 texts of any length.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def settle(df: DataFrame, free: bool = False) -> DataFrame:
    """Writes the rows to the shared folder and cuts the lineage there; the folder is set only where none is.

    With ``free`` what was shuffled for it is deleted then. The plan that runs is one of its own, so nothing else reads that.
    """
    spark = sound(df.sparkSession)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    if not free:
        return df.checkpoint(eager=True)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def forget(df: DataFrame) -> None:
    """Deletes the files of what ``settle`` returned, once nothing is read from it any more."""
    rows = df._jdf.queryExecution().analyzed()
    if rows.getClass().getSimpleName() != "LogicalRDD":
        return
    file = rows.rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
