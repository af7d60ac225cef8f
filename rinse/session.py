"""Session settings the library counts on, and where it may keep intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE handles skewed joins and the number of reduce tasks. Inputs are cut so that every core
# gets a few tasks; a large input still gets splits of the full maxPartitionBytes.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    # Python workers get and return rows in batches that bound their memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # Tasks keep the first rows of a group only, however many are asked for.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000000000",
}
TASKS_PER_CORE = 3


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; safe to repeat."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.minPartitionNum", str(TASKS_PER_CORE * cores))
    # Many folders are listed by a few tasks; one task for each takes longer to start than to list.
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(TASKS_PER_CORE * cores))
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder path that all executors share, below ``spark.checkpoint.dir``.

    The folders of one application lie together, so ``release`` can remove them.
    """
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{root.rstrip('/')}/rinse-{context.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results read from them are gone too."""
    remove(spark, _own_folder(spark))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the table to the shared folder and read it back.

    What follows no longer depends on the work before it, reads only the columns it needs, and
    sees the same rows each time even if executors are lost.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
