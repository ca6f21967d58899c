"""Tables written on the way in the folder that driver and executors share, so that lineage ends there."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local master without one gets a folder of its own, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="knowmill-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


#: Rows that one task sorts or groups.
ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, dealt by the keys over so many partitions that of ``rows`` rows one holds about ``ROWS``: what a task holds in memory
    then does not grow with the table, whatever number of partitions is set or small files of like values suggest."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table and read again."""
    path = f"{shared_dir(df.sparkSession)}/knowmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Spark's cleaner deletes the shuffle files of finished jobs when the driver collects garbage; this asks for it."""
    gc.collect()
    spark._jvm.System.gc()


def bucketed(df: DataFrame, rows: int, key: str, name: str, *once: str) -> DataFrame:
    """df, dealt by the key and written so in buckets of about ``ROWS`` of ``rows`` rows: joins by the key read it as it lies
    and deal the other side alone. once: rows of one key and these columns are written once, in order."""
    spark, name = df.sparkSession, f"knowmill_{name}_{uuid.uuid4().hex}"
    n = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))
    df = df.repartition(n, key)
    df = df.dropDuplicates([key, *once]).sortWithinPartitions(key, *once) if once else df
    df.write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    # The name goes, the files stay: the catalog holds nothing that outlasts its use.
    spark.sql(f"DROP TABLE {name}")
    return out
