"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the value as text (null: empty), modulo n."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def beside(df: DataFrame, needs: dict[str, str], adds: list[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns ``adds`` that ``change`` computes from those it needs (needed name: name in df). All of df's
    columns are set aside meanwhile, so that none clashes with a column that ``change`` uses on the way; those named as
    an added one give way to it."""
    aside = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_aside")
    out = change(df.select(*[F.col(f"`{c}`").alias(k) for k, c in needs.items()], aside))
    return out.select(*[F.col("_aside")[c].alias(c) for c in df.columns if c not in adds], *adds)


def with_text(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with ``text`` as ``change`` leaves it (and n_chars to match); the other columns are set aside meanwhile, so
    that none of them clashes with a column that ``change`` adds."""
    aside = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_aside")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    out = change(docs.select("text", aside))
    return out.select(*[(new[c] if c in new else F.col("_aside")[c]).alias(c) for c in docs.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a fresh one serves a local master, as in tests;
    on a cluster executors could not see it, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="knowmill-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost
    executor costs no recomputation of what is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/knowmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def tidy(spark: SparkSession) -> None:
    """Spark's cleaner deletes the shuffle files of finished jobs when the driver collects garbage, which a driver with
    little to do puts off; this asks for it."""
    gc.collect()
    spark._jvm.System.gc()


def release(*stashed: DataFrame) -> None:
    """Deletes tables that ``stash`` wrote, once nothing reads them any more."""
    for df in stashed:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    tidy(stashed[0].sparkSession)


def rank_in_group(df: DataFrame, key: str, order: str, name: str, rows_per_cell: int = 1_000, at: str | None = None) -> DataFrame:
    """Adds ``name``: the row's rank from 0 among the rows of its key, in the order of ``at`` (a number that is spread
    over its range; without it, a hash of ``order``) and then ``order`` itself (which is unique within a key). A key may
    hold most of the rows: each key is cut into ranges, ranked on their own, and the sizes of earlier ranges are added."""
    cells = min(max(1, df.count() // rows_per_cell), 20_000)
    if at is None:
        first = F.xxhash64(order)
        cell = F.floor((first.cast("double") / 2.0**64 + 0.5) * cells).cast("int")
    else:
        first = F.col(at)
        top = df.agg(F.max(at)).first()[0] or 0
        cell = F.floor(first.cast("double") / (top + 1) * cells).cast("int")
    df = df.withColumn("_cell", F.least(cell, F.lit(cells - 1)))
    sizes = df.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    here = Window.partitionBy(key, "_cell").orderBy(first, order)
    ranked = df.withColumn("_row", F.row_number().over(here).cast("long") - 1)
    same = F.col("a._cell").eqNullSafe(F.col("b._cell")) & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    out = ranked.alias("a").join(starts.alias("b"), same)
    return out.select("a.*", (F.col("_row") + F.col("_start")).alias(name)).drop("_cell", "_row")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) edges by alternating large-star and small-star steps: each round links
    every node to the least node it sees, so that long chains shrink in few rounds, until nothing changes. Returns
    (node, component), component being the least node, for every node with an edge to another. Each round's edges are
    written to the shared folder and earlier ones deleted; nothing is collected. Empty edges give an empty table."""
    e = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        mark = now
        both = e.union(e.select("v", "u"))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = stash(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        fewer = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(fewer, "u").where("v <> m").select("v", "m").union(fewer)
        after = stash(small.toDF("u", "v").where("u <> v").distinct(), "edges")
        release(e, least, large, fewer)
        e = after
