"""Merging and removing repeated rows by explicit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def exact_duplicates(edges: DataFrame) -> DataFrame:
    """id, primary_id: each repeated (src, dst, type), types compared in upper case, and the most confident row it repeats."""
    w = Window.partitionBy("src", "dst", F.upper("type")).orderBy(F.desc("confidence"), "id")
    out = edges.withColumn("primary_id", F.first("id").over(w)).withColumn("_rn", F.row_number().over(w))
    return out.where("_rn > 1").select("id", "primary_id")


def reversed_duplicates(edges: DataFrame) -> DataFrame:
    """id, primary_id of edges that run both ways with one type: the less confident one is redundant."""
    a, b = edges.alias("a"), edges.alias("b")
    same = (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.type") == F.col("b.type"))
    less = (F.col("a.confidence") < F.col("b.confidence")) | ((F.col("a.confidence") == F.col("b.confidence")) & (F.col("a.id") > F.col("b.id")))
    return a.join(b, same & less).groupBy(F.col("a.id").alias("id")).agg(F.min("b.id").alias("primary_id"))


def upsert(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """Rows of both tables, one for each key: the strictly higher score wins, else the old row stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return best_per_key(both, [F.col(key)], [F.desc(score), F.col("_new")]).drop("_new")


def changed(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """New rows whose key is unknown or whose digest differs."""
    return new.join(old.select(key, F.col(digest).alias("_old")), key, "left").where(~F.col("_old").eqNullSafe(F.col(digest))).drop("_old")
