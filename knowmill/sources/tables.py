"""Readers, and the property graph that the star schema's tables form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.sources.shared import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type of regions, nations, customers, suppliers and parts."""
    one = lambda t, key, name, kind: read(spark, sf_dir, t).select(F.concat(F.lit(kind[0].lower() + ":"), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"))
    return (
        one("region", "r_regionkey", "r_name", "REGION").union(one("nation", "n_nationkey", "n_name", "NATION"))
        .union(one("customer", "c_custkey", "c_name", "CUSTOMER")).union(one("supplier", "s_suppkey", "s_name", "SUPPLIER"))
        .union(one("part", "p_partkey", "p_name", "PART"))
    )


KINDS = "rncsp"


def node(kind: str, key: Column) -> Column:
    """A node's number, from its kind and key: numbers are dealt and compared faster than names."""
    return key.cast("long") * 8 + KINDS.index(kind)


def node_name(number: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, KINDS)), F.pmod(number, F.lit(8)).cast("int")), F.lit(":"), F.floor(number / 8).cast("long"))


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_suppkey, l_partkey, count of lines, in as many partitions as the lines need."""
    li = read(spark, sf_dir, "lineitem")
    return dealt(li.select("l_suppkey", "l_partkey"), li.count(), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").count()


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, l_partkey, count of lines, in as many partitions as the lines need."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    n = li.count()
    lines = dealt(li.select("l_orderkey", "l_partkey"), n, "l_orderkey")
    both = lines.join(dealt(o.select("o_orderkey", "o_custkey"), n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return dealt(both.select("o_custkey", "l_partkey"), n, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").count()


def relations(spark: SparkSession, sf_dir: str, numbers: bool = False) -> DataFrame:
    """src, dst, type, n (lines behind the edge); ends are names or, on demand, numbers."""
    end = lambda k, c: node(k, F.col(c)) if numbers else F.concat(F.lit(k + ":"), F.col(c))
    fixed = [
        read(spark, sf_dir, "nation").select(end("n", "n_nationkey").alias("src"), end("r", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("type"), F.lit(1).cast("long").alias("n")),
        read(spark, sf_dir, "customer").select(end("c", "c_custkey"), end("n", "c_nationkey"), F.lit("LOCATED_IN"), F.lit(1).cast("long")),
        read(spark, sf_dir, "supplier").select(end("s", "s_suppkey"), end("n", "s_nationkey"), F.lit("LOCATED_IN"), F.lit(1).cast("long")),
        supplied(spark, sf_dir).select(end("s", "l_suppkey"), end("p", "l_partkey"), F.lit("SUPPLIES"), "count"),
        bought(spark, sf_dir).select(end("c", "o_custkey"), end("p", "l_partkey"), F.lit("BOUGHT"), "count"),
    ]
    out = fixed[0]
    for x in fixed[1:]:
        out = out.union(x)
    return out


#: The same two tables in SQL.
GRAPH_SQL = """ent AS (
  SELECT 'r:' || r_regionkey AS id, r_name AS name, 'REGION' AS type FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'NATION' FROM nation
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'CUSTOMER' FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name, 'SUPPLIER' FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, p_name, 'PART' FROM part),
rel AS (
  SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'IN_REGION' AS type, 1::BIGINT AS n FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'LOCATED_IN', 1 FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'LOCATED_IN', 1 FROM supplier
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'SUPPLIES', count(*) FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'c:' || o_custkey, 'p:' || l_partkey, 'BOUGHT', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)"""
