"""Fusion of result lists. vector, graph: query_id, content, score; analysis: query_id, n_entities, complexity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowmill.operators.ranking import reciprocal_rank_fusion, top


def simple(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """Both lists, the vector's first; the first of equal contents stays."""
    both = vector.withColumn("found_by", F.lit("vector")).unionByName(graph.withColumn("found_by", F.lit("graph")))
    w = Window.partitionBy("query_id", "content").orderBy(F.desc("found_by"), F.desc("score"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def weights(analysis: DataFrame, vector: float = 0.6, graph: float = 0.4) -> DataFrame:
    """query_id, w_vector, w_graph: the graph counts for more in questions about several entities and in complex ones."""
    many, hard = F.col("n_entities") >= 2, F.col("complexity") > 0.7
    g = graph * F.when(many, 1.3).otherwise(1.0) * F.when(hard, 1.2).otherwise(1.0)
    v = vector * F.when(many, 0.8).otherwise(1.0) * F.when(hard, 0.9).otherwise(1.0)
    return analysis.select("query_id", (v / (v + g)).alias("w_vector"), (g / (v + g)).alias("w_graph"))


def weighted(vector: DataFrame, graph: DataFrame, analysis: DataFrame) -> DataFrame:
    """Scores by weight; where both lists hold a content, the graph adds half of its weighted score to the vector's."""
    both = vector.withColumnRenamed("score", "sv").join(graph.withColumnRenamed("score", "sg"), ["query_id", "content"], "full")
    both = both.join(weights(analysis), "query_id")
    shared = F.col("sv").isNotNull() & F.col("sg").isNotNull()
    score = F.coalesce(F.col("sv") * F.col("w_vector"), F.lit(0.0)) + F.coalesce(F.col("sg") * F.col("w_graph"), F.lit(0.0)) * F.when(shared, 0.5).otherwise(1.0)
    source = F.when(shared, "hybrid_both").when(F.col("sv").isNull(), "hybrid_graph").otherwise("hybrid_vector")
    return both.select("query_id", "content", score.alias("score"), source.alias("found_by"))


def by_rank(vector: DataFrame, graph: DataFrame, k: int = 60) -> DataFrame:
    """The sum of 1 / (k + rank) over the lists that hold a content."""
    ranked = [top(x, "query_id", "score", "content", 1 << 30).select("query_id", F.col("content").alias("item"), "rank") for x in (vector, graph)]
    out = reciprocal_rank_fusion(ranked[0].union(ranked[1]), k)
    return out.select("query_id", F.col("item").alias("content"), "score", F.lit("hybrid_rank").alias("found_by"))


def adaptive(vector: DataFrame, graph: DataFrame, analysis: DataFrame) -> DataFrame:
    """By weight for complex questions about several entities and where a list is empty, else by rank."""
    held = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    a = analysis.join(held(vector, "has_v"), "query_id", "left").join(held(graph, "has_g"), "query_id", "left")
    rank = ~((F.col("complexity") > 0.6) & (F.col("n_entities") >= 2)) & F.col("has_v").isNotNull() & F.col("has_g").isNotNull()
    chosen = a.select("query_id", rank.alias("rank"))
    one = by_rank(vector, graph).join(chosen.where("rank").select("query_id"), "query_id", "left_semi")
    return one.unionByName(weighted(vector, graph, analysis).join(chosen.where("not rank").select("query_id"), "query_id", "left_semi"))


def rank_and_filter(results: DataFrame, least: float = 0.3, most: int = 10) -> DataFrame:
    return top(results.where(F.col("score") >= least), "query_id", "score", "content", most)
