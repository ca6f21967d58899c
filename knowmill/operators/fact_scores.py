"""Six dimensions of a fact's worth for a query, as column expressions over one row a fact.

facts: content, kind, confidence, n_documents, n_entities, source_type, target_type, semantic_context, temporal_context,
has_context, has_metadata, has_path (booleans), path_length, method, age (seconds since extraction, null if unknown)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions import text as T
from knowmill.operators import facts

#: What a kind of fact adds to the quality of its source and to its confidence.
OF_SOURCE = {"DIRECT": 0.3, "CONTEXTUAL": 0.2, "CHAIN": 0.15, "INFERRED": 0.1, "TEMPORAL": 0.1}
OF_CONFIDENCE = {"DIRECT": 0.1, "CONTEXTUAL": 0.05, "CHAIN": -0.05, "INFERRED": -0.1, "TEMPORAL": 0.0}
#: Types of entities that are reliable, and words of time.
RELIABLE = ("PERSON", "ORGANIZATION", "LOCATION", "CONCEPT")
OF_TIME = (
    "recent", "recently", "current", "currently", "now", "today", "yesterday", "tomorrow", "this year", "last year", "next year", "modern", "contemporary", "latest", "new", "updated",
)
DIMENSIONS = ("relevance", "source", "confidence", "recency", "completeness", "specificity")


def _worth(kind: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in table.items()], F.lit(0.0))


def _if(test: Column, worth: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), worth).otherwise(0.0)


def source_quality() -> Column:
    several = F.when(F.col("n_documents") > 1, F.least(F.lit(0.3), 0.1 * (F.col("n_documents") - 1))).otherwise(0.0)
    ends = sum((_if(F.col(c).isin(*RELIABLE), 0.05) for c in ("source_type", "target_type")), F.lit(0.0))
    far = F.coalesce("path_length", F.lit(2)) - 3
    long = F.when((F.col("kind") == "CHAIN") & (far > 0), F.least(F.lit(0.2), far * 0.05)).otherwise(0.0)
    method = F.when(F.col("method").contains("enhanced"), 0.1).when(F.lower("method").contains("llm"), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + several + _worth(F.col("kind"), OF_SOURCE) + ends - long + method + _if(F.col("n_entities") > 0, 0.1))


def sureness() -> Column:
    typed = [(F.coalesce(F.col(c), F.lit("")) != "") & (F.col(c) != "Unknown") for c in ("source_type", "target_type")]
    several = F.when(F.col("n_documents") > 1, F.least(F.lit(0.15), F.col("n_documents") * 0.03)).otherwise(0.0)
    more = _if(F.col("semantic_context"), 0.05) + _if(typed[0] & typed[1], 0.1) + _worth(F.col("kind"), OF_CONFIDENCE) + several
    more = more + _if(F.col("age") < 3600, 0.05) + _if(F.col("method").contains("enhanced"), 0.1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + more))


def recency() -> Column:
    age = F.when(F.col("age") < 3600, 0.3).when(F.col("age") < 86_400, 0.2).when(F.col("age") < 604_800, 0.1).otherwise(0.0)
    timed = _if(F.lower("content").rlike("|".join(OF_TIME)), 0.2)
    return F.least(F.lit(1.0), 0.5 + timed + age + _if(F.col("temporal_context"), 0.15) + _if(F.col("kind") == "TEMPORAL", 0.2))


def score(rows: DataFrame, query: Column, strategy: Column | None = None) -> DataFrame:
    """rows with the six dimensions in place of columns of these names, score and reason; ``strategy`` follows from the query
    unless it is given."""
    asked, said = F.size(T.tokens(query)), F.size(T.tokens(F.col("content")))
    complete = F.least(F.lit(1.0), 0.5 + _if(F.col("has_context"), 0.2) + _if(F.col("has_metadata"), 0.1) + _if(F.col("has_path"), 0.2))
    specific = F.when(asked == 0, 0.5).otherwise(F.least(F.lit(1.0), said / (2 * asked)))
    values = [facts.keyword_relevance(F.col("content"), query), source_quality(), sureness(), recency(), complete, specific]
    out = rows.withColumns(dict(zip(DIMENSIONS, values, strict=True)))
    out = out.withColumn("score", facts.weighted([F.col(d) for d in DIMENSIONS], facts.strategy(query) if strategy is None else strategy))
    named = [F.struct((-F.col(c)).alias("minus"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (c, name) in enumerate((("relevance", "query relevance"), ("source", "source quality"), ("confidence", "confidence")))]
    best = F.slice(F.array_sort(F.array(*named)), 1, 2)
    part = lambda x: F.when(-x["minus"] > 0.7, "High ").when(-x["minus"] > 0.4, "Moderate ")
    parts = F.array_compact(F.transform(best, lambda x: F.concat(part(x), x["name"], F.lit(" ("), F.format_number(-x["minus"], 2), F.lit(")"))))
    said = F.when(F.size(parts) == 0, "Low overall relevance").otherwise(F.array_join(parts, ", "))
    return out.withColumn("reason", F.concat(F.lit("Scored based on: "), said, F.lit(". Fact type: "), F.lower("kind"), F.lit(".")))
