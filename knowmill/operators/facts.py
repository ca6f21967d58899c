"""Facts: search, validation, filters and scores. facts: fact_id, text, fact_type, domain, confidence, position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions import text as T

#: Kinds of facts.
FACT_TYPES = ("research", "process", "definition", "causal", "methodological", "safety", "statistical", "comparative")
#: Patterns of vague language.
VAGUE = (r"\b(some|many|several|various|different|certain)\b", r"\b(generally|usually|often|sometimes|typically)\b", r"\b(might|could|may|possibly|potentially)\b")
#: Phrases about the document itself.
META = ("this document", "this article", "this paper", "this section", "the author", "the text")


def search(facts: DataFrame, needle: str, kind: str | None, domain: str | None, least: float, limit: int) -> DataFrame:
    """The most confident facts that hold the needle; the latest first among equals."""
    hit = (F.col("confidence") >= least) & F.lower("text").contains(needle.lower())
    for name, value in (("fact_type", kind), ("domain", domain)):
        hit = hit & (F.col(name) == value) if value else hit
    return facts.where(hit).orderBy(F.desc("confidence"), F.desc("position"), "fact_id").limit(limit)


def domain_filter(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """rules: domain, excluded, required (arrays of words), factor, least. Drops facts with an excluded word, or without
    any of the required ones, or whose confidence times the factor (at most 1) is too low. Facts without a rule stay."""
    low = F.lower("text")
    barred = F.exists("excluded", lambda w: low.contains(w))
    asked = (F.size("required") == 0) | F.exists("required", lambda w: low.contains(w))
    adjusted = F.least(F.lit(1.0), F.col("confidence") * F.coalesce("factor", F.lit(1.0)))
    keep = F.col("factor").isNull() | (~barred & asked & (adjusted >= F.col("least")))
    return facts.join(F.broadcast(rules), "domain", "left").where(keep).select(facts.columns + [adjusted.alias("adjusted")])


def issues(text: Column, kind: Column, confidence: Column, least: float = 0.3, shortest: int = 20) -> tuple[Column, Column]:
    """What is wrong with a fact, and its confidence after the cost of vague language (0.2, down to 0.3)."""
    low = F.lower(text)
    vague = low.rlike("|".join(VAGUE))
    after = F.when(vague, F.greatest(F.lit(0.3), confidence - 0.2)).otherwise(confidence)
    found = F.array_compact(F.array(
        F.when(F.length(F.trim(text)) == 0, "empty: no text"), F.when(F.length(text) < shortest, "brief: too short"), F.when(after < least, "confidence: below threshold"),
        F.when(low.rlike("|".join(META)), "meta: about the document"), F.when(~kind.isin(*FACT_TYPES), "type: unknown"),
    ))
    return found, after


def quality(found: Column, confidence: Column, filled: Column) -> Column:
    """Confidence less 0.2 for each issue (0.8 at most), or plus 0.05 for each field filled, between 0 and 1."""
    valid = F.least(F.lit(1.0), confidence + 0.05 * filled)
    return F.when(F.size(found) == 0, valid).otherwise(F.greatest(F.lit(0.0), confidence - F.least(F.lit(0.8), 0.2 * F.size(found))))


def keywords(text: Column, most: int = 10) -> Column:
    """The first distinct words of four letters or more outside the stop list."""
    return F.slice(F.array_distinct(T.keywords(text)), 1, most)


#: Weights of relevance, source, confidence, recency, completeness, specificity by strategy.
WEIGHTS = {
    "balanced": (0.3, 0.2, 0.2, 0.1, 0.1, 0.1), "factual": (0.4, 0.2, 0.3, 0.05, 0.03, 0.02), "recent": (0.3, 0.2, 0.15, 0.3, 0.03, 0.02), "analytical": (0.25, 0.25, 0.15, 0.05, 0.25, 0.05),
}
#: Words of a query that choose a strategy, in order.
STRATEGY_WORDS = {"factual": ("what", "who", "when", "where"), "recent": ("recent", "latest", "current", "now"), "analytical": ("analyze", "explain", "why", "how")}


def strategy(query: Column) -> Column:
    low, pick = F.lower(query), F
    for name, words in STRATEGY_WORDS.items():
        pick = pick.when(low.rlike("|".join(words)), name)
    return pick.otherwise("balanced")


def keyword_relevance(text: Column, query: Column) -> Column:
    """The share of the query's words that the text holds."""
    words, asked = (F.array_distinct(T.tokens(c)) for c in (text, query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(words, asked)) / F.size(asked))


def weighted(dimensions: list[Column], kind: Column) -> Column:
    """The dimensions weighed by the strategy, at most 1."""
    pick = F
    for name, weights in WEIGHTS.items():
        pick = pick.when(kind == name, sum((w * d for w, d in zip(weights, dimensions, strict=True)), F.lit(0.0)))
    return F.least(F.lit(1.0), pick.otherwise(0.0))


def banded(name: str, value: Column) -> Column:
    return F.when(value > 0.7, f"High {name}").when(value > 0.4, f"Moderate {name}")
