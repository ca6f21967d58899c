"""Finding entities for questions, resolving names to entities, and scoring how sure an entity is."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from knowmill.functions import text as T
from knowmill.operators import names as N
from knowmill.operators.containment import holding
from knowmill.sources.shared import written

#: Words that are no keywords of a question.
QUESTION_STOP = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "what", "when", "where", "why", "how",
)
#: Weights: the name in the question, shared words, the type, words of the description.
IN_QUESTION, SHARED, OF_TYPE, DESCRIBED = 0.8, 0.6, 0.3, 0.4


def question_keywords(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*QUESTION_STOP))


def discover(questions: DataFrame, entities: DataFrame, least: float = 0.3, most: int = 20) -> DataFrame:
    """query_id, id, score, rank: each question's ``most`` most relevant entities at ``least`` or above. questions: query_id,
    text; entities: id, name, type, description.

    An entity is worth 0.8 if the question holds its name, 0.6 times the share of its words among the question's keywords,
    0.3 if its type holds a keyword and 0.4 times the share of its description's words; at most 1. Pairs are found from each
    part by itself: names by an automaton over the questions, words and descriptions by an inverted index, types (few) by
    an automaton over the distinct types."""
    q = written(questions.where("text is not null").select("query_id", "text", F.array_distinct(question_keywords(F.col("text"))).alias("keys")), "questions")
    e = written(entities.select("id", "name", "type", F.coalesce("description", F.lit("")).alias("description")), "entities")
    named = holding(q.select(F.col("query_id").alias("id"), "text"), e.select(F.col("id").alias("name_id"), "name")).select(F.col("id").alias("query_id"), F.col("name_id").alias("id"), F.lit(IN_QUESTION).alias("worth"), F.lit("name").alias("part"))
    keys = q.select("query_id", F.explode("keys").alias("key"))

    def shared(column: str, weight: float, part: str) -> DataFrame:
        words = e.select("id", F.array_distinct(T.tokens(F.col(column))).alias("words")).select("id", F.size("words").alias("n"), F.explode("words").alias("key"))
        met = words.join(keys, "key").groupBy("query_id", "id").agg((weight * F.count("*") / F.first("n")).alias("worth"))
        return met.select("query_id", "id", "worth", F.lit(part).alias("part"))

    kinds = e.select(F.lower("type").alias("type")).where("type <> ''").distinct()
    fitting = holding(kinds.select(F.col("type").alias("id"), F.col("type").alias("text")), keys.select(F.col("key").alias("name_id"), F.col("key").alias("name")).distinct())
    fitting = fitting.select(F.col("id").alias("type"), F.col("name_id").alias("key")).join(keys, "key").select("query_id", "type").distinct()
    parts = named.union(shared("name", SHARED, "words")).union(shared("description", DESCRIBED, "description"))
    sums = parts.groupBy("query_id", "id").agg(F.sum("worth").alias("worth"))
    if OF_TYPE >= least:
        # Of entities that only their type speaks for, the first ones of a type are all that can rank.
        firsts = e.select("id", F.lower("type").alias("type")).withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where(F.col("k") <= most)
        by_type = fitting.join(firsts, "type").select("query_id", "id", F.lit(0.0).alias("worth"))
        sums = sums.union(by_type).groupBy("query_id", "id").agg(F.sum("worth").alias("worth"))
    typed = sums.join(e.select("id", F.lower("type").alias("type")), "id").join(fitting.withColumn("fits", F.lit(OF_TYPE)), ["query_id", "type"], "left")
    scored = typed.select("query_id", "id", F.least(F.lit(1.0), F.col("worth") + F.coalesce("fits", F.lit(0.0))).alias("score")).where(F.col("score") >= least - 1e-12)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


@F.pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio: twice the characters in matching blocks, found from the longest outwards, over all."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def bag_bound(a: Column, b: Column) -> Column:
    """At most this can ``matching_blocks`` be: twice the characters that two texts share, however placed, over all."""
    count = lambda t: F.transform(F.array_distinct(F.split(t, "")), lambda c: F.struct(c.alias("c"), F.size(F.filter(F.split(t, ""), lambda x: x == c)).alias("n")))
    other = lambda c: F.size(F.filter(F.split(b, ""), lambda x: x == c))
    both = F.aggregate(count(a), F.lit(0), lambda s, x: s + F.least(x["n"], other(x["c"])))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * both / (F.length(a) + F.length(b)))


def name_classes(names: DataFrame) -> DataFrame:
    """id, block, class of names (id, block, name): names of a block that are equal in lower case are one class, called by
    its least id. Empty names are in none."""
    low = names.select("id", "block", F.lower("name").alias("name")).where("name <> ''")
    return low.join(low.groupBy("block", "name").agg(F.min("id").alias("class")).hint("merge"), ["block", "name"]).select("id", "block", "class")


def alike_classes(names: DataFrame, least: float) -> DataFrame:
    """block, a, b, ratio of classes of equal names (by least ids, see ``name_classes``) whose Ratcliff-Obershelp ratio, a's
    name first, reaches ``least`` (over one half); each order of two names in which ids can stand, since the ratio depends on
    it. Matching characters keep their order, so that of lengths n and m at most (n + m) * (1 - ratio) edits are needed and the
    edit similarity is 2 * ratio - 1 at least: pairs meet by ``names.near`` at that, then pass the bound by bags. Only
    different names are compared, however often each occurs."""
    low = names.select("id", "block", F.lower("name").alias("name")).where("name <> ''")
    n = written(low.groupBy("block", "name").agg(F.min("id").alias("id"), F.max("id").alias("last")), "names")
    pairs = N.near(n.select("id", "block", "name", F.lit(2 * least - 1).alias("least"))).select("block", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = n.toDF("block", "x", "a", "last_a"), n.toDF("block", "y", "b", "last_b")
    both = pairs.join(x, ["block", "a"]).join(y, ["block", "b"]).where(bag_bound(F.col("x"), F.col("y")) >= least)
    # The blocks differ with the order of the two names: the longest first, then the one found first.
    turned = both.where(F.col("b") < F.col("last_a")).select("block", F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y"))
    ways = both.select("block", "a", "b", "x", "y").union(turned)
    return ways.withColumn("ratio", matching_blocks("x", "y")).where(F.col("ratio") >= least).select("block", "a", "b", "ratio")


def alike(names: DataFrame, least: float) -> DataFrame:
    """a, b, ratio of names (id, block, name) of one block, a < b, whose ratio reaches ``least``: the pairs of classes spread
    over their members, with the pairs within each class."""
    of = written(name_classes(names), "classes")
    met = alike_classes(names, least).union(of.select("block", "class", "class", F.lit(1.0)).distinct())
    first, second = of.toDF("a", "block", "first"), of.toDF("b", "block", "second")
    out = met.toDF("block", "first", "second", "ratio").join(first.hint("merge"), ["block", "first"]).join(second.hint("merge"), ["block", "second"])
    return out.where("a < b").select("a", "b", "ratio").distinct()


def resolve_names(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mention, id, how: the entity that a name in a relation means. mentions: mention; entities: id, name. Names are cut at
    commas; each part takes the entity of the same name (exact), of the same normalised name (normalised), or the least
    entity of which one name holds the other, both over three characters (contained)."""
    parts = mentions.select(F.explode(F.filter(F.transform(F.split("mention", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("mention")).distinct()
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    e = written(entities.select("id", "name", plain(F.col("name")).alias("plain")), "entities")
    m = written(parts.select("mention", plain(F.col("mention")).alias("plain")), "mentions")
    exact = m.join(e.groupBy(F.col("name").alias("mention")).agg(F.min("id").alias("id")), "mention").select("mention", "id", F.lit("exact").alias("how"))
    rest = m.join(exact.select("mention"), "mention", "left_anti")
    same = rest.join(e.where("plain <> ''").groupBy("plain").agg(F.min("id").alias("id")), "plain").select("mention", "id", F.lit("normalised").alias("how"))
    rest = written(rest.join(same.select("mention"), "mention", "left_anti").where("length(plain) > 3"), "rest")
    known = e.where("length(plain) > 3")
    inner = holding(rest.select(F.col("mention").alias("id"), F.col("plain").alias("text")), known.select(F.col("id").alias("name_id"), F.col("plain").alias("name"))).toDF("mention", "id")
    outer = holding(known.select("id", F.col("plain").alias("text")), rest.select(F.col("mention").alias("name_id"), F.col("plain").alias("name"))).select(F.col("name_id").alias("mention"), "id")
    held = inner.union(outer).groupBy("mention").agg(F.min("id").alias("id")).select("mention", "id", F.lit("contained").alias("how"))
    return exact.union(same).union(held)


def confidence(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """ord, context, uniqueness, kind, score of entities (ord, name, type, doc, confidence) in the texts (doc, text) that name
    them: 0.4 of the confidence given, 0.3 of the context (0.9 if the text holds the name, else 0.5 and up to 0.3 by the
    share of its words that the text holds, else 0.1), 0.2 of uniqueness among the document's earlier entities (0.1 if the
    first like it has the same name, 0.5 if it holds or is held, else 1) and 0.1 of the type (0.3 if unknown, else 0.8).
    All tables here grow with the texts: none is broadcast, however small its file looks."""
    e = written(entities.select("ord", F.lower("name").alias("name"), "type", "doc", "confidence"), "entities")
    t = texts.select("doc", F.lower("text").alias("low"))
    both = e.join(t.hint("merge"), "doc", "left").withColumn("words", T.tokens(F.col("name")))
    hits = F.size(F.filter("words", lambda w: F.contains(F.coalesce("low", F.lit("")), w)))
    context = F.when(F.contains(F.coalesce("low", F.lit("")), F.col("name")), 0.9).when(hits > 0, 0.5 + 0.3 * hits / F.size("words")).otherwise(0.1)
    scored = both.select("ord", "type", "confidence", context.alias("context"))
    # Earlier entities of the document that hold this one's name or are held by it; the first of them decides.
    n = e.where("doc is not null").select(F.col("ord").alias("id"), F.col("doc").cast("string").alias("block"), "name")
    met = N.held(n).select("a", "b")
    known = e.select("ord", "name").hint("merge")
    pairs = met.select(F.greatest("a", "b").alias("ord"), F.least("a", "b").alias("earlier")).distinct()
    pairs = pairs.join(known, "ord").join(e.select(F.col("ord").alias("earlier"), F.col("name").alias("other")).hint("merge"), "earlier").where(F.col("name").contains(F.col("other")) | F.col("other").contains(F.col("name")))
    first = pairs.groupBy("ord").agg(F.min(F.struct("earlier", F.when(F.col("name") == F.col("other"), 0.1).otherwise(0.5).alias("worth"))).alias("x")).select("ord", "x.worth")
    kind = F.when(F.col("type").isNull() | F.lower("type").isin("", "unknown", "other"), 0.3).otherwise(0.8)
    out = scored.join(first.hint("merge"), "ord", "left").select("ord", "confidence", "context", F.coalesce("worth", F.lit(1.0)).alias("uniqueness"), kind.alias("kind"))
    score = 0.4 * F.col("confidence") + 0.3 * F.col("context") + 0.2 * F.col("uniqueness") + 0.1 * F.col("kind")
    return out.select("ord", "context", "uniqueness", "kind", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))


#: What names a time in a question, tried in this order.
TIMES = (
    r"\b(today|yesterday|tomorrow)\b", r"\b(last|next|this)\s+(week|month|year|day)\b", r"\b\d{4}\b",
    r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b", r"\b(before|after|during|since|until)\b", r"\b(recent|recently|current|currently|now)\b",
)


def mentioned(text: Column) -> Column:
    """Capitalised words and quoted strings, sorted, each once."""
    words = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1)))))


def time_of(text: Column) -> Column:
    """The first expression of time of the first kind that there is, else null."""
    low = F.lower(text)
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in TIMES])


#: Words that are no keywords of a topic.
TOPIC_STOP = (
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "to", "for", "with", "by", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "from", "up", "down", "of", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now",
)


def topic_keywords(sentences: DataFrame, most: int = 10) -> DataFrame:
    """topic, keywords (array): the most frequent words of each topic's sentences (topic, place, text) but stop words and
    those below three characters; of equally frequent ones the first in the text."""
    words = sentences.select("topic", "place", F.posexplode(T.tokens(F.col("text"))).alias("i", "word")).where((F.length("word") > 2) & ~F.col("word").isin(*TOPIC_STOP))
    counts = words.groupBy("topic", "word").agg(F.count("*").alias("n"), F.min(F.struct("place", "i")).alias("first"))
    order = Window.partitionBy("topic").orderBy(F.desc("n"), "first")
    best = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return best.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("keywords"))
