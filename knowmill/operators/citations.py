"""Citations of facts in answers, as column expressions: where they belong, which stay, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are no keywords of a fact.
STOP = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can",
)
STYLES = ("inline", "footnote", "endnote", "parenthetical", "superscript")
#: Sources of a fact that are cited at most, and citations of a sentence.
SOURCES, A_SENTENCE = 5, 3


def sources_of(documents: Column, entities: Column) -> Column:
    """Names of at most five sources: the documents, without one the entities, without either the graph itself."""
    some = F.when(F.size(documents) > 0, documents).when(F.size(entities) > 0, F.transform(entities, lambda e: F.concat(F.lit("entity_"), e))).otherwise(F.array(F.lit("unknown")))
    return F.slice(some, 1, SOURCES)


def source_confidence(confidence: Column, title: Column, author: Column, date: Column, url: Column) -> Column:
    """The fact's confidence, more for what is known of its source; at most 1."""
    known = lambda c, worth: F.when(c.isNotNull() & (c != ""), worth).otherwise(0.0)
    return F.least(F.lit(1.0), confidence + known(title, 0.1) + known(author, 0.1) + known(date, 0.1) + known(url, 0.05))


def source_status(sources: Column, confidence: Column) -> Column:
    return F.when(F.size(sources) == 0, "no_sources").when(confidence >= 0.8, "verified").when(confidence >= 0.5, "partially_verified")


def citation_text(kind: Column, name: Column, place: Column, more: Column) -> Column:
    """[kind:name:place] or [kind:name:place:more]."""
    return F.concat(F.lit("["), F.concat_ws(":", F.coalesce(kind, F.lit("document")), name, F.coalesce(place, F.lit("0")), F.nullif(more, F.lit(""))), F.lit("]"))


def fact_keywords(text: Column, most: int = 10) -> Column:
    """The longest distinct words (the first in order among equals) that are no stop words."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))
    return F.transform(F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, most), lambda x: x["w"])


def places(text: Column, word: Column) -> Column:
    """Starts of all places of a word (letters and digits) in a lower-cased text, found from left to right."""
    gaps = F.split(text, word, -1)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda a, gap: F.struct((a["at"] + F.length(gap) + F.length(word)).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(gap))).alias("found"))
    return F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), first, step, lambda a: a["found"])


def citation_spans(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answer_id, content, spans: the citations of each answer (answer_id, content), in order and apart from each other; each
    is a struct of start, stop, fact_id, score, source. facts: answer_id, fact_id, text, score, source.

    Every place of a fact's keywords is a candidate; of several facts at one place the first (by fact_id) is taken. From left
    to right, the longest at a start first, a candidate that overlaps one taken before falls away. A sentence keeps its three
    most certain ones (the earlier among equals)."""
    met = answers.select("answer_id", F.lower("content").alias("low")).join(facts, "answer_id")
    met = met.select("answer_id", "low", "fact_id", "score", "source", F.explode(fact_keywords(F.col("text"))).alias("word"))
    met = met.select("answer_id", "fact_id", "score", "source", F.length("word").alias("n"), F.explode(places(F.col("low"), F.col("word"))).alias("start"))
    best = met.groupBy("answer_id", "start", "n").agg(F.min(F.struct("fact_id", "score", "source")).alias("x"))
    item = F.struct("start", (-F.col("n")).alias("minus"), (F.col("start") + F.col("n")).alias("stop"), "x.fact_id", "x.score", "x.source")
    lists = best.groupBy("answer_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    both = answers.join(lists, "answer_id", "left").withColumn("spans", _apart(F.coalesce("all", F.array().cast(lists.schema["all"].dataType))))
    return both.select("answer_id", "content", _certain(F.col("spans"), F.col("content")).alias("spans"))


def _apart(spans: Column) -> Column:
    """Spans that do not overlap an earlier one that is taken; spans come sorted."""
    last = lambda a: F.coalesce(F.element_at(a, -1)["stop"], F.lit(-1))
    return F.aggregate(spans, F.slice(spans, 1, 0), lambda a, x: F.when(F.when(F.size(a) == 0, True).otherwise(last(a) <= x["start"]), F.concat(a, F.array(x))).otherwise(a))


def _certain(spans: Column, content: Column) -> Column:
    """The three most certain spans of each sentence, in order of place."""
    sentence = lambda x: F.regexp_count(F.substr(content, F.lit(1), x["start"]), F.lit(r"[.!?]+"))
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(sentence(x).alias("sentence"), (-x["score"]).alias("minus"), x["start"].alias("start"), x.alias("x"))))
    kept = F.filter(ranked, lambda r, i: (i < A_SENTENCE) | (F.get(ranked, F.greatest(i - A_SENTENCE, F.lit(0)))["sentence"] != r["sentence"]))
    return F.array_sort(F.transform(kept, lambda r: r["x"]))


def render(content: Column, spans: Column, style: str) -> Column:
    """The content with a mark behind each span, numbered from the left, and the list that footnotes and endnotes ask for."""
    mark = {"footnote": lambda x, i: F.concat(F.lit("["), i + 1, F.lit("]")), "superscript": lambda x, i: F.concat(F.lit("^"), i + 1)}
    mark["endnote"] = mark["footnote"]
    write = mark.get(style, lambda x, i: F.concat(F.lit(" "), x["source"]))
    piece = lambda x, i: F.concat(F.substr(content, before(i) + 1, x["stop"] - before(i)), write(x, i))
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, F.greatest(i - 1, F.lit(0)))["stop"])
    body = F.concat(F.array_join(F.transform(spans, piece), ""), F.substr(content, F.coalesce(F.try_element_at(spans, F.lit(-1))["stop"], F.lit(0)) + 1))
    title = {"footnote": "Footnotes", "endnote": "References"}.get(style)
    if not title:
        return body
    notes = F.array_join(F.transform(spans, lambda x, i: F.concat(i + 1, F.lit(". "), x["source"])), "\n")
    return F.when(F.size(spans) == 0, body).otherwise(F.concat(body, F.lit(f"\n\n## {title}\n"), notes))


def verification(spans: Column) -> Column:
    """How many citations name a source."""
    share = F.size(F.filter(spans, lambda x: x["source"].isNotNull() & ~x["source"].contains(":unknown:"))) / F.size(spans)
    return F.when(F.size(spans) == 0, "no_citations").when(share >= 0.9, "verified").when(share >= 0.7, "partially_verified").otherwise("unverified")
