"""Column expressions for identifiers, normalisation, similarity and lexical classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning of their own.
STOP = ("about", "after", "also", "been", "from", "have", "into", "more", "only", "other", "over", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "what", "when", "which", "will", "with", "would", "your")
#: Frequent words by language, in order of precedence.
LANGUAGE_WORDS = {"en": ("the", "and", "that", "with", "of"), "de": ("der", "die", "und", "das", "nicht"), "fr": ("le", "les", "des", "que", "est"), "es": ("el", "los", "que", "en", "las")}


def clean_name(name: Column) -> Column:
    """Lower case, other characters than letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def entity_id(name: Column) -> Column:
    """A readable prefix and the first eight digits of a digest of the lower-cased name; a digest alone for names of marks."""
    digest = F.sha2(F.lower(name), 256)
    clean = clean_name(name)
    return F.concat_ws("_", F.lit("ent"), F.when(clean == "", F.substring(digest, 1, 16)).otherwise(clean), F.substring(digest, 1, 8))


def relation_id(src: Column, dst: Column, kind: Column) -> Column:
    """The same for both directions."""
    digest = F.sha2(F.concat_ws(":", F.least(src, dst), F.greatest(src, dst), kind), 256)
    return F.concat_ws("_", F.lit("rel"), F.lower(kind), F.substring(digest, 1, 9))


def label(kind: Column, prefix: str = "TYPE_") -> Column:
    """An upper-case label of letters, digits and single underscores that starts with a letter."""
    clean = F.regexp_replace(F.regexp_replace(F.upper(kind), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(clean.rlike("^[A-Z]"), clean).otherwise(F.concat(F.lit(prefix), clean))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two texts; 0 for two empty ones."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when(F.size(x) + F.size(y) == 0, 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def edit_similarity(a: Column, b: Column) -> Column:
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def keywords(text: Column) -> Column:
    """Lower-cased words of four ASCII letters or more outside the stop list, with repeats."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP))


def language(text: Column, chars: int | None = 1000) -> Column:
    """The language of most frequent-word hits among the first ``chars`` characters (None: all); ties to the earlier language."""
    words = tokens(F.substring(text, 1, chars) if chars else text)
    held = lambda some: F.size(F.filter(words, lambda w: w.isin(*some)))
    hits = {k: held(v) for k, v in LANGUAGE_WORDS.items()}
    most = F.greatest(*hits.values())
    pick = reduce(lambda c, k: c.when(hits[k] == most, k), list(hits)[1:], F.when(hits["en"] == most, "en"))
    return F.when(F.length(text) < 10, "unknown").when(most == 0, "unknown").otherwise(pick)


def intent(text: Column) -> Column:
    """Ordered keyword test of a query."""
    has = lambda *w: F.lower(text).rlike(r"\b(" + "|".join(w) + r")\b")
    return F.when(has("compare", "versus", "difference"), "comparison").when(has("how", "steps"), "procedural").when(has("why", "because"), "causal").when(has("when", "date"), "temporal").when(has("who", "where", "what", "which"), "factual").otherwise("general")


def content_type(url: Column) -> Column:
    """The kind of source that a url or path names, by site and then suffix."""
    suffix = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return (
        F.when(url.rlike(r"(?i)^https?://(www\.|m\.)?(youtube\.com|youtu\.be)/"), "YOUTUBE").when(url.rlike("(?i)^https?://"), "WEB")
        .when(suffix.isin("mp4", "avi", "mov", "mkv", "webm"), "VIDEO").when(suffix.isin("mp3", "wav", "m4a", "flac", "ogg"), "AUDIO")
        .when(suffix.isin("pdf", "docx", "doc", "pptx", "xlsx"), "DOCUMENT").otherwise("TEXT")
    )


def web_quality(text: Column) -> Column:
    """The mean of length, a constant and headings, between 0 and 1."""
    words = F.size(tokens(text))
    return (F.least(F.lit(1.0), words / 100) + 0.9 + F.when(text.contains("# "), 0.8).otherwise(0.5)) / 3


def generic_name(name: Column) -> Column:
    """True for placeholder, short and punctuation-only names."""
    low = F.lower(F.trim(name))
    return (F.length(low) < 3) | low.isin("unknown", "none", "n/a", "entity", "other", "misc") | low.rlike(r"^(the|a|this) [a-z]{1,3}$") | ~low.rlike(r"\p{L}")


def time_label(seconds: Column) -> Column:
    """Whole seconds as MM:SS, with hours in front where there are any."""
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    hours = F.when(seconds >= 3600, F.concat(two(seconds / 3600), F.lit(":"))).otherwise("")
    return F.concat(hours, two(F.pmod(F.floor(seconds / 60), F.lit(60))), F.lit(":"), two(F.pmod(seconds, F.lit(60))))
