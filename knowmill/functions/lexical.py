"""Rules on names, texts and questions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by domain and questions' patterns by intent, both in order of precedence.
DOMAIN_WORDS = {
    "medical": ("patient", "treatment", "disease", "therapy", "clinical", "health", "symptom", "medic"), "technical": ("software", "system", "algorithm", "data", "computer", "network", "code"),
    "business": ("market", "company", "revenue", "customer", "sales", "profit"), "science": ("research", "theory", "experiment", "hypothesis", "study"),
}
INTENTS = {
    "definition": r"\b(what is|what are|define|meaning of)\b", "comparison": r"\b(compare|versus|difference|better)\b", "causal": r"\b(why|because|cause|reason)\b",
    "procedural": r"\b(how to|how do|steps|process)\b", "temporal": r"\b(when|before|after|date)\b", "factual": r"\b(who|where|which)\b",
}


def document_id(file: Column, checksum: Column) -> Column:
    """doc_, the file's name without folders (other characters than letters, digits, marks as single underscores) and a checksum."""
    base = F.regexp_extract(file, r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_.\-]", "_"), "_+", "_"), "^_|_$", "")
    return F.concat_ws("_", F.lit("doc"), clean, checksum)


def id_type(ident: Column) -> Column:
    kinds = {"doc_": "document", "ent_": "entity", "rel_": "relation", "fact_": "fact"}
    pick = F.when(ident.contains(":chunk:"), "chunk")
    for prefix, kind in kinds.items():
        pick = pick.when(ident.startswith(prefix), kind)
    return pick.otherwise("unknown")


def singular_name(name: Column) -> Column:
    """A name without article and bracketed remarks, its last word in the singular, each word with a capital."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\s*\([^)]*\)", ""), r"^(the|a|an|der|die|das|le|la|les|el|los|las) ", ""))
    single = F.when(bare.rlike("ies$"), F.regexp_replace(bare, "ies$", "y")).when(bare.rlike("(s|x|ch|sh)es$"), F.regexp_replace(bare, "es$", ""))
    return F.initcap(single.when(bare.rlike("[^su]s$"), F.regexp_replace(bare, "s$", "")).otherwise(bare))


def keyword_name(name: Column) -> Column:
    return F.trim(F.lower(F.replace(name, F.lit("_"), F.lit(" "))))


def plain_chunk(text: Column) -> Column:
    """White space collapsed first, then markdown marks of headings, emphasis, code, links and pictures taken off."""
    out = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    for pattern, new in ((r"#+ ", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"`([^`]+)`", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1")):
        out = F.regexp_replace(out, pattern, new)
    return out


def cleaned_markdown(text: Column) -> Column:
    """Unix line ends, no runs of blank lines, sentences that a line break cut in two joined again."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"([a-z,])\n([a-z])", "$1 $2"))


def seconds(text: Column) -> Column:
    """The first [mm:ss] or [hh:mm:ss] of a text in seconds, null without one."""
    part = lambda k: F.regexp_extract(text, r"\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]", k)
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(0))
    return F.when(part(3) != "", number(part(1)) * 3600 + number(part(2)) * 60 + number(part(3)))


def section_title(text: Column) -> Column:
    """The first line below a hundred characters, without time stamps."""
    line = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), r"\[\d{1,2}:\d{2}(:\d{2})?\]", ""))
    return F.when(F.length(line).between(1, 99), line)


def domain(text: Column, least: int = 3) -> Column:
    """The domain of most words found as parts of the text, from ``least`` on; ties to the earlier one."""
    low = F.lower(text)
    hits = {k: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for k, words in DOMAIN_WORDS.items()}
    most = F.greatest(*hits.values())
    pick = F.when(most < least, "general")
    for k, n in hits.items():
        pick = pick.when(n == most, k)
    return pick


def intent_scores(text: Column) -> Column:
    """A map of scores: 0.8 where an intent's pattern is found, 0.1 more with a question mark; general scores 0.5 if none is."""
    low = F.lower(text)
    score = {k: F.when(low.rlike(p), F.least(F.lit(1.0), 0.8 + F.when(low.contains("?"), 0.1).otherwise(0.0))).otherwise(0.0) for k, p in INTENTS.items()}
    none = F.greatest(*score.values()) < 0.3
    pairs = [x for k, v in score.items() for x in (F.lit(k), v)]
    return F.create_map(*pairs, F.lit("general"), F.when(none, 0.5).otherwise(0.0))


def fact_text(subject: Column, relation: Column, target: Column, remark: Column) -> Column:
    """Labelled parts that are not null, joined by full stops."""
    part = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    return F.concat_ws(". ", part("Subject", subject), part("Relation", relation), part("Object", target), part("Remark", remark))


def citation(kind: Column, name: Column, index: Column, **more: Column) -> Column:
    """[type:name:index:key=value ...]; null values are left out."""
    return F.concat(F.lit("["), F.concat_ws(":", kind, name, index, *[F.concat(F.lit(f"{k}="), v) for k, v in more.items()]), F.lit("]"))


def json_object(text: Column) -> Column:
    """The outermost object of a model's answer, without fences and trailing commas."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.regexp_replace(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), r",\s*([}\]])", "$1")
