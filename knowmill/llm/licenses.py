"""License detection by ordered signature rules, as DataFrame expressions only.

``license_rules`` holds some hundreds of hand-written signatures. A text is first gated by keywords; only texts that pass
are normalised to words joined by single spaces, and a label's signatures are matched only in texts with one of the label's
own keywords. A detection whose words lie inside a longer one's is suppressed, also by phrases that only look like a
license; where two overlap otherwise, the one of the rule of higher priority stays (then the longer, the earlier, the lesser label).

Null texts count as empty: no words, no labels, score 0. Whole texts of any length are searched. Rows that repeat an id are searched each by
itself; ids are not read. Extra columns stay, but for those named as the added ones. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, beside, table
from .license_rules import OTHER, SIGNATURES

#: What stands between words: ASCII other than digits and lower-case letters, once A-Z are lower-cased.
GAPS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))
#: Phrases of the base, by label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
KINDS = ("spdx", "text", "grant", "name")
#: A label's identifiers: what its signatures have behind "spdx license identifier".
ID_LINE = "spdx license identifier "
IDS = {label: [p.removeprefix(ID_LINE) for p in kinds.get("spdx", ()) if p.startswith(ID_LINE)] for label, kinds in SIGNATURES.items()}
ANY_ID = "(?:" + "|".join(sorted({x for ids in IDS.values() for x in ids}, key=lambda x: (-len(x), x))) + ")"
#: An identifier counts beside another one and a conjunction; of such a pair each covers its own words.
JOINED = {label: [p for x in ids for p in (f"(?<= {ANY_ID} (?:or|and) ){x}", f"{x}(?= (?:or|and) {ANY_ID} )")] for label, ids in IDS.items()}
KEYS = {label: kinds["keys"] for label, kinds in SIGNATURES.items()}
#: Keys of identifiers in pairs; what opens the gate to such a text is one of the other keys.
PAIRED = {label: tuple(sorted({f" {x.split()[0]} " for x in ids if x.split()[0].isalnum()})) for label, ids in IDS.items()}
#: What the keys of most labels hold; with the keys that hold none of it, what a text must have to be looked at.
STEMS = ("licen", "copyright", "reserved", "permission", "commons", "domain", "software", "identifier", "all rights")
GATE = STEMS + tuple(sorted({k for keys in KEYS.values() for k in keys if not any(x in k for x in STEMS)}))


def rules() -> list[tuple[int, str, str]]:
    """(priority, pattern over normalised words, label): the lower the number the higher the priority. Phrases that are no
    license have the label "" and the last priority."""
    made = [(0, p, x) for p, x in BASE.items()]
    for label, kinds in SIGNATURES.items():
        made += [(1 + k, p, label) for k, kind in enumerate(KINDS) for p in sorted(kinds.get(kind, ()), key=len, reverse=True)]
        made += [(len(KINDS), p, label) for p in JOINED[label]]
    return made + [(1 + len(KINDS), p, "") for p in OTHER]


def _pattern(priority_rules: list[tuple[int, str, str]], label: str) -> str:
    """All forms of one label in order of priority; a word's edges are single spaces."""
    return "(?<= )(?:" + "|".join(p for _, p, x in priority_rules if x == label) + ")(?= )"


def _priority(hit: Column, label: str) -> Column:
    """The priority of the first of the label's rules that a hit fits."""
    tiers = sorted({k for k, _, x in rules() if x == label})
    fits = [hit.rlike("^(?:" + "|".join(p for n, p, x in rules() if x == label and n == k) + ")$") for k in tiers]
    return F.coalesce(*[F.when(f, k) for f, k in zip(fits, tiers, strict=True)], F.lit(tiers[-1]))


def _spans(spans: Column, label: str) -> Column:
    """Hits with their first and past-the-end words. A hit starts after the words of all gaps and hits before
    it, a gap's text ending with a space."""
    words = lambda h: F.length(h) - F.length(F.replace(h, F.lit(" "), F.lit("")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + words(x["hit"])
        one = F.struct(F.lit(label).alias("label"), start.alias("start"), (end + 1).alias("end"), _priority(x["hit"], label).alias("priority"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    first = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<label:string,start:int,end:int,priority:int>>").alias("out"))
    return F.aggregate(spans, first, step)["out"]


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double) and
    detections (array of label, start and end word, priority)."""
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    return beside(df, {"_text": text}, added, _detect)


def _detect(df: DataFrame) -> DataFrame:
    every = rules()
    t = F.coalesce(F.col("_text"), F.lit(""))
    # One pass lower-cases A-Z and turns all that stands between words into spaces.
    spaced = F.translate(t, GAPS + UPPER, " " * len(GAPS) + UPPER.lower())
    df = df.withColumn("_low", F.concat(F.lit(" "), spaced, F.lit(" ")))
    df = df.withColumn("n_words", F.regexp_count("_low", F.lit("[^ ]+")).cast("long"))
    # Gaps of several characters would part the words of keywords and phrases.
    df = df.withColumn("_low", F.regexp_replace("_low", "  +", " "))
    gate = reduce(or_, [F.col("_low").contains(k) for k in GATE])
    df = df.withColumn("_n", F.when(gate, F.col("_low")))
    base = {p: F.regexp_count("_n", F.lit(f"(?<= ){p}(?= )")) for p in BASE}
    any_base = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    df = df.withColumn("n_base", F.coalesce(reduce(lambda a, b: a + b, base.values()), F.lit(0)).cast("long"))
    words_before = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) - 1
    first = F.regexp_extract("_n", f"(?s)^(.*?){any_base}", 1)
    last = F.regexp_extract("_n", f"(?s)^(.*){any_base}", 1)
    df = df.withColumn("first_word", F.when(F.col("n_base") > 0, words_before(first)).cast("long"))
    df = df.withColumn("last_word", F.when(F.col("n_base") > 0, words_before(last)).cast("long"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    held = F.array(*[F.when(F.regexp_count("_n", F.lit(f"(?<= ){p}(?= )")) > 0, F.lit(x)) for p, x in BASE.items()])
    df = df.withColumn("_base", F.when(F.col("n_base") > 0, F.array_compact(held)).otherwise(F.array().cast("array<string>")))
    found = []
    for label in sorted({x for _, _, x in every}):
        held = reduce(or_, [F.col("_n").contains(k) for k in KEYS[label] + PAIRED[label]]) if label else F.lit(True)
        hits = F.regexp_extract_all("_n", F.lit(f"({_pattern(every, label)})"), F.lit(1))
        starts = F.transform(F.slice(F.split("_n", _pattern(every, label), -1), 1, F.greatest(F.size(hits), F.lit(1))), lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))))
        spans = F.arrays_zip(hits.alias("hit"), starts.alias("gap"))
        found.append(F.when(held & (F.size(hits) > 0), _spans(spans, label)))
    df = df.withColumn("_all", F.when(F.col("_n").isNotNull(), F.flatten(F.array_compact(F.array(*found)))))
    inside = lambda a, b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & ((b["end"] - b["start"]) > (a["end"] - a["start"]))
    outer = F.filter("_all", lambda a: ~F.exists("_all", lambda b: inside(a, b)))
    # In order of priority, a detection stays that meets none that stayed before.
    place = F.transform(outer, lambda a: F.struct(a["priority"].alias("priority"), (a["start"] - a["end"]).alias("shorter"), a["start"].alias("start"), a["label"].alias("label"), a["end"].alias("end")))
    df = df.withColumn("_outer", F.array_sort(place))
    meets = lambda a, b: (b["start"] < a["end"]) & (a["start"] < b["end"])
    df = df.withColumn("_stay", F.aggregate("_outer", F.slice("_outer", 1, 0), lambda some, a: F.when(F.exists(some, lambda b: meets(a, b)), some).otherwise(F.concat(some, F.array(a)))))
    named = lambda a: F.struct(a["label"].alias("label"), a["start"].alias("start"), a["end"].alias("end"), a["priority"].alias("priority"))
    stay = F.transform(F.filter("_stay", lambda a: a["label"] != ""), named)
    df = df.withColumn("detections", F.coalesce(stay, F.array().cast("array<struct<label:string,start:int,end:int,priority:int>>")))
    df = df.withColumn("base_labels", joined(F.col("_base")))
    df = df.withColumn("labels", joined(F.concat("_base", F.transform("detections", lambda d: d["label"]))))
    covered = F.aggregate("detections", F.lit(0), lambda a, d: a + d["end"] - d["start"])
    score = F.when(F.col("labels") == "", 0.0).otherwise(F.least(F.lit(1.0), 0.5 + covered / F.greatest(F.col("n_words"), F.lit(1)) / 2))
    return df.withColumn("score", score.cast("double"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").alias("n_detections")
    )
