"""Spelling variants: frequent words are the forms of rarer ones that differ by one inserted, deleted or replaced letter.

A word's letters, each with its count so far, are a set (a binary vector); words one edit apart differ in at most two of
its elements. PartEnum deals the elements to ``PARTS`` parts and enumerates each choice of all parts but two: two words at
distance two or less agree wholly on one choice at least, so an equi-join on the choices' hashes loses no pair. Words that
share a choice of more than ``LARGE`` words meet only if half of their letters agree in place as well (of two words one edit
apart, either the first or the last half does), which loses none either. Pairs that meet are verified by edit distance.

Forms have ``ratio`` times their word's count at least, so chains are short: their ends are found by doubling, in a number
of rounds that follows from the largest count.

Defined cases: null and empty texts hold no words; a null id counts as empty where ids are hashed. Rows that repeat an id
count each. Ties between forms go to the least word in code-point order. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stash, table

RUN = re.compile("[a-zÀ-ÿ]+")
#: Parts of a word's elements; two of them are left out of each signature.
PARTS = 6
#: Words of one signature beyond which they are told apart by the places of their letters too.
LARGE = 32
#: Distinct words that a task counts before it hands them on.
HELD = 300_000


def count_words(batches: Iterable[pa.RecordBatch], least_chars: int, slip: int) -> Iterator[pa.RecordBatch]:
    """word, n of each task's texts. Runs of letters lose one letter where the crc32 of ``<doc_id>:<run>`` is a multiple of
    ``slip`` (0: never)."""
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for b in batches:
        for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
            # Of bytes, lower() changes A-Z only.
            start = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                if len(run) < least_chars:
                    continue
                h = zlib.crc32(run.encode(), start) if slip else 1
                if slip and h % slip == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least_chars:
                        continue
                counts[run] += n
            if len(counts) > HELD:
                yield out()
                counts.clear()
    if counts:
        yield out()


def vocabulary(docs: DataFrame, least_chars: int = 6, least_n: int = 5, slip: int = 0) -> DataFrame:
    """word, n of the words of all texts that are long and frequent enough. docs: doc_id, text."""
    some = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    counted = some.mapInArrow(lambda batches: count_words(batches, least_chars, slip), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _signed(words: DataFrame) -> DataFrame:
    """words with sig, a hash for each choice of all parts but two of a word's elements. Each step is a projection of its
    own, so that nothing is computed again for each signature."""
    letters = words.withColumn("letters", F.sort_array(F.split("word", "")))
    element = F.transform("letters", lambda x, i: F.concat(x, (i - F.array_position("letters", x)).cast("string")))
    dealt = letters.withColumn("element", element).withColumn("dealt", F.transform("element", lambda e: F.struct(e.alias("e"), F.pmod(F.xxhash64(e), F.lit(PARTS)).alias("part"))))
    part = lambda k: F.array_join(F.transform(F.filter("dealt", lambda x: x["part"] == k), lambda x: x["e"]), ",")
    parts = dealt.select(*words.columns, *[part(k).alias(f"part{k}") for k in range(PARTS)])
    sigs = [F.xxhash64(F.lit(i), *[f"part{k}" for k in range(PARTS) if k not in out]) for i, out in enumerate(combinations(range(PARTS), 2))]
    return parts.select(*words.columns, F.explode(F.array(*sigs)).alias("sig"))


def _halves(word: Column) -> Column:
    """(length of a pair's shorter word, hash of its first or last half) for each part that the word may play in a pair."""
    n = F.length(word)
    one = lambda short: (
        F.struct(short.alias("short"), F.xxhash64(F.lit("first"), F.substring(word, F.lit(1), F.floor(short / 2).cast("int"))).alias("half")),
        F.struct(short.alias("short"), F.xxhash64(F.lit("last"), F.right(word, short - F.floor(short / 2).cast("int"))).alias("half")),
    )
    return F.array(*one(n), *one(n - 1))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb of each two words that are one edit apart, a before b. words: distinct word, n."""
    signed = stash(_signed(words.select("word", "n")), "signed")
    large = signed.groupBy("sig").agg(F.count("*").alias("many")).where(F.col("many") > LARGE)
    whole = F.array(F.struct(F.lit(0).alias("short"), F.lit(0).cast("long").alias("half")))
    met = signed.join(large, "sig", "left").withColumn("at", F.explode(F.when(F.col("many").isNull(), whole).otherwise(_halves(F.col("word")))))
    met = stash(met.select("sig", "at.short", "at.half", "word", "n"), "met")
    a, b = (met.select("sig", "short", "half", F.col("word").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    shorter = F.least(F.length("a"), F.length("b"))
    near = (F.col("a") < F.col("b")) & ((F.col("short") == 0) | (F.col("short") == shorter)) & (F.levenshtein("a", "b", 1) == 1)
    out = stash(a.join(b, ["sig", "short", "half"]).where(near).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")), "near")
    release(signed, met)
    return out


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root: the end of the chain of forms, of at most ``steps`` steps. forms: word, form."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stash(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        release(at)
        at = new
    return at


def spelling_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) of each word. words: distinct word, n; it is read several times."""
    if ratio < 2:
        raise ValueError("forms must be twice as frequent as their word at least")
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("b", "a", "nb", "na")).toDF("word", "other", "n", "other_n")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    known = words.join(near, "word", "left")
    fits = -F.col("best.minus") >= ratio * F.col("n")
    known = stash(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")), "forms")
    forms = known.where("form is not null")
    most, least = forms.agg(F.max("form_n"), F.min("n")).first()
    roots = _roots(forms, int(math.log(most / least, ratio)) + 1 if most else 0)
    out = known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    release(pairs)
    return out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(stash(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=199), "vocabulary"))
