"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding lower-cases, strips accents and maps homoglyphs and digit substitutions to Latin letters, so that disguised
words meet the lexicon. Weights are log odds of words in toxic and other training documents; exception phrases mask
the hits inside them. The sum of weights, by itself and normalised by the length of the text, goes through a logistic
function fitted on the training rows.

The training rows are a sample of at most ``MAX_TRAIN`` labelled rows (by hash of doc_id); word counts are taken by
Spark, only the lexicon (words that two or more toxic texts of the sample hold, all that are surely more frequent there)
and the sample's three numbers a row reach the driver. Every document is scored over its whole text.

Null and empty texts have no hits and get the score of a text without any. Without labels the seed words have weight 1 and
the logistic function its defaults. Rows that repeat an id are scored each by itself; labels that repeat an id train as
often as they stand there, contradicting ones on both sides, and each meets all rows of its id. Null ids get a score and
train nothing. Only the named columns are read, so that others may have any name; the lexicon has no order, so ties decide
nothing. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table

MAX_TRAIN = 40_000
#: Log odds that a word of the lexicon has at least, and standard errors by which it must exceed them.
LEAST_ODDS, SURE = 1.2, 2.0
#: Characters that stand for a Latin letter.
LOOKALIKES = {
    "a": "4@αа", "b": "8βЬв", "c": "сϲ", "d": "ԁ", "e": "3еє", "h": "һн", "i": "1ıіι|", "j": "ј", "k": "κк", "l": "ⅼ", "m": "мⅿ", "n": "ո",
    "o": "0οоσ", "p": "рρ", "r": "г", "s": "5$ѕ", "t": "7τт", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уү", "z": "2ᴢ",
}
#: Words with a weight even without labels.
SEEDS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "scum", "trash", "loser", "imbecile", "dumb", "idiota", "estupido", "imbecil", "idiote", "stupide", "dummkopf", "abschaum", "wertlos")
#: Phrases in which such words are harmless.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "trash bag", "take out the trash", "idiot proof", "pond scum", "scum of algae", "dumb bell", "dumb waiter", "sad clown paradox", "circus clown")


@functools.cache
def fold_table() -> dict[int, str]:
    out = {ord(c): k for k, chars in LOOKALIKES.items() for c in chars}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isascii() and base.isalpha():
            out[code] = base
    # Full-width letters; zero-width characters vanish.
    out |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
    return out | dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD), "")


def fold(text: str) -> str:
    return text.lower().translate(fold_table())


def _words(folded: str) -> set[str]:
    return {w for w in ("".join(c if c.isalpha() else " " for c in x) if not x.isalpha() else x for x in folded.split()) for w in w.split()}


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: text, toxic. Documents of either kind that hold a folded word, summed a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic == 1].update(w for w in _words(fold(text or "")) if 2 < len(w) < 40)
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    return docs.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(docs: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of words that toxic training documents hold far more often than others."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    sure = word_counts(docs).where("toxic >= 2").withColumn("w", odds).where(F.col("w") - SURE * error > LEAST_ODDS)
    rows = sure.select("word", "w").collect()  # bounded by the words of the sample's toxic texts
    return dict.fromkeys(SEEDS, 1.0) | {r["word"]: r["w"] for r in rows}


class Lexicon:
    """The automaton is built once in each worker."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "_automaton": None}

    def hits(self, folded: str) -> float:
        """The weights of lexicon words in the text that stand alone and in no exception phrase."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for w, x in self.weights.items():
                self._automaton.add_word(w, (len(w), x))
            for p in EXCEPTIONS:
                self._automaton.add_word(p, (len(p), None))
            self._automaton.make_automaton()
        found, masks = [], []
        for end, (n, x) in self._automaton.iter(folded):
            start = end - n + 1
            if (start and folded[start - 1].isalpha()) or (end + 1 < len(folded) and folded[end + 1].isalpha()):
                continue
            (masks if x is None else found).append((start, end, x))
        return sum(x for s, e, x in found if not any(a <= s and e <= b for a, b, _ in masks))

    def features(self, text: str | None) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        total = self.hits(fold(text))
        return math.log1p(total), total / (1 + text.count(" ") / 100)


def _featured(docs: DataFrame, lexicon: Lexicon, extra: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=[extra, "x1", "x2"])

    return docs.select(extra, "text").mapInArrow(run, f"{extra} {kind}, x1 double, x2 double")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps; x without the constant column."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic, training rows only. Returns doc_id, score."""
    sample = labels.where("toxic is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = [(r["doc_id"], int(r["toxic"])) for r in sample.collect()]  # bounded by MAX_TRAIN
    n_toxic = sum(t for _, t in rows)
    coefficients = np.array([-3.0, 1.5, 0.5])
    lexicon = Lexicon(dict.fromkeys(SEEDS, 1.0))
    if rows and 0 < n_toxic < len(rows):
        spark = docs.sparkSession
        train = docs.join(F.broadcast(spark.createDataFrame(rows, "doc_id long, toxic int")), "doc_id")
        lexicon = Lexicon(learn_lexicon(train, n_toxic, len(rows) - n_toxic))
        got = _featured(train, lexicon, "toxic", "int").collect()  # bounded by MAX_TRAIN
        if 0 < sum(r["toxic"] for r in got) < len(got):
            coefficients = fit_logistic(np.array([(r["x1"], r["x2"]) for r in got]), np.array([r["toxic"] for r in got]))
    a, b, c = map(float, coefficients)
    scored = _featured(docs, lexicon, "doc_id", "long")
    return scored.select("doc_id", (1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x1") + F.lit(c) * F.col("x2"))))).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)
    out = score(docs, labels)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
