"""Log-bilinear language model trained by noise-contrastive estimation, beside an add-0.1 unigram base.

Every word has a leaf: the most frequent training words, which make up ``COVER`` of the training tokens at any size of the
corpus, one each, all others the leaf of their last two characters. Leaves stand in ``side`` classes of ``side`` leaves;
``side`` grows with the number of words of their own, without a bound, and so does what the model holds. The vector of the ``CONTEXT`` leaves before a token, a bilinear form of their embeddings, scores first the
classes and then the leaves of the token's class, by products with their embeddings; a word has its leaf's probability
times its share of the leaf's counts. So all words are modelled, and probabilities sum to 1 over all words and one unseen word
of each shared leaf. Both steps are normalised by batched matrix products.

Counts of all tokens come from blocks of documents with their own vocabularies, by one aggregation on words, and go back
to the blocks as numbers. For training, each document's leaves go to a worker given by a hash of the document, which also
gives its round, so that file layout and partitions do not matter; a worker trains over its documents in order of id, in
numpy, with noise of its own seed, and parameters are averaged by tokens after each round. A worker's
share is about ``WORKER_TOKENS`` tokens at any size of the input.

Null texts count as empty: their only token is the end. A null ``train`` counts as false; documents
with a null or repeated doc_id are trained on and scored like others. Texts may have any length that fits a task. Only doc_id, text and
train are read. Empty tables give no rows.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, stash, table, tidy

END = "\n"
#: Numbers of an embedding; words of a context; noise samples of a batch, for classes and for the leaves of a class; rounds.
WIDTH, CONTEXT, NOISE, LEAF_NOISE, ROUNDS = 16, 3, 16, 8, 2
#: Learning rate; tokens of a worker and steps it takes at least; bytes of text in a block.
RATE, WORKER_TOKENS, STEPS, BLOCK_BYTES = 0.3, 2_000_000, 400, 10_000_000
#: Share of the training tokens whose words have leaves of their own.
COVER = 0.5
#: Parameters that a row of a worker's result holds.
WIDE = 64
#: Token numbers are kept in two planes of 16 bits, of which the high one is mostly nought.
BLOCK = "block long, docs binary, named binary, lengths binary, low binary, high binary, train binary, words array<string>, n_train array<int>"


def _block(ids: pa.Array, texts: pa.Array, train: np.ndarray) -> dict:
    """Tokens of a block as numbers of its own vocabulary."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parents, flat = pc.list_parent_indices(words).to_numpy(), words.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    lengths = np.bincount(parents[real], minlength=len(ids))
    tokens = np.insert(coded.indices.to_numpy(), np.cumsum(lengths), len(coded.dictionary)).astype(np.int32)
    lengths = lengths + 1
    seen = np.repeat(train, lengths)
    return {
        "docs": pc.fill_null(ids, 0).to_numpy().tobytes(), "named": pc.is_valid(ids).to_numpy(zero_copy_only=False).tobytes(), "lengths": lengths.astype(np.int64).tobytes(), "low": tokens.astype(np.uint16).tobytes(), "high": (tokens >> 16).astype(np.uint16).tobytes(), "train": train.tobytes(),
        "words": pa.concat_arrays([coded.dictionary, pa.array([END])]),
        "n_train": pa.array(np.bincount(tokens[seen], minlength=len(coded.dictionary) + 1).astype(np.int32)),
    }


def to_blocks(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, train = batch.column(0), pc.fill_null(batch.column(2), False).to_numpy(zero_copy_only=False)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            for part in np.split(np.arange(len(ids)), np.searchsorted(sizes, np.arange(BLOCK_BYTES, sizes[-1] if len(sizes) else 0, BLOCK_BYTES))):
                if len(part):
                    b = _block(ids.slice(part[0], len(part)), batch.column(1).slice(part[0], len(part)), train[part])
                    cols = [pa.array([next(numbers)], pa.int64()), *[pa.array([b[k]], pa.binary()) for k in ("docs", "named", "lengths", "low", "high", "train")]]
                    cols += [pa.ListArray.from_arrays(pa.array([0, len(b[k])], pa.int32()), b[k]) for k in ("words", "n_train")]
                    yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in BLOCK.split(", ")])

    return docs.select("doc_id", "text", "train").mapInArrow(run, BLOCK)


class Leaves:
    """Leaf numbers of words: class * side + place within the class."""

    def __init__(self, top: list[str], side: int):
        self.side, self.top = side, pa.array(top, pa.string())

    def of(self, words: pa.Array) -> np.ndarray:
        half = self.side * self.side // 2
        rank = pc.index_in(words, value_set=self.top)
        tails = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        shared = np.array([zlib.crc32(x.encode()) % half for x in tails.dictionary.to_pylist()], dtype=np.int64)
        number = half + (shared[tails.indices.to_numpy()] if len(words) else shared)
        own = pc.fill_null(rank, -1).to_numpy(zero_copy_only=False)
        number = np.where(own >= 0, own, number)
        return (number % self.side * self.side + number // self.side).astype(np.int32)


def side_for(n_own: int) -> int:
    """Classes and leaves of a class: a power of two (8 at least), so that words of their own take half of the leaves at most."""
    return int(2 ** max(3, np.ceil(np.log2(2 * max(n_own, 1)) / 2)))


def leaf_type(side: int) -> type:
    return np.uint16 if side <= 256 else np.uint32


class Model:
    """Context vector q = sum of c[j] * R[leaf j words back]; scores q . A[class] + a[class] and, within a class,
    q . B[leaf] + b[leaf]. R has one row more, for places before a text."""

    def __init__(self, counts: np.ndarray, side: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.side, n = side, side * side
        # Smoothed shares: of classes, and of leaves within their class.
        leaf = (counts + 0.5).reshape(side, side)
        self.prior = leaf.sum(axis=1) / leaf.sum()
        self.within = (leaf / leaf.sum(axis=1, keepdims=True)).ravel()
        self.sums, self.log_kl = np.cumsum(self.within), np.log(LEAF_NOISE * self.within).astype(np.float32)
        self.p = {
            "R": rng.normal(0, 0.3, (n + 1, WIDTH)), "c": np.ones((CONTEXT, WIDTH)) / CONTEXT, "A": np.zeros((side, WIDTH)), "a": np.log(self.prior),
            "B": np.zeros((n, WIDTH)), "b": np.log(self.within),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def context(self, before: np.ndarray) -> np.ndarray:
        """before: leaves one to CONTEXT words back, a row each."""
        return sum(self.p["R"][w] * c for w, c in zip(before, self.p["c"], strict=True))

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def fill(self, flat: np.ndarray) -> None:
        for name, v in self.p.items():
            self.p[name], flat = flat[: v.size].reshape(v.shape).astype(np.float32), flat[v.size :]

    def step(self, before: np.ndarray, leaf: np.ndarray, rng: np.random.Generator, squares: dict) -> None:
        """One noise-contrastive step: noise classes are shared by the batch, noise leaves by the batch's tokens of a class.
        Only rows that the batch touches change."""
        p, side, m = self.p, self.side, len(leaf)
        q, cls = self.context(before), leaf // side
        noise = rng.choice(side, NOISE, p=self.prior)
        log_kn = np.log(NOISE * self.prior).astype(np.float32)
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, p["A"][cls]) + p["a"][cls] - log_kn[cls]))
        down = 1 / (1 + np.exp(-(q @ p["A"][noise].T + p["a"][noise] - log_kn[noise])))
        dq = up[:, None] * p["A"][cls] - down @ p["A"][noise]
        change = {
            "A": _sums(np.concatenate([cls, noise]), np.concatenate([up[:, None] * q, -(down.T @ q)])),
            "a": _sums(np.concatenate([cls, noise]), np.concatenate([up, -down.sum(axis=0)])),
        }
        log_kl = self.log_kl
        own = p["B"][leaf]
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) + p["b"][leaf] - log_kl[leaf]))
        dq += up[:, None] * own
        # Leaves are drawn by their share within the class, as places in the running sum over all leaves.
        places = np.arange(side)[:, None] + rng.random((side, LEAF_NOISE))
        drawn = np.searchsorted(self.sums, places, side="right")
        drawn = np.clip(drawn, np.arange(side)[:, None] * side, np.arange(side)[:, None] * side + side - 1)
        order = np.argsort(cls.astype(leaf_type(side)), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(side + 1))
        sorted_q, pulls = q[order], np.empty_like(q)
        noise_b, noise_B = np.zeros(drawn.shape, np.float32), np.zeros((*drawn.shape, WIDTH), np.float32)
        B, offset = p["B"][drawn], p["b"][drawn] - log_kl[drawn]
        for c in np.flatnonzero(np.diff(cuts)):
            rows = sorted_q[cuts[c] : cuts[c + 1]]
            down = 1 / (1 + np.exp(-offset[c] - rows @ B[c].T))
            pulls[cuts[c] : cuts[c + 1]] = down @ B[c]
            noise_B[c], noise_b[c] = down.T @ rows, down.sum(axis=0)
        dq[order] -= pulls
        both = np.concatenate([leaf, drawn.ravel()])
        change["B"] = _sums(both, np.concatenate([up[:, None] * q, -noise_B.reshape(-1, WIDTH)]))
        change["b"] = _sums(both, np.concatenate([up, -noise_b.ravel()]))
        change["R"] = _sums(before.ravel(), np.concatenate([dq * c for c in p["c"]]))
        change["c"] = np.arange(CONTEXT), np.stack([np.einsum("ij,ij->j", dq, p["R"][w]) for w in before])
        for name, (at, g) in change.items():
            g = g / m
            if name not in squares:
                squares[name] = np.full(p[name].shape, 1e-4, np.float32)
            squares[name][at] += g * g
            p[name][at] += (RATE * g / np.sqrt(squares[name][at])).astype(np.float32)

    def train(self, before: np.ndarray, leaf: np.ndarray, rng: np.random.Generator) -> None:
        """A pass over all positions in random order."""
        one_thread()
        order, squares = rng.permutation(len(leaf)), {}
        size = int(np.clip(len(leaf) // STEPS, 64, 16384))
        for i in range(0, len(leaf), size):
            at = order[i : i + size]
            self.step(before[:, at], leaf[at], rng, squares)

    def log_probs(self, before: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Normalised natural-log probabilities of leaves."""
        p, side = self.p, self.side
        q, cls = self.context(before), leaf // side
        out = _log_share(q @ p["A"].T + p["a"], cls)
        order = np.argsort(cls.astype(leaf_type(side)), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(side + 1))
        for c in range(side):
            at = order[cuts[c] : cuts[c + 1]]
            if len(at):
                own = slice(c * side, c * side + side)
                out[at] += _log_share(q[at] @ p["B"][own].T + p["b"][own], leaf[at] - c * side)
        return out


@functools.cache
def one_thread() -> None:
    """Matrix products of a task run on the task's own core: threads beside it would only take others' time. Where numpy
    comes with another library for them, nothing changes."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def _sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur, in order, and the sums of their rows."""
    order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")
    at = at[order]
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[heads], np.add.reduceat(rows[order], heads, axis=0)


def _log_share(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at its own place; scores are overwritten."""
    if len(scores) and max(scores.max(), -scores.min()) > 60:
        scores -= scores.max(axis=1, keepdims=True)
    own = scores[np.arange(len(at)), at].astype(np.float64)
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32)).astype(np.float64)


def contexts(leaf: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Leaves one to CONTEXT words before each token of texts in a row, ``start`` where the text has none."""
    place = np.arange(len(leaf)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.stack([np.where(place >= k, np.roll(leaf, k), start).astype(np.int32) for k in range(1, CONTEXT + 1)])


def _unpack(batch: pa.RecordBatch, i: int) -> dict:
    """The arrays of a block."""
    raw = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), dtype=kind)
    tokens = raw("low", np.uint16) | (raw("high", np.uint16).astype(np.int32) << 16)
    return {"docs": raw("docs", np.int64), "named": raw("named", bool), "lengths": raw("lengths", np.int64), "tokens": tokens, "train": raw("train", bool)}


def shares(blocks: DataFrame, leaves: Leaves, workers: int) -> DataFrame:
    """worker, round, doc_id, leaves (binary) of the training documents, dealt by hashes of their ids and leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpack(batch, i)
                leaf = leaves.of(batch.column("words")[i].values)[x["tokens"]]
                ends = np.cumsum(x["lengths"])
                (on,) = np.nonzero(x["train"])
                leaf = leaf.astype(leaf_type(leaves.side))
                own = [leaf[ends[k] - x["lengths"][k] : ends[k]].tobytes() for k in on]
                dealt = [zlib.crc32(x["docs"][k].tobytes() + (b"" if x["named"][k] else o)) for k, o in zip(on, own, strict=True)]
                dealt = np.array(dealt, dtype=np.int64)
                cols = [pa.array(dealt // ROUNDS % workers), pa.array(dealt % ROUNDS), pa.array(x["docs"][on]), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["worker", "round", "doc_id", "leaves"])

    return blocks.select("docs", "named", "lengths", "low", "high", "train", "words").mapInArrow(run, "worker long, round long, doc_id long, leaves binary")


def train_model(shared: DataFrame, model: Model) -> Model:
    """Each round every worker trains over its documents from the same start, and parameters are averaged by tokens. Only
    the averaged parameters reach the driver."""

    def worker(number: int, model: Model) -> Callable:
        def work(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["doc_id", "leaves"])
            own = Model.__new__(Model)
            own.__dict__ = {**model.__dict__, "p": {k: v.copy() for k, v in model.p.items()}}
            kind = np.dtype(leaf_type(model.side))
            lengths = part["leaves"].map(len).to_numpy() // kind.itemsize
            leaf = np.frombuffer(b"".join(part["leaves"]), dtype=kind).astype(np.int32)
            own.train(contexts(leaf, lengths, model.side**2), leaf, np.random.default_rng([number, int(part["worker"].iat[0])]))
            flat = own.flat()
            rows = pd.DataFrame(np.pad(flat, (0, -len(flat) % WIDE)).reshape(-1, WIDE), columns=wide)
            rows.insert(0, "place", np.arange(len(rows)))
            rows.insert(1, "n", len(leaf))
            return rows

        return work

    wide = [f"x{i}" for i in range(WIDE)]
    schema = ", ".join(["place long", "n long", *[f"{x} float" for x in wide]])
    mean = lambda x: F.round(F.sum(F.col("n") * F.col(x).cast("double")) / F.sum("n"), 5).alias(x)
    for number in range(ROUNDS):
        trained = shared.where(F.col("round") == number).groupBy("worker").applyInPandas(worker(number, model), schema)
        # Summed by place, first within each task: only the averages, rounded so that the order of sums leaves no trace, get here.
        got = trained.groupBy("place").agg(*[mean(x) for x in wide]).toPandas()
        if len(got):
            model.fill(got.sort_values("place")[wide].to_numpy().ravel())
        tidy(shared.sparkSession)
    return model


def score(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, train (boolean). Returns doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = stash(to_blocks(docs), "blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "n_train"))).select("block", "pos", F.col("col.words").alias("word"), F.col("col.n_train").alias("c"))
    totals = stash(words.groupBy("word").agg(F.sum("c").alias("c"), F.count("*").alias("blocks")), "totals")
    tidy(blocks.sparkSession)
    some = totals.where("c > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = int(some["n"]), int(some["v"])
    # The least count of a word of its own, from how many words have each count (few different ones, about the root of n).
    sizes = totals.where("c > 0").groupBy("c").agg(F.count("*").alias("words"))
    above = F.sum(F.col("c") * F.col("words")).over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1))
    least = sizes.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < COVER * n).agg(F.min("c")).first()[0]
    top = totals.where(F.col("c") >= (least or 1)).orderBy(F.desc("c"), "word").select("word").collect()
    side = side_for(len(top))
    leaves = Leaves([r["word"] for r in top], side)

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, c = leaves.of(batch.column(0)), batch.column(1).to_numpy()
            sums = np.bincount(at, weights=c, minlength=side * side), np.bincount(at, minlength=side * side)
            (live,) = np.nonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(sums[0][live].astype(np.int64)), pa.array(sums[1][live].astype(np.int64))], names=["leaf", "c", "kinds"])

    counts, kinds = np.zeros(side * side), np.zeros(side * side)
    held = totals.where("c > 0").select("word", "c").mapInArrow(leaf_of, "leaf long, c long, kinds long")
    for r in held.groupBy("leaf").agg(F.sum("c").alias("c"), F.sum("kinds").alias("kinds")).collect():
        counts[r["leaf"]], kinds[r["leaf"]] = r["c"], r["kinds"]
    model = train_model(shares(blocks, leaves, max(1, round(n / ROUNDS / WORKER_TOKENS))), Model(counts, side))
    log_base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    # A leaf of one word gives it all; other leaves keep 0.1 for unseen words.
    own = leaves.of(leaves.top)
    mass = counts + 0.1 * (kinds + 1)
    mass[own] = counts[own] + 0.1

    kept = [c for c in BLOCK.split(", ") if c.split()[0] not in ("words", "n_train")]

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks are shuffled with the leaves of their words instead of the words.
        for batch in batches:
            leaf = [leaves.of(w.values).astype(leaf_type(side)).tobytes() for w in batch.column("words")]
            counts = [w.values.to_numpy().tobytes() for w in batch.column("n_train")]
            cols = [batch.column(c.split()[0]) for c in kept] + [pa.array(leaf, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*[c.split()[0] for c in kept], "leaf", "counts"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.combine_chunks().to_batches()[0]
        x = _unpack(row, 0)
        c = np.frombuffer(row.column("counts")[0].as_py(), dtype=np.int32).astype(np.int64)
        c[right.column("pos").to_numpy()] = right.column("c").to_numpy()
        leaf = np.frombuffer(row.column("leaf")[0].as_py(), dtype=leaf_type(side)).astype(np.int32)
        share = np.log10((c + 0.1) / mass[leaf])
        at, heads = x["tokens"], np.cumsum(x["lengths"]) - x["lengths"]
        leaf = leaf[at]
        before = contexts(leaf, x["lengths"], side * side)
        p = share[at]
        one_thread()
        for i in range(0, len(at), 16384):
            part = slice(i, i + 16384)
            p[part] += model.log_probs(before[:, part], leaf[part]) / np.log(10)
        cols = {
            "doc_id": pa.array(x["docs"], mask=~x["named"]), "n_tokens": x["lengths"], "n_known": np.add.reduceat((c > 0)[at].astype(np.int64), heads),
            "train_tokens": np.full(len(heads), n), "base_score": np.add.reduceat(log_base(c)[at], heads), "score": np.add.reduceat(p, heads),
        }
        return pa.table(cols)

    back = words.join(totals.where("blocks > 1").select("word", F.col("c").alias("all")), "word").select(F.col("block").alias("of"), "pos", F.col("all").alias("c"))
    scored = blocks.mapInArrow(slim, ", ".join([*kept, "leaf binary", "counts binary"])).groupBy("block").cogroup(back.groupBy("of"))
    return scored.applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 10) == 0
    out = score(docs.withColumn("train", ~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
