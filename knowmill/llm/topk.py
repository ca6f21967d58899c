"""Exact top-k by inner product, term at a time.

Vectors become integer postings: term t of a row weighs floor(scale * x[t]). Queries and rows are dealt to blocks of
bounded size; each pair of blocks is one group that scatters, term by term, the products of the queries' weights with
the term's postings into a dense integer score array (terms with weight 0 are skipped), selects each query's best rows
by partition, and returns at most k rows a query. A last step merges the blocks' selections. Work grows with queries
times rows, as an exhaustive search does; each row is copied once for ``query_block`` queries, each query once for
``row_block`` rows.

Rows without vec_id, and rows whose vector is null or holds a null or non-finite component, take no part; components missing from a shorter
vector weigh 0. Equal scores go to the smaller id. Rows that repeat an id are ranked as often as they occur, but never
against a query of that id. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def to_postings(df: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & fine).withColumn("w", F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Each term's postings: the rows that hold it (a slice where all do) and its weights there."""
    out = []
    for weights in rows.T:
        (held,) = np.nonzero(weights)
        full = len(held) == len(weights)
        out.append((slice(None), np.ascontiguousarray(weights)) if full else (held, weights[held]))
    return out


def _accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | slice, np.ndarray]], n_rows: int) -> np.ndarray:
    """Scores of all queries, term at a time: each of a query's terms scatters its weighted postings into the query's dense
    array of scores; terms that a query lacks are not touched."""
    scores = np.zeros((len(queries), n_rows), dtype=np.int64)
    for line, query in zip(scores, queries, strict=True):
        for t in np.flatnonzero(query):
            held, weights = lists[t]
            line[held] += query[t] * weights
    return scores


def _dense(cells: pd.Series) -> np.ndarray:
    out = np.zeros((len(cells), max(map(len, cells), default=0)), dtype=np.int64)
    for i, x in enumerate(cells):
        out[i, : len(x)] = x
    return out


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, query_block: int = 8192, row_block: int = 8192) -> DataFrame:
    """queries, rows: (vec_id long, w array<long>). Returns query_id, rank, vec_id, score."""
    n_q = max(1, -(-queries.count() // query_block))
    n_r = max(1, -(-rows.count() // row_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    # Each query goes to all blocks of rows and each row to all blocks of queries: a grid of bounded cells.
    q = queries.select("vec_id", "w", deal(n_q).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_r - 1).cast("long"))).alias("rb"))
    r = rows.select("vec_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("qb"), deal(n_r).alias("rb"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            ids, q_ids = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
            a, b = _dense(left["w"]), _dense(right["w"])
            width = max(a.shape[1], b.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
            lists = postings(b)
            for at in range(0, len(a), 64):
                scores = _accumulate(a[at : at + 64], lists, len(b))
                for i, line in enumerate(scores):
                    me = q_ids[at + i]
                    # Ids ascend, so the first of equal scores are the smaller ids; one more than k leaves room for the query itself.
                    if len(line) > k + 1:
                        least = np.partition(line, len(line) - k - 1)[len(line) - k - 1]
                        (pick,) = np.nonzero(line >= least)
                    else:
                        pick = np.arange(len(line))
                    pick = pick[ids[pick] != me]
                    pick = pick[np.argsort(-line[pick], kind="stable")[:k]]
                    found.append((np.full(len(pick), me), ids[pick], line[pick]))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.array([], dtype=np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    parts = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_postings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "w")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


ORACLE = {
    "op3_exact_topk": """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum([q.w[i] * r.w[i] FOR i IN range(1, len(q.w) + 1)])::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
}
