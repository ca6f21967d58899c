"""Vector search, rank fusion and ranked selection; ties always go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.sources.shared import written

#: Queries that meet all vectors in one pass.
QUERY_BLOCK = 4096
#: Queries that are multiplied with a batch of vectors at a time, and vectors that are unpacked at a time.
SLICE = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """query, id, score, rank: the k vectors (id, embedding) of highest cosine with each query (query, q), at ``least`` (over 0)
    or above. Queries are dealt to blocks of about ``QUERY_BLOCK``; a block is sent to the tasks, which multiply a
    slice of it with a batch of their vectors at a time and hand on each query's k best of the batch. Nulls and vectors of other lengths are unlike all."""
    spark = vectors.sparkSession
    q = written(queries.where("q is not null").select("query", "q"), "queries")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    kind = q.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    found = None
    for n in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).collect()
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for size in {len(r.q) for r in rows}:
            own = [r for r in rows if len(r.q) == size]
            by_size[size] = [r["query"] for r in own], _unit([r.q for r in own])
        block = spark.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, by_len = b.column(0).to_pylist(), {size: ([], []) for size in block.value}
                for low in range(0, b.num_rows, SLICE):
                    some = b.column(1).slice(low, SLICE).to_pylist()
                    for size, (at, parts) in by_len.items():
                        fit = [i for i, v in enumerate(some) if v is not None and len(v) == size and None not in v]
                        if fit:
                            at.extend(low + i for i in fit)
                            parts.append(_unit([some[i] for i in fit]))
                for size, (names, matrix) in block.value.items():
                    at, parts = by_len[size]
                    if not at:
                        continue
                    own, columns = np.array(at), np.concatenate(parts).T
                    for low in range(0, len(names), SLICE):
                        out = {"query": [], "id": [], "score": []}
                        # Rounded, so that equal vectors tie wherever they stand in a batch.
                        scores = matrix[low : low + SLICE] @ columns
                        np.round(scores, 12, out=scores)
                        for name, row in zip(names[low : low + SLICE], scores, strict=True):
                            some = np.flatnonzero(row >= least)
                            if len(some) > k:
                                some = some[row[some] >= np.partition(row[some], -k)[-k]]
                            best = sorted(some, key=lambda j: (-row[j], ids[own[j]]))[:k]
                            out["query"] += [name] * len(best)
                            out["id"] += [ids[own[j]] for j in best]
                            out["score"] += [float(row[j]) for j in best]
                        if out["id"]:
                            yield pa.RecordBatch.from_pydict(out, schema=shape)

        shape = pa.schema([("query", _arrow(kind[0])), ("id", _arrow(kind[1])), ("score", pa.float64())])
        some = vectors.select("id", "embedding").mapInArrow(run, f"query {kind[0]}, id {kind[1]}, score double")
        found = some if found is None else found.union(some)
    return top(found, "query", "score", "id", k)


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def top(df: DataFrame, key: str, score: str, ident: str, k: int, name: str = "rank") -> DataFrame:
    """The k best rows of each key; Spark prunes to k rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(score), ident)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """lists: query_id, item, rank. Sums 1 / (k + rank) over the lists that hold an item."""
    return lists.groupBy("query_id", "item").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count("*").alias("n_lists"))


def weighted_fusion(vector: DataFrame, graph: DataFrame, w_vector: float = 0.6, w_graph: float = 0.4) -> DataFrame:
    """query_id, item, score of either list; scores are combined where both hold an item."""
    both = vector.withColumnRenamed("score", "sv").join(graph.withColumnRenamed("score", "sg"), ["query_id", "item"], "full")
    score = F.coalesce("sv", F.lit(0.0)) * w_vector + F.coalesce("sg", F.lit(0.0)) * w_graph
    source = F.when(F.col("sv").isNull(), "graph").when(F.col("sg").isNull(), "vector").otherwise("both")
    return both.select("query_id", "item", score.alias("score"), source.alias("found_by"))


def decayed(score: Column, depth: Column, rate: float = 0.2) -> Column:
    return score * F.greatest(F.lit(0.0), 1 - rate * depth)
