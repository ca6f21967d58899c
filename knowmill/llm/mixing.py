"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. Block i of a source with weight w is released at slot floor(i / w) and due by
slot ceil((i + 1) / w); in each slot the released block with the earliest deadline goes out, so that after t slots a
source with rows left has given w * t blocks, to within one block. Weights are exact and any number of sources may be
mixed. The schedule, three numbers for each block, is worked out on the driver: blocks of more than ``block`` rows are
taken where there would be more than ``MAX_BLOCKS`` otherwise, so that it stays below 50 MB at any size. Rows find their
slot by rank. When a source runs out, the others keep their order, which keeps their relative shares.

All rows stay: weights order the output and never drop or repeat rows. Null sources form a source of their own. Sources
without a target share what the targets leave; where nothing is left, they follow the others. Order within a source is that of a hash of the
id; null and repeated ids are mixed like others. Empty tables give no rows; extra columns stay, but for those named as
the added ones.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, rank_in_group, stash, table

PERIOD = 1000
#: Rows of a block, and how many blocks a schedule holds before blocks grow.
BLOCK, MAX_BLOCKS = 64, 1_000_000
#: Exponent of the sources' sizes in the registered query's targets.
FLATTEN = 0.5


def whole_parts(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights in whole parts of the period, by largest remainders; each source gets at least one part."""
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    parts = {k: max(1, int(x)) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (parts[k] - exact[k], str(k)))[: max(0, period - sum(parts.values()))]:
        parts[k] += 1
    while sum(parts.values()) > period:
        parts[max(parts, key=lambda k: (parts[k], str(k)))] -= 1
    return parts


def schedule(weights: list[float | Fraction], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of all blocks, earliest deadline first among released blocks, by the exact weights. Once
    other sources run out, the time until the next release is skipped, so slots have no gaps. Sources of weight 0
    follow the others, in equal shares."""
    exact = [Fraction(w) for w in weights]
    live = [k for k, w in enumerate(exact) if w > 0 and blocks[k] > 0]
    scale = math.lcm(*[exact[k].denominator for k in live])
    parts = {k: int(exact[k] * scale) for k in live}
    total, clock, slot = sum(parts.values()), 0, 0
    waiting, ready = [(0, k, 0) for k in live], []
    while waiting or ready:
        if not ready:
            clock = max(clock, waiting[0][0])
        while waiting and waiting[0][0] <= clock:
            _, k, i = heapq.heappop(waiting)
            # Ties in deadlines go to the block whose window overlaps the next, as in PD2, then to the heavier source.
            due, odd = divmod((i + 1) * total, parts[k])
            heapq.heappush(ready, (due + (odd > 0), odd == 0, -parts[k], k, i))
        _, _, _, k, i = heapq.heappop(ready)
        yield k, i, slot
        slot, clock = slot + 1, clock + 1
        if i + 1 < blocks[k]:
            heapq.heappush(waiting, ((i + 1) * total // parts[k], k, i + 1))
    last = [k for k, w in enumerate(exact) if w <= 0 and blocks[k] > 0]
    for n, (k, i, _) in enumerate(schedule([1] * len(last), [blocks[k] for k in last]) if last else ()):
        yield last[k], i, slot + n


def pfair(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block within the period, slot) of one period of whole parts."""
    names = sorted(parts, key=str)
    sizes = [parts[x] for x in names]
    return [(names[k], i, slot) for k, i, slot in schedule(sizes, sizes)]


def lag(parts: dict[str, int]) -> Fraction:
    """The largest deviation of a period's schedule from its targets, in blocks."""
    period, seen, most = sum(parts.values()), dict.fromkeys(parts, 0), Fraction(0)
    for source, _, slot in pfair(parts):
        seen[source] += 1
        most = max(most, *(abs(seen[s] - Fraction((slot + 1) * p, period)) for s, p in parts.items()))
    return most


def mix(df: DataFrame, targets: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, most: int = MAX_BLOCKS) -> DataFrame:
    """Adds mix_block, mix_slot, mix_position (long): the row's block in its source, the block's slot, and a
    position that orders the output. Only sources with their sizes reach the driver."""
    added = ["mix_block", "mix_slot", "mix_position"]
    return beside(df, {"source": source, "key": key}, added, lambda x: _mix(x, targets, block, most))


def _mix(df: DataFrame, targets: dict[str, float] | None, block: int, most: int) -> DataFrame:
    spark = df.sparkSession
    sizes = df.groupBy("source").count().orderBy(F.desc("count"), "source").collect()
    # Joined by a number, since a source may be null.
    names = {r[0]: i for i, r in enumerate(sizes)}
    weights = {r[0]: (targets or {}).get(r[0]) for r in sizes}
    if targets is None:
        weights = {r[0]: r["count"] ** FLATTEN for r in sizes}
    rest = [k for k, w in weights.items() if w is None]
    spare = max(0.0, 1 - sum(w for w in weights.values() if w))
    weights |= {k: spare / len(rest) for k in rest}
    if not names:
        return df.withColumns({c: F.lit(None).cast("long") for c in ("mix_block", "mix_slot", "mix_position")})
    block = max(block, -(-sum(r["count"] for r in sizes) // most))
    columns = [array("q"), array("q"), array("q")]
    for row in schedule([weights[k] for k in names], [-(-r["count"] // block) for r in sizes]):
        for column, x in zip(columns, row, strict=True):
            column.append(x)
    plan = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=["_s", "_i", "_slot"]))
    ids = spark.createDataFrame([(k, i) for k, i in names.items()], f"_name {dict(df.dtypes)['source']}, _s long")
    df = df.join(F.broadcast(ids), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    df = rank_in_group(df, "_s", "key", "_rank").withColumn("mix_block", F.floor(F.col("_rank") / block))
    df = df.withColumn("_i", F.col("mix_block")).join(plan, ["_s", "_i"]).withColumn("mix_slot", F.col("_slot"))
    return df.withColumn("mix_position", F.col("mix_slot") * block + F.col("_rank") % block)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, targets: dict[str, float] | None = None) -> DataFrame:
    """All documents, written in the order of the mix: files hold ranges of positions, sorted, and packing takes the
    documents in this order. Rows that repeat an id stand together."""
    names = docs.columns
    order = stash(mix(docs.select("doc_id", "source"), targets).select("doc_id", "mix_position"), "mix")
    order = order.groupBy(F.col("doc_id").alias("_id")).agg(F.min("mix_position").alias("_at"))
    parts = max(1, docs.count() // 10_000)
    placed = docs.alias("d").join(order.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o._id")))
    return placed.repartitionByRange(parts, "o._at").sortWithinPartitions("o._at").select(*[F.col(f"d.`{c}`") for c in names])
