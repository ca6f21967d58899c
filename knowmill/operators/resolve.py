"""Entity resolution: candidate pairs by blocks, greedy clusters in order, confirmation and remapping.

entities: ord (long, unique, the order of input), name, type, doc."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowmill.functions import similarity as S
from knowmill.functions import text as T
from knowmill.operators import graph, names
from knowmill.sources.shared import written


def name_views(entities: DataFrame, least: float, families: tuple = S.TYPE_FAMILIES) -> DataFrame:
    """id, block, least, name: for each way in which types and documents may agree, the block that such pairs share and the
    name similarity that is left to reach. Ways that no name could make up for have no block."""
    asks = lambda kind, doc: (least - S.TYPE * kind - S.CONTEXT * (1.0 if doc else 0.3)) / S.NAME
    kind, doc = F.upper(F.trim("type")), F.col("doc")
    blank = kind.isNull() | (kind == "")
    in_family = kind.isin(*[x for some in families for x in some])
    views = []
    for tag, what, when, worth in (("type", kind, ~blank, 1.0), ("family", S.family(F.col("type"), families), ~blank & in_family, 0.8), ("any", F.lit(""), F.lit(True), 0.5)):
        for same_doc in (False, True):
            need = asks(worth, same_doc)
            if need > 1:
                continue
            block = F.concat_ws("|", F.lit(f"{tag}{same_doc}"), what, doc.cast("string") if same_doc else F.lit(""))
            views.append(F.when(when & doc.isNotNull() if same_doc else when, F.struct(block.alias("block"), F.lit(max(need, 0.01)).alias("least"))))
    all_views = entities.select(F.col("ord").alias("id"), F.lower(F.trim("name")).alias("name"), blank.alias("blank"), F.explode(F.array_compact(F.array(*views))).alias("v"))
    untyped = all_views.where("blank").select(F.col("v.block").alias("block")).distinct()
    typed = all_views.select("id", "v.block", "v.least", "name")
    # Blocks that disregard types serve entities without one.
    return typed.where(~F.col("block").startswith("any")).union(typed.where(F.col("block").startswith("any")).join(untyped, "block", "left_semi").select(typed.columns))


def candidates(entities: DataFrame, least: float = 0.7, families: tuple = S.TYPE_FAMILIES) -> DataFrame:
    """a, b, score of pairs a < b (by ord) whose weighted similarity reaches ``least``. What types and documents give decides
    how alike the names must be (of one type: 0.617, in one document 0.5); such names are joined by ``names.like``, which
    loses none, and pairs of one name and document whose types differ by their equality."""
    e = entities.select("ord", "name", "type", "doc")
    right = e.select(*[F.col(c).alias(f"{c}_b") for c in e.columns])
    same = e.join(right, (F.lower(F.trim("name")) == F.lower(F.trim("name_b"))) & (F.col("doc") == F.col("doc_b"))).where("ord < ord_b").select(F.col("ord").alias("a"), F.col("ord_b").alias("b"))
    pairs = names.like(name_views(e, least, families)).union(same).distinct()
    both = pairs.join(e.withColumnRenamed("ord", "a"), "a").join(right.withColumnRenamed("ord_b", "b"), "b")
    col = lambda c: (F.col(c), F.col(f"{c}_b"))
    return both.select("a", "b", S.entity_similarity(col("name"), col("type"), col("doc"), families).alias("score")).where(F.col("score") >= least - 1e-12)


def keyword_candidates(keywords: DataFrame, least: float = 0.0) -> DataFrame:
    """a, b, keyword_score, score (the blend) of keywords (ord, name, type, doc) that are variants of one another, hold one
    another or share a word, and whose blend reaches ``least``."""
    k = keywords.select("ord", "name", "type", "doc")
    clean = k.select(F.col("ord").alias("id"), F.lit("").alias("block"), S.keyword_name(F.col("name")).alias("name"))
    words = clean.select("id", F.explode(F.array_distinct(T.tokens(F.col("name")))).alias("key")).withColumn("kind", F.lit("word"))
    forms = F.array(*[F.struct(F.lit(f"form{i}").alias("kind"), x.alias("key")) for i, x in enumerate(S.keyword_forms(F.col("name")))])
    keys = words.select("id", "kind", "key").union(k.select(F.col("ord").alias("id"), F.explode(forms).alias("x")).select("id", "x.kind", "x.key"))
    met = keys.withColumnRenamed("id", "a").join(keys.withColumnRenamed("id", "b"), ["kind", "key"]).where("a < b").select("a", "b")
    held = names.held(clean).select(F.least("a", "b"), F.greatest("a", "b"))
    pairs = met.union(held).distinct()
    right = k.select(*[F.col(c).alias(f"{c}_b") for c in k.columns])
    both = pairs.join(k.withColumnRenamed("ord", "a"), "a").join(right.withColumnRenamed("ord_b", "b"), "b")
    col = lambda c: (F.col(c), F.col(f"{c}_b"))
    out = both.select("a", "b", S.keyword_similarity(*col("name")).alias("keyword_score"), S.keyword_blend(col("name"), col("type"), col("doc")).alias("score"))
    return out.where((F.col("keyword_score") > 0) & (F.col("score") >= least))


#: Pairs of a component that one task settles by itself.
SMALL = 50_000


def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """ord, primary of whole components; their pairs (component, a, b) come together."""
    held, now = [], None

    def walk(pairs: pd.DataFrame) -> pd.DataFrame:
        earlier: dict[int, list[int]] = {}
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            earlier.setdefault(a, [])
            earlier.setdefault(b, []).append(a)
        primary: dict[int, int] = {}
        for x in sorted(earlier):
            primary[x] = min((a for a in earlier[x] if primary[a] == a), default=x)
        return pd.DataFrame({"ord": list(primary), "primary": list(primary.values())})

    for frame in frames:
        for component, part in frame.groupby("component", sort=False):
            if held and component != now:
                yield walk(pd.concat(held))
                held = []
            now = component
            held.append(part)
    if held:
        yield walk(pd.concat(held))


def greedy(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """ord, primary: in order, an entity joins the first primary it is paired with, or becomes a primary itself. Not a
    transitive closure. A component of pairs that is small is settled by one task; components of over ``SMALL`` pairs by
    rounds, each of which settles the entities whose least unsettled earlier partner is a primary or does not exist (at
    most as many rounds as the longest chain of pairs with rising order in such a component)."""
    pairs = written(pairs.select("a", "b"), "pairs")
    of = graph.components(pairs.toDF("src", "dst")).select(F.col("node").alias("a"), "component")
    whole = written(pairs.join(of, "a"), "pairs")
    sizes = whole.groupBy("component").agg(F.count("*").alias("n"))
    small = whole.join(sizes.where(F.col("n") <= SMALL).select("component"), "component", "left_semi")
    done = small.repartition("component").sortWithinPartitions("component").select("component", "a", "b").mapInPandas(settle, "ord long, primary long")
    done = written(done, "settled")
    large = written(whole.join(sizes.where(F.col("n") > SMALL).select("component"), "component", "left_semi").select("a", "b"), "large")
    alone = entities.select("ord").join(of.select(F.col("a").alias("ord")), "ord", "left_anti").select("ord", F.col("ord").alias("primary"))
    return alone.union(done).union(_by_rounds(large))


def _by_rounds(pairs: DataFrame) -> DataFrame:
    open_ = written(pairs.select(F.explode(F.array("a", "b")).alias("ord")).distinct(), "open")
    settled = written(open_.select("ord", F.col("ord").alias("primary")).limit(0), "settled")
    while open_.limit(1).count():
        heads = settled.where("ord = primary").select(F.col("ord").alias("a"), F.lit(1).alias("head"))
        rest = open_.select(F.col("ord").alias("a"), F.lit(0).alias("head"))
        first = pairs.join(heads.union(rest), "a").groupBy("b").agg(F.min(F.struct("a", "head")).alias("first"))
        judged = open_.join(first, F.col("ord") == F.col("b"), "left")
        now = written(judged.where("first is null or first.head = 1").select("ord", F.coalesce("first.a", "ord").alias("primary")), "now")
        settled = written(settled.union(now), "settled")
        open_ = written(open_.join(now, "ord", "left_anti"), "open")
        # Pairs with a consumed entity in front decide nothing any more.
        pairs = written(pairs.join(now.where("ord <> primary").select(F.col("ord").alias("a")), "a", "left_anti"), "pairs")
    return settled


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges: id, src, dst, type, confidence with both ends replaced by their primaries (mapping: ord, primary)."""
    a, b = mapping.toDF("src", "new_src"), mapping.toDF("dst", "new_dst")
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    return out.select("id", F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "type", "confidence")
