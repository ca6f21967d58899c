"""Search that runs for many questions at once: paths that meet in the middle, facts by levels, contexts until they suffice.

State is a table keyed by question; a level or round is a few joins for all questions that are still open, and is written,
so that the next one reads it and a lost executor costs no more than that."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.functions import text as T
from knowmill.sources.shared import ROWS, bucketed, dealt, written

#: Longest paths (in edges) of each strategy.
DEPTH = {"forward": 4, "backward": 3, "bidirectional": 5}


def walks(edges: DataFrame, starts: DataFrame, hops: int) -> list[DataFrame]:
    """For 0 to ``hops`` edges: start, node, path (nodes, none twice), weight (the edges' sum). edges: src, dst, weight, both
    ways present; starts: start."""
    now = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0.0).alias("weight"))
    levels = [now]
    for _ in range(hops):
        step = now.join(edges.withColumnRenamed("src", "node").withColumnRenamed("weight", "w"), "node").where(~F.array_contains("path", F.col("dst")))
        now = written(step.select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("weight") + F.col("w")).alias("weight")), "walks")
        levels.append(now)
    return levels


def path_scores(n: Column, weight: Column, depth: int, weights: bool = True) -> tuple[Column, Column]:
    """Relevance and confidence of a path of n nodes: the mean of shortness and weight, more for weight, less for nodes beyond
    the strategy's depth; short paths are surer."""
    base = (F.greatest(F.lit(0), 10 - n) + F.least(weight, F.lit(10.0))) / 2
    bonus = F.least(weight / 10, F.lit(2.0)) if weights else F.lit(0.0)
    return F.when(n > depth, F.greatest(F.lit(0.0), base + bonus - 0.5 * (n - depth))).otherwise(base + bonus), F.when(n <= 3, 6.0).otherwise(5.0)


def reasoning_paths(edges: DataFrame, pairs: DataFrame, strategy: str = "bidirectional", depth: int | None = None, most: int = 50) -> DataFrame:
    """source, target, path, relevance, confidence, rank: the ``most`` best paths between each pair (source, target) that
    repeat no node. edges: src, dst, weight, walked both ways. Forward and backward chaining walk from one end; the
    bidirectional strategy walks half the depth from each end and joins the halves where they meet, so that a path of n edges
    costs walks of n / 2."""
    depth = depth or DEPTH[strategy]
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    both = written(both, "adjacency")
    pairs = written(pairs.select("source", "target").where("source <> target").distinct(), "pairs")
    ahead, behind = {"forward": (depth, 0), "backward": (0, depth), "bidirectional": ((depth + 1) // 2, depth // 2)}[strategy]
    front = walks(both, pairs.select(F.col("source").alias("start")).distinct(), ahead)
    back = walks(both, pairs.select(F.col("target").alias("start")).distinct(), behind)

    def met(n: int) -> DataFrame:
        i = {"forward": n, "backward": 0, "bidirectional": (n + 1) // 2}[strategy]
        a = front[i].toDF("source", "node", "path", "weight").join(pairs, "source")
        b = back[n - i].toDF("target", "node", "other", "more")
        whole = a.join(b, ["target", "node"]).where(~F.arrays_overlap(F.slice("path", F.lit(1), F.size("path") - 1), "other"))
        tail = F.slice(F.reverse("other"), F.lit(2), F.greatest(F.size("other") - 1, F.lit(0)))
        return whole.select("source", "target", F.concat("path", tail).alias("path"), (F.col("weight") + F.col("more")).alias("weight"))

    paths = reduce(DataFrame.union, [met(n) for n in range(1, depth + 1)])
    relevance, confidence = path_scores(F.size("path"), F.col("weight"), depth)
    order = Window.partitionBy("source", "target").orderBy(F.desc("relevance"), F.desc("confidence"), "path")
    scored = paths.select("source", "target", "path", F.round(relevance, 9).alias("relevance"), confidence.alias("confidence"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def facts_by_level(questions: DataFrame, links: DataFrame, levels: int = 3, per_level: int = 20, total: int = 10_000, decay: float = 0.2, least: float = 0.1) -> DataFrame:
    """query_id, fact_id, level, score: facts found by walking from each question's entities to facts and on to the facts'
    other entities. questions: query_id, entity; links: fact_id, entity, score (the best, where a fact has several).

    On each level a question takes the ``per_level`` best new facts of its new entities; their score is less by ``decay`` of
    itself a level and must reach ``least``. The facts' entities that the question has not visited are the next level's. A
    question stops with no entity left, after ``levels`` levels, or once it holds ``total`` facts; others go on. Of an
    entity's facts only as many can matter as a question holds from earlier levels and takes at one, so entities are cut to
    their best ones beforehand. Pairs and best ones are dealt once, into tables bucketed by what the levels join."""
    reach = min(total, (levels - 1) * per_level) + per_level
    order = Window.partitionBy("entity").orderBy(F.desc("score"), "fact_id")
    pairs = written(links.select("fact_id", "entity", "score"), "links")
    n = pairs.count()
    ends = bucketed(pairs.select("fact_id", "entity"), n, "fact_id", "ends")
    merged = dealt(pairs, n, "entity").groupBy("entity", "fact_id").agg(F.max("score").alias("score"))
    best = bucketed(merged.withColumn("k", F.row_number().over(order)).where(F.col("k") <= reach).drop("k"), n, "entity", "best")
    front = written(questions.select("query_id", "entity").distinct(), "front")
    visited, found = front, None
    for level in range(levels):
        met = best.join(front.hint("shuffle_hash"), "entity").groupBy("query_id", "fact_id").agg(F.max("score").alias("score"))
        if found is not None:
            met = met.join(found.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti")
        worth = met.withColumn("score", F.col("score") * (1 - decay * level)).where(F.col("score") >= least)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id"))
        new = worth.withColumn("k", rank).where(F.col("k") <= per_level).select("query_id", "fact_id", F.lit(level).alias("level"), "score")
        new = written(new, "new")
        found = new if found is None else written(found.union(new), "found")
        if level + 1 < levels:
            going = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") < total).select("query_id")
            met = ends.join(new.join(going, "query_id", "left_semi").hint("shuffle_hash"), "fact_id").select("query_id", "entity").distinct()
            front = written(met.join(visited, ["query_id", "entity"], "left_anti"), "front")
            visited = written(visited.union(front), "visited")
    # The last level may pass the bound.
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("level", F.desc("score"), "fact_id"))
    return found.withColumn("k", k).where(F.col("k") <= total).drop("k")


def refine(questions: DataFrame, documents: DataFrame, enough: float = 0.8, per_round: int = 5, rounds: int = 5) -> DataFrame:
    """query_id, rounds, n_documents, covered, sufficient: each question's context grows until it covers ``enough`` of the
    question's keywords. questions: query_id, text; documents: doc_id, text.

    In each round the gaps are the keywords that the context lacks; the ``per_round`` documents that hold most of them (the
    least ids among equals) join the context. Documents lie in so many partitions that what these meet there is bounded, and
    questions of up to ``ROWS`` words in all are sent to them; more are joined by words, and what they meet is dealt again. A question leaves the loop once it suffices or no document fills a gap; the
    loop ends with the last one."""
    words = lambda df, key: df.where("text is not null").select(key, F.explode(F.array_distinct(T.keywords(F.col("text")))).alias("word"))
    asked = written(words(questions, "query_id").distinct(), "asked")
    held = written(words(documents, "doc_id").join(asked.select("word").distinct(), "word", "left_semi"), "held")
    held = written(dealt(held, held.count(), "doc_id").distinct(), "held")
    common = written(held.groupBy("word").agg(F.count("*").alias("docs")), "common")
    size = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    missing = asked
    state = written(size.select("query_id", "n", F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("n_documents"), F.lit(0).alias("rounds")), "state")
    for k in range(1, rounds + 1):
        made = missing.join(common, "word").agg(F.sum("docs")).first()[0] or 0
        if missing.count() <= ROWS:
            met = dealt(held, made, "doc_id").join(F.broadcast(missing), "word")
        else:
            met = dealt(missing.join(held, "word").select("query_id", "doc_id"), made, "query_id", "doc_id")
        gaps = met.groupBy("query_id", "doc_id").agg(F.count("*").alias("fills"))
        order = Window.partitionBy("query_id").orderBy(F.desc("fills"), "doc_id")
        new = written(gaps.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_round).select("query_id", "doc_id"), "new")
        filled = written(new.join(held, "doc_id").join(missing, ["query_id", "word"]).select("query_id", "word").distinct(), "filled")
        added = new.groupBy("query_id").agg(F.count("*").alias("docs")).join(filled.groupBy("query_id").agg(F.count("*").alias("words")), "query_id")
        joined = state.join(added, "query_id", "left")
        now = [(F.col("covered") + F.coalesce("words", F.lit(0))).alias("covered"), (F.col("n_documents") + F.coalesce("docs", F.lit(0))).alias("n_documents")]
        state = written(joined.select("query_id", "n", *now, F.when(F.col("docs").isNull(), F.col("rounds")).otherwise(k).alias("rounds")), "state")
        open_ = new.select("query_id").distinct().join(state.where(F.col("covered") < enough * F.col("n")), "query_id", "left_semi")
        missing = written(missing.join(filled, ["query_id", "word"], "left_anti").join(open_, "query_id", "left_semi"), "missing")
        if not missing.limit(1).count():
            break
    share = F.col("covered") / F.col("n")
    return state.select("query_id", "rounds", "n_documents", share.alias("covered"), (share >= enough).alias("sufficient"))
