"""Graph operators over (src, dst, type) edges; every traversal is undirected unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowmill.operators.between import FAR, backward, handed, onward, reached
from knowmill.sources.shared import ROWS, bucketed, dealt, tidy, written


def both_ways(edges: DataFrame) -> DataFrame:
    """u, v of both directions, from one pass over the edges; an edge may come twice."""
    ways = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    return edges.where("src <> dst").select(F.explode(ways).alias("x")).select("x.u", "x.v")


def undirected(edges: DataFrame) -> DataFrame:
    """u, v of both directions, each once."""
    return both_ways(edges).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_in, n_out, degree of all nodes, those without edges included."""
    end = lambda c, i, o: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.explode(F.array(end("src", 0, 1), end("dst", 1, 0))).alias("x")).select("x.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    out = nodes.select("id").join(sums, "id", "left").na.fill(0, ["n_in", "n_out"])
    return out.withColumn("degree", F.col("n_in") + F.col("n_out"))


#: Neighbours in one list of an adjacency, and nodes that a start's group may meet in a hop, on average.
LIST, MET = 10_000, 1_000_000


def lists(both: DataFrame, most: int = LIST) -> DataFrame:
    """u, vs: the adjacency (u, v) as lists of about ``most`` neighbours at most; hubs have several."""
    size = both.groupBy("u").agg(F.ceil(F.count("*") / most).alias("k")).where("k > 1")
    dealt = both.join(size, "u", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("k")), F.lit(0)))
    return dealt.groupBy("u", "part").agg(F.collect_list("v").alias("vs")).select("u", "vs")


def neighbours(edges: DataFrame, starts: DataFrame, hops: int, met: int = MET) -> DataFrame:
    """start, node, distance: nodes first reached after up to ``hops`` steps, the starts themselves left out.

    A hop joins the last nodes with lists of their neighbours, so that whole lists are dealt to a start instead of a row for
    each way to a node, and each start drops there what it met before. The nodes of a start that meets over ``met`` of them
    in a hop are dealt over several groups by their hash; a group decides alone on its nodes."""
    both = written(undirected(edges), "adjacency")
    near = written(lists(both), "lists")
    seen = written(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct(), "seen")
    for hop in range(1, hops + 1):
        step = seen.where(F.col("distance") == hop - 1).join(near.hint("merge"), F.col("node") == F.col("u")).select("start", "vs")
        wide = step.groupBy("start").agg(F.ceil(F.sum(F.size("vs")) / met).cast("int").alias("k")).where("k > 1")
        known = seen.groupBy("start").agg(F.count("*").alias("n")).join(wide, "start", "left").select("start", F.greatest(F.coalesce("k", F.lit(1)), F.ceil(F.col("n") / met).cast("int")).alias("k"))
        known = written(known.where("k > 1"), "wide")
        group = lambda v: F.pmod(F.xxhash64(v), F.coalesce("k", F.lit(1)))
        cut = F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).alias("g"), F.col("vs").alias("vs")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda g: F.struct(g.alias("g"), F.filter("vs", lambda v: group(v) == g).alias("vs"))))
        new = step.join(known, "start", "left").select("start", F.explode(cut).alias("x")).select("start", F.col("x.g").cast("int").alias("g"), "x.vs", F.lit(None).cast(near.schema["vs"].dataType).alias("old"))
        old = seen.join(known, "start", "left").select("start", group(F.col("node")).cast("int").alias("g"), "node")
        old = old.groupBy("start", "g").agg(F.collect_list("node").alias("old")).select("start", "g", F.lit(None).cast(new.schema["vs"].dataType).alias("vs"), "old")
        both_ = new.union(old).groupBy("start", "g").agg(F.flatten(F.collect_list("vs")).alias("vs"), F.flatten(F.collect_list("old")).alias("old"))
        found = both_.select("start", F.explode(F.array_except("vs", "old")).alias("node")).withColumn("distance", F.lit(hop))
        seen = seen.union(written(found, "seen") if hop < hops else found)
    return seen.where("distance > 0")


def shortest_paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, node, distance, path: the shortest path to each node within ``hops`` steps, the least in order among equals.

    Starts with one neighbour share that neighbour's search, which is a step shorter: all their paths lead through it, and
    nothing else is done for each of them than to put them in front of its paths."""
    ways = both_ways(edges)
    n = ways.count()
    tidy(edges.sparkSession)
    both = bucketed(ways, n, "u", "adjacency", "v")
    tidy(edges.sparkSession)
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, n // (JOINED * ROWS))
    asked = starts.select(F.col("id").alias("u")).distinct()
    doors = both.join(asked, "u", "left_semi").groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("door")).where("n = 1").select(F.col("u").alias("start"), "door")
    doors = written(doors, "doors")
    rest = asked.select(F.col("u").alias("start")).join(doors, "start", "left_anti")
    out = _paths(both, rest, hops, tasks).where("distance > 0")
    if hops < 1:
        return out
    shared = _paths(both, doors.select(F.col("door").alias("start")).distinct(), hops - 1, tasks)
    # Starts outnumber doors: what grows with their product is joined to few doors and passed on, not dealt again.
    near = F.broadcast(doors) if doors.count() <= ROWS else doors
    far = shared.withColumnRenamed("start", "door").join(near, "door").where(F.col("node") != F.col("start"))
    return out.union(far.select("start", "node", F.col("distance") + 1, F.concat(F.array("start"), "path")))


#: Buckets of the adjacency that a task takes one by one in a step, since ways to one node from several are dealt once.
JOINED = 4


def _paths(both: DataFrame, starts: DataFrame, hops: int, tasks: int) -> DataFrame:
    """start, node, distance, path from each start (start) over the adjacency, the starts themselves at no distance.

    Paths of a level are numbered in their order, so that a step deals and compares numbers, and only the least way to a node
    gets its path. A step back can only reach the last two levels, so new nodes are held against these alone."""
    numbered = lambda df: df.orderBy("path").withColumn("place", F.monotonically_increasing_id())
    front = written(numbered(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"), F.array("start").alias("path"))), "starts")
    found = [front]
    for hop in range(1, hops + 1):
        step = front.select("start", F.col("node").alias("u"), "place").join(both, "u").select("start", F.col("v").alias("node"), "place").coalesce(tasks)
        step = step.groupBy("start", "node").agg(F.min("place").alias("place"))
        known = reduce(DataFrame.union, [x.select("start", "node") for x in found[-2:]])
        step = written(step.join(known, ["start", "node"], "left_anti"), "step")
        tidy(both.sparkSession)
        new = step.join(front.select("place", "path"), "place").select("start", "node", F.lit(hop).alias("distance"), F.concat("path", F.array("node")).alias("path"))
        front = written(numbered(new), "frontier")
        tidy(both.sparkSession)
        found.append(front)
    return reduce(DataFrame.union, found).drop("place")


def simple_paths(edges: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """pairs: source, target. All paths of up to ``longest`` edges between them that repeat no node (paths can be many:
    the bound is part of the question)."""
    both = written(undirected(edges), "adjacency")
    front = pairs.select("source", "target", F.array("source").alias("path"))
    done = None
    for _ in range(longest):
        step = front.join(both, F.element_at("path", -1) == F.col("u")).where(~F.array_contains("path", F.col("v")))
        step = written(step.select("source", "target", F.concat("path", F.array("v")).alias("path")), "paths")
        ended = step.where(F.element_at("path", -1) == F.col("target"))
        done = ended if done is None else done.union(ended)
        front = step.where(F.element_at("path", -1) != F.col("target"))
    return done


def levels(both: DataFrame, starts: DataFrame) -> list[DataFrame]:
    """For each distance from 0: start, node, paths (how many shortest ones lead there), until no new node is reached. both:
    the adjacency (u, v). A step back can only reach the last two levels, so new nodes are held against these alone."""
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(1.0).alias("paths"))
    found = [now]
    while True:
        step = now.join(both, F.col("node") == F.col("u")).groupBy("start", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        known = found[-1] if len(found) == 1 else found[-1].union(found[-2])
        now = written(step.join(known.select("start", "node"), ["start", "node"], "left_anti"), "level")
        if not now.limit(1).count():
            return found
        found.append(now)


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, distance, paths: how far each node is and how many shortest paths lead to it, until no new node is
    reached. One row for each reachable pair: for graphs, or samples of starts, where that is affordable."""
    found = levels(written(undirected(edges), "adjacency"), starts)
    return reduce(DataFrame.union, [x.select("start", "node", F.lit(k).alias("distance"), "paths") for k, x in enumerate(found)])


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, reachable, closeness: 1 over the mean distance to the nodes that can be reached; 0 where there are none."""
    d = distances(edges, nodes).where("distance > 0").groupBy(F.col("start").alias("id")).agg(F.count("*").alias("reachable"), F.avg("distance").alias("mean"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("reachable", F.lit(0)).alias("reachable"), F.coalesce(1 / F.col("mean"), F.lit(0.0)).alias("closeness"))


#: Starts whose values lie in one array, blocks of them that a task takes at most, edges of a tile, and rows of hubs in a group.
STARTS, LANE, TILE, HELD = 32, 4, 500_000, 50_000


def betweenness(edges: DataFrame, nodes: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """id, betweenness: the share of shortest paths between two others that a node lies on, summed over pairs and divided
    by the number of pairs of other nodes. From each start (all nodes, or a sample that stands for them) the dependencies of
    farther nodes are handed back level by level: a node passes 1 and its own dependency to the nodes before it, by their
    shares of the paths."""
    total = dependencies(written(undirected(edges), "adjacency"), starts or nodes)
    n = nodes.agg(F.count("*").alias("n")).crossJoin((starts or nodes).agg(F.count("*").alias("asked")))
    out = nodes.select("id").join(total, "id", "left").crossJoin(F.broadcast(n))
    # Each pair is met from both ends when all nodes are asked.
    share = F.coalesce("owed", F.lit(0.0)) * F.col("n") / F.col("asked") / ((F.col("n") - 1) * (F.col("n") - 2))
    return out.select("id", F.when(F.col("n") > 2, share).otherwise(0.0).alias("betweenness"))


def dependencies(both: DataFrame, starts: DataFrame) -> DataFrame:
    """id, owed: the dependencies of nodes on the paths from all starts, summed. both: the adjacency (u, v).

    Hubs are the starts, the end of more neighbours of each edge, and nodes of more than ``LIST`` neighbours, so that every
    neighbour of an inner node is a hub. Only hubs have rows: one for each block of ``STARTS`` starts, with an array of
    distances, one of paths and one of dependencies. Inner nodes, of which there are most, lie with all their edges in tiles
    of bounded size; a tile finds anew from its hubs how far they are, and adds up what they pass on to hubs. So what is dealt
    in a step is the hubs' rows for each tile, not a row for each start and edge."""
    n = both.count()
    k = dealt(both.select("v"), n, "v").groupBy("v").agg(F.count("*").alias("k"))
    ends = dealt(dealt(both, n, "v").join(dealt(k, n, "v").hint("merge"), "v"), n, "u").groupBy("u").agg(F.count("*").alias("k"), F.min(F.struct("k", "v")).alias("least"))
    high = (F.struct("k", F.col("u").alias("v")) > F.col("least")) | (F.col("k") > LIST)
    asked = written(starts.select("id").distinct(), "starts")
    hubs = written(ends.where(high).select(F.col("u").alias("id")).union(asked).distinct(), "hubs")
    u, v = F.col("u") == F.col("id"), F.col("v") == F.col("id")
    inner = dealt(both, n, "u").join(hubs, u, "left_anti").groupBy("u").agg(F.collect_list("v").alias("vs"))
    direct = lists(dealt(both, n, "u").join(hubs, u, "left_semi").join(hubs, v, "left_semi"))
    cells = inner.withColumn("hub", F.lit(False)).union(direct.withColumn("hub", F.lit(True))).withColumnRenamed("u", "node")
    tiles = max(1, -(-n // (2 * TILE)))
    cells = written(cells.withColumn("tile", F.pmod(F.xxhash64("node", F.col("vs")[0]), F.lit(tiles)).cast("int")), "tiles")
    at = written(cells.select("tile", F.explode("vs").alias("node")).distinct(), "ends")

    groups = -(-asked.count() // ROWS) or 1
    place = F.row_number().over(Window.partitionBy("group").orderBy("id")) - 1
    given = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("row", place)
    given = given.select(F.col("id").alias("node"), (F.floor(F.col("row") / STARTS) * groups + F.col("group")).cast("int").alias("block"), (F.col("row") % STARTS).alias("slot"))
    filled = lambda there, rest: F.transform(F.sequence(F.lit(0), F.lit(STARTS - 1)), lambda i: F.when(i == F.col("slot"), F.lit(there)).otherwise(F.lit(rest)))
    seen = written(given.select("node", "block", filled(0, FAR).alias("dist"), filled(1.0, 0.0).alias("paths")), "seen")
    n_blocks = (seen.agg(F.max("block")).first()[0] or 0) + 1
    # A task takes more blocks where there are tasks enough and a tile meets few hubs.
    deep = max(1, min(LANE, tiles * n_blocks // (2 * both.sparkSession.sparkContext.defaultParallelism), LANE * HELD * tiles // max(1, at.count())))
    laid = cells.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(-(-n_blocks // deep) - 1))))
    pieces = 1 + hubs.count() * (tiles + 1) // HELD
    kind = both.schema["u"].dataType.simpleString()
    row = f"node {kind}, block int, dist array<int>, paths array<double>"

    def step(run):
        sent = seen.join(at, "node").withColumn("lane", F.floor(F.col("block") / deep).cast("int"))
        return laid.groupBy("tile", "lane").cogroup(sent.groupBy("tile", "lane")).applyInArrow(run, f"node {kind}, block int, sums array<double>, owed double")

    def taken(sums, run, shape):
        keys = ["block", F.pmod(F.xxhash64("node"), F.lit(pieces)).alias("piece")]
        return written(seen.groupBy(*keys).cogroup(sums.groupBy(*keys)).applyInArrow(run, shape), "seen")

    last = level = 0
    while level <= last + 1:
        seen = taken(step(onward(level)), reached(level), row)
        level += 1
        last = level if seen.where(F.array_contains("dist", level)).limit(1).count() else last
    seen = seen.withColumn("owed", F.array_repeat(F.lit(0.0), STARTS))
    totals = []
    for level in range(last, -1, -1):
        sums = written(step(backward(level)), "handed")
        totals.append(sums.where("block is null").select("node", "owed"))
        if level:
            seen = taken(sums.where("block is not null"), handed(level), f"{row}, owed array<double>")
    totals.append(seen.select("node", F.aggregate("owed", F.lit(0.0), lambda a, x: a + x).alias("owed")))
    return reduce(DataFrame.union, totals).groupBy(F.col("node").alias("id")).agg(F.sum("owed").alias("owed"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes with an edge, by alternating large and small stars: each round links
    every node to the least node it sees, until nothing changes."""
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    mark = None
    while True:
        e = written(e, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        mark = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        fewer = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(fewer, "u").where("v <> m").select("v", "m").union(fewer).toDF("u", "v").where("u <> v").distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """id, neighbours, links, coefficient of nodes with two neighbours or more: links among a node's neighbours over all that
    could be. Edges lead on to the node of more neighbours. Each triangle is found once, from its edge between the two nodes of
    fewest: that of them with fewer edges on gives the third nodes, and the other must have an edge to these. Nodes count
    their edges where these lie, and both directions of an edge meet to compare the counts."""
    e = written(edges.where("src <> dst").select("src", "dst"), "edges")
    n = e.count()
    ways = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    both = dealt(e.select(F.explode(ways).alias("x")).select("x.u", "x.v"), 2 * n, "u").distinct()
    both = written(both.withColumn("k", F.count("*").over(Window.partitionBy("u"))), "adjacency")
    end = lambda own: F.max(F.when(own, F.col("k")))
    pair = dealt(both.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "u", "k"), 2 * n, "a", "b").groupBy("a", "b").agg(end(F.col("u") == F.col("a")).alias("ka"), end(F.col("u") == F.col("b")).alias("kb"))
    low = F.col("ka") <= F.col("kb")
    up = dealt(pair.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")), n, "x")
    up = written(up.withColumn("on", F.count("*").over(Window.partitionBy("x"))), "up")
    # Where there is no way on from y, x and y close no triangle.
    fan = up.groupBy(F.col("x").alias("y")).agg(F.first("on").alias("far"))
    met = dealt(up, n, "y").join(dealt(fan, n, "y").hint("merge"), "y").where("on > 1")
    pick = lambda x, y: F.when(F.col("on") < F.col("far"), F.col(x)).otherwise(F.col(y))
    asked = written(met.select(pick("x", "y").alias("one"), pick("y", "x").alias("other"), F.least("on", "far").alias("n")), "asked")
    made = max(n, asked.agg(F.sum("n")).first()[0] or 0)
    third = dealt(asked.drop("n"), n, "one").join(dealt(up.select(F.col("x").alias("one"), F.col("y").alias("z")), n, "one").hint("merge"), "one").where("z <> other")
    ends = dealt(up.select(F.col("x").alias("other"), F.col("y").alias("z")), made, "other", "z")
    triangles = dealt(third, made, "other", "z").join(ends.hint("merge"), ["other", "z"], "left_semi").select(F.explode(F.array("one", "other", "z")).alias("u"))
    links = triangles.groupBy("u").agg(F.count("*").alias("links"))
    out = both.groupBy("u").agg(F.first("k").alias("k")).where("k >= 2").join(links, "u", "left").na.fill(0, ["links"])
    return out.select(F.col("u").alias("id"), F.col("k").alias("neighbours"), "links", (2 * F.col("links") / (F.col("k") * (F.col("k") - 1))).alias("coefficient"))


def beam(edges: DataFrame, starts: DataFrame, hops: int, width: int = 20, decay: float = 0.9, least: float = 0.2) -> DataFrame:
    """edges: src, dst, weight in [0, 1]. start, node, depth, score: a breadth-first search that keeps the ``width`` best
    neighbours of a start on each level; a score is the product of weights, decayed by level, and ends below ``least``."""
    both = written(edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight")).where("src <> dst"), "weights")
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"))
    seen = front
    order = Window.partitionBy("start").orderBy(F.desc("score"), "node")
    for hop in range(1, hops + 1):
        step = front.join(both, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("score") * F.col("weight") * decay).alias("score"))
        step = step.groupBy("start", "node").agg(F.max("score").alias("score")).where(F.col("score") >= least)
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        step = step.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= width)
        front = written(step.select("start", "node", F.lit(hop).alias("depth"), "score"), "beam")
        seen = seen.union(front)
    return seen.where("depth > 0")


def surest(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, node, depth, confidence of nodes within ``hops`` steps: the least number of steps, and the most that the least
    confident edge of a way of any such length can have. edges: src, dst, confidence, walked both ways. Edges and steps lie in
    partitions of bounded rows; up to ``ROWS`` last nodes are sent to the edges instead of dealing these."""
    both = edges.select("src", "dst", "confidence").union(edges.select("dst", "src", "confidence"))
    n = both.count()
    ways = written(dealt(both, n, "src", "dst").groupBy("src", "dst").agg(F.max("confidence").alias("edge")), "ways")
    degree = written(dealt(ways.select("src"), n, "src").groupBy("src").agg(F.count("*").alias("n")), "degree")
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(1.0).alias("confidence"))
    found = []
    for hop in range(1, hops + 1):
        made = now.join(degree, F.col("node") == F.col("src")).agg(F.sum("n")).first()[0] or 0
        few = now.count() <= ROWS
        near = F.broadcast(now) if few else dealt(now, max(n, made), "node").hint("merge")
        step = (ways if few else dealt(ways, max(n, made), "src")).join(near, F.col("node") == F.col("src"))
        step = dealt(step.select("start", "dst", F.least("confidence", "edge").alias("confidence")), made, "start", "dst").groupBy("start", F.col("dst").alias("node")).agg(F.max("confidence").alias("confidence"))
        now = written(step, "ways")
        found.append(now.withColumn("depth", F.lit(hop)))
    all_ = reduce(DataFrame.unionByName, found).where("node <> start")
    return all_.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.max("confidence").alias("confidence"))


def co_occurrence(links: DataFrame, min_share: float, per_key: str = "fact", item: str = "item", given: DataFrame | None = None) -> DataFrame:
    """links: (fact, item). Pairs of items with the number of shared facts and its share of the first item's facts.
    Facts are small sets (an order's lines), so pairs are made within a fact. given: the first items asked for (column
    ``item``, few enough to broadcast); then only their facts are paired."""
    if given is not None:
        own = links.join(F.broadcast(given.select(F.col("item").alias(item)).distinct()), item, "left_semi")
        total = own.groupBy(item).agg(F.count_distinct(per_key).alias("total"))
        met = own.select(per_key, F.col(item).alias("a")).distinct().join(links.select(per_key, F.col(item).alias("b")).distinct(), per_key).where("a <> b")
        shared = met.groupBy("a", "b").agg(F.count("*").alias("shared")).join(total.toDF("a", "total"), "a")
        return shared.withColumn("share", F.col("shared") / F.col("total")).where(F.col("share") >= min_share)
    # A set is dealt once, an item is paired with itself too, so that its total lies among its own pairs: they are dealt by
    # the first item, in partitions of bounded rows, where pairs, totals and what is ranked by the first item all meet.
    sets = dealt(links.select(per_key, item), links.count(), per_key).groupBy(per_key).agg(F.collect_set(item).alias("items"))
    sets = written(sets.select("items"), "sets")
    made = sets.agg(F.sum(F.size("items").cast("long") ** 2)).first()[0] or 0
    a = sets.select("items", F.explode("items").alias("a")).select("a", F.explode("items").alias("b"))
    pairs = dealt(a, int(made), "a").groupBy("a", "b").agg(F.count("*").alias("shared"))
    total = F.max(F.when(F.col("a") == F.col("b"), F.col("shared"))).over(Window.partitionBy("a"))
    out = pairs.withColumn("total", total).where("a <> b")
    return out.withColumn("share", F.col("shared") / F.col("total")).where(F.col("share") >= min_share)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_anti")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected density of the simple graph, between 0 and 1."""
    n = nodes.agg(F.count("*").alias("n"))
    m = undirected(edges).agg((F.count("*") / 2).alias("m"))
    full = F.col("n") * (F.col("n") - 1) / 2
    return n.crossJoin(m).select("n", F.col("m").cast("long").alias("m"), F.when(F.col("n") <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.col("m") / full)).alias("density"))


def parallel_types(edges: DataFrame) -> DataFrame:
    """Pairs of nodes that more than one type of edge joins, whatever its direction."""
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type")
    out = pair.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count_distinct("type").alias("n_types"))
    return out.where("n_types > 1")
