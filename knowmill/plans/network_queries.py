"""Paths, centralities, components and searches over the geographic part of the graph and the whole of it."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowmill.operators import graph, ranking
from knowmill.plans.registry import query
from knowmill.sources.tables import GRAPH_SQL, entities, node, node_name, read, relations

#: Regions, nations and suppliers with an edge between nations of neighbouring numbers: small enough for all pairs at any
#: scale factor but that suppliers grow with it.
GEO_SQL = f"""{GRAPH_SQL}, geo AS (SELECT src, dst FROM rel WHERE type = 'IN_REGION' UNION ALL SELECT 'n:' || n_nationkey, 'n:' || (n_nationkey + 7) % 25 FROM nation),
both_ways AS (SELECT DISTINCT u, v FROM (SELECT src u, dst v FROM geo UNION ALL SELECT dst, src FROM geo) WHERE u <> v)"""


def geo(spark, d):
    n = read(spark, d, "nation")
    ring = n.select(F.concat(F.lit("n:"), "n_nationkey").alias("src"), F.concat(F.lit("n:"), (F.col("n_nationkey") + 7) % 25).alias("dst"))
    return relations(spark, d).where("type = 'IN_REGION'").select("src", "dst").union(ring)


def places(spark, d):
    return entities(spark, d).where("type in ('REGION', 'NATION')").select("id")


WALK_SQL = f"""WITH RECURSIVE {GEO_SQL}, walk AS (SELECT 'n:0' AS source, 'n:0' AS node, ['n:0'] AS path, 0 AS n
  UNION ALL SELECT source, v, list_append(path, v), n + 1 FROM walk JOIN both_ways ON u = node WHERE n < 4 AND NOT list_contains(path, v))"""


@query(f"{WALK_SQL} SELECT node, n::INT AS distance, array_to_string(min(path), '>') AS path FROM walk w WHERE n > 0 AND n = (SELECT min(n) FROM walk x WHERE x.node = w.node) GROUP BY node, n")
def shortest_paths(spark, d):
    start = places(spark, d).where("id = 'n:0'")
    return graph.shortest_paths(geo(spark, d), start, 4).select("node", "distance", F.array_join("path", ">").alias("path"))


@query(f"{WALK_SQL} SELECT array_to_string(path, '>') AS path, n::INT AS length FROM walk WHERE node = 'r:1' AND n > 0 AND NOT list_contains(path[:-2], 'r:1')")
def simple_paths(spark, d):
    """All simple paths of up to four edges between two nodes."""
    pair = spark.createDataFrame([("n:0", "r:1")], "source string, target string")
    out = graph.simple_paths(geo(spark, d), pair, 4)
    return out.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("length"))


@query(f"""{WALK_SQL}, p AS (SELECT path, n, sum(1) OVER () AS total FROM walk WHERE node = 'r:1' AND n > 0 AND NOT list_contains(path[:-2], 'r:1')),
s AS (SELECT array_to_string(path, '>') AS path, round((len(list_filter(path, lambda x: x LIKE 'n:%')) * 0.8 + len(list_filter(path, lambda x: x NOT LIKE 'n:%')) * 0.3) / len(path) / (1 + 0.05 * n), 6) AS score FROM p)
SELECT path, score, row_number() OVER (ORDER BY score DESC, path)::INT AS rank FROM s WHERE score >= 0.3 ORDER BY rank LIMIT 10""")
def path_topk(spark, d):
    """The ten best paths by the mean worth of their nodes, less for longer paths."""
    pair = spark.createDataFrame([("n:0", "r:1")], "source string, target string")
    p = graph.simple_paths(geo(spark, d), pair, 4)
    worth = F.aggregate("path", F.lit(0.0), lambda a, x: a + F.when(x.startswith("n:"), 0.8).otherwise(0.3))
    s = p.select(F.array_join("path", ">").alias("path"), F.round(worth / F.size("path") / (1 + 0.05 * (F.size("path") - 1)), 6).alias("score"))
    best = s.where("score >= 0.3").orderBy(F.desc("score"), "path").limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


ALL_SQL = f"""WITH RECURSIVE {GEO_SQL}, nodes AS (SELECT id FROM ent WHERE type IN ('REGION', 'NATION')),
reach AS (SELECT id AS s, id AS t, 0 AS n FROM nodes UNION SELECT s, v, n + 1 FROM reach JOIN both_ways ON u = t WHERE n < 12),
dist AS (SELECT s, t, min(n) AS n FROM reach GROUP BY s, t),
sigma AS (SELECT id AS s, id AS t, 0 AS n, 1::DOUBLE AS k FROM nodes UNION ALL
  SELECT x.s, x.v, x.n, sum(x.k) FROM (SELECT g.s, b.v, g.n + 1 AS n, g.k FROM sigma g JOIN both_ways b ON b.u = g.t JOIN dist d ON d.s = g.s AND d.t = b.v AND d.n = g.n + 1) x GROUP BY x.s, x.v, x.n)"""


@query(f"{ALL_SQL} SELECT nodes.id, count(t) AS reachable, round(coalesce(1 / avg(n), 0), 6) AS closeness FROM nodes LEFT JOIN dist ON s = id AND n > 0 GROUP BY nodes.id")
def closeness_centrality(spark, d):
    return graph.closeness(geo(spark, d), places(spark, d)).withColumn("closeness", F.round("closeness", 6))


@query(f"""{ALL_SQL}, x AS (SELECT sv.t AS id, sum(sv.k * vt.k / st.k) AS share FROM sigma st JOIN sigma sv ON sv.s = st.s JOIN sigma vt ON vt.s = sv.t AND vt.t = st.t
WHERE st.s < st.t AND sv.t <> st.s AND sv.t <> st.t AND sv.n + vt.n = st.n GROUP BY sv.t), p AS (SELECT (count(*) - 1) * (count(*) - 2) / 2 AS pairs FROM nodes)
SELECT nodes.id, round(coalesce(share, 0) / pairs, 6) AS betweenness FROM nodes CROSS JOIN p LEFT JOIN x ON x.id = nodes.id""")
def betweenness_centrality(spark, d):
    return graph.betweenness(geo(spark, d), places(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


#: Customers and the parts they bought twice or more: many small components.
TWICE_SQL = f"""{GRAPH_SQL}, twice AS (SELECT src, dst FROM rel WHERE type = 'BOUGHT' AND n >= 2)"""


def _twice(spark, d):
    return relations(spark, d).where("type = 'BOUGHT' and n >= 2").select("src", "dst")


@query(f"""WITH RECURSIVE {TWICE_SQL}, b AS (SELECT src u, dst v FROM twice UNION SELECT dst, src FROM twice), r AS (SELECT DISTINCT u AS node, u AS low FROM b UNION SELECT b.v, r.low FROM r JOIN b ON b.u = r.node)
SELECT component, count(*) AS n FROM (SELECT node, min(low) AS component FROM r GROUP BY node) GROUP BY component""")
def connected_components(spark, d):
    return graph.components(_twice(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {TWICE_SQL}, b AS (SELECT src u, dst v FROM twice UNION SELECT dst, src FROM twice), r AS (SELECT DISTINCT u AS node, u AS low FROM b UNION SELECT b.v, r.low FROM r JOIN b ON b.u = r.node),
c AS (SELECT node, min(low) AS component FROM r GROUP BY node), k AS (SELECT component, count(*) AS n, sum((node LIKE 'c:%')::INT)::BIGINT AS customers FROM c GROUP BY component),
m AS (SELECT component, count(*) AS edges FROM twice JOIN c ON c.node = src GROUP BY component)
SELECT component, n, edges, round(2 * edges / (n * (n - 1)), 6) AS density, CASE WHEN 2 * customers >= n THEN 'CUSTOMER' ELSE 'PART' END AS dominant FROM k JOIN m USING (component) WHERE n >= 3""")
def entity_clusters(spark, d):
    """Components of three nodes or more with their inner edges, density and dominant type."""
    e = _twice(spark, d)
    c = graph.components(e)
    k = c.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("node").startswith("c:").cast("long")).alias("customers")).where("n >= 3")
    m = e.join(c, F.col("src") == F.col("node")).groupBy("component").agg(F.count("*").alias("edges"))
    kind = F.when(2 * F.col("customers") >= F.col("n"), "CUSTOMER").otherwise("PART")
    return k.join(m, "component").select("component", "n", "edges", F.round(2 * F.col("edges") / (F.col("n") * (F.col("n") - 1)), 6).alias("density"), kind.alias("dominant"))


@query(f"""WITH {GRAPH_SQL}, b AS (SELECT DISTINCT u, v FROM (SELECT src u, dst v FROM rel WHERE type <> 'BOUGHT' UNION ALL SELECT dst, src FROM rel WHERE type <> 'BOUGHT' UNION ALL
  SELECT 'n:' || n_nationkey, 'n:' || (n_nationkey + 7) % 25 FROM nation UNION ALL SELECT 'n:' || (n_nationkey + 7) % 25, 'n:' || n_nationkey FROM nation) WHERE u <> v),
k AS (SELECT u AS id, count(*) AS k FROM b GROUP BY u HAVING count(*) >= 2), t AS (SELECT x.u AS id, count(*) // 2 AS links FROM b x JOIN b y ON x.u = y.u AND x.v <> y.v JOIN b z ON z.u = x.v AND z.v = y.v GROUP BY x.u)
SELECT k.id, k AS neighbours, coalesce(links, 0) AS links, round(2 * coalesce(links, 0) / (k * (k - 1)), 6) AS coefficient FROM k LEFT JOIN t USING (id)""")
def local_clustering(spark, d):
    n = read(spark, d, "nation")
    ring = n.select(node("n", F.col("n_nationkey")).alias("src"), node("n", (F.col("n_nationkey") + 7) % 25).alias("dst"))
    e = relations(spark, d, numbers=True).where("type <> 'BOUGHT'").select("src", "dst").union(ring)
    return graph.clustering(e).select(node_name(F.col("id")).alias("id"), "neighbours", "links", F.round("coefficient", 6).alias("coefficient"))


@query(f"""WITH {GRAPH_SQL}, x AS (SELECT (SELECT count(*) FROM ent) AS n, (SELECT count(*) FROM rel) AS m, (SELECT count(*) FROM ent WHERE id NOT IN (SELECT src FROM rel UNION SELECT dst FROM rel)) AS alone)
SELECT n, m, alone, round(m / (n * (n - 1)), 9) AS directed_density, round(2 * m / n, 6) AS mean_connections FROM x""")
def graph_metrics(spark, d):
    """Directed density, isolated nodes and mean connections of all nodes."""
    e, r = entities(spark, d), relations(spark, d)
    alone = graph.isolated(e, r).agg(F.count("*").alias("alone"))
    x = e.agg(F.count("*").alias("n")).crossJoin(r.agg(F.count("*").alias("m"))).crossJoin(alone)
    n, m = F.col("n"), F.col("m")
    return x.select("n", "m", "alone", F.round(m / (n * (n - 1)), 9).alias("directed_density"), F.round(2 * m / n, 6).alias("mean_connections"))


@query(f"""WITH {GRAPH_SQL}, e AS (SELECT src AS id FROM rel UNION ALL SELECT dst FROM rel), k AS (SELECT id, count(*) AS degree FROM e GROUP BY id)
SELECT name, type, degree, rank::INT AS rank FROM (SELECT name, type, degree, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM k JOIN ent USING (id)) WHERE rank <= 10""")
def most_connected(spark, d):
    deg = graph.degrees(entities(spark, d), relations(spark, d)).orderBy(F.desc("degree"), "id").limit(10)
    top = deg.join(entities(spark, d), "id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))
    return top.select("name", "type", "degree", "rank")


@query(f"""WITH {GRAPH_SQL} SELECT 'entity' AS kind, type, count(*) AS n FROM ent GROUP BY type UNION ALL SELECT 'relation', type, count(*) FROM rel GROUP BY type""")
def graph_summary(spark, d):
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(entities(spark, d), "entity").union(count(relations(spark, d), "relation"))


@query(f"""WITH {GRAPH_SQL}, k AS (SELECT type, src, dst, n, row_number() OVER (PARTITION BY type ORDER BY src, dst) AS rn FROM rel)
SELECT type, count(*) AS n, round(avg(n), 6) AS mean_weight, string_agg(CASE WHEN rn <= 5 THEN src || '>' || dst END, ' ' ORDER BY rn) AS samples FROM k GROUP BY type""")
def relation_type_summary(spark, d):
    """Counts, mean weights and five samples of each type; samples are cut by rank before they are collected."""
    r = relations(spark, d)
    first = ranking.top(r.withColumn("key", F.lit(0)).withColumn("edge", F.struct("src", "dst")), "type", "key", "edge", 5)
    samples = first.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("edge")), lambda e: F.concat(e["src"], F.lit(">"), e["dst"])), " ").alias("samples"))
    return r.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean_weight")).join(samples, "type")


@query(f"""WITH {GRAPH_SQL}, seeds AS (SELECT id FROM ent WHERE type = 'NATION' AND id LIKE '%3'), b AS (SELECT src u, dst v, type FROM rel UNION ALL SELECT dst, src, type FROM rel)
SELECT v AS id, count(DISTINCT u) AS n_seeds FROM b JOIN seeds ON u = id WHERE type = 'LOCATED_IN' AND v NOT IN (SELECT id FROM seeds) GROUP BY v""")
def related_entities(spark, d):
    """Neighbours of a set of entities by one type of edge that are not in the set."""
    seeds = entities(spark, d).where("type = 'NATION' and id like '%3'").select("id")
    r = relations(spark, d).where("type = 'LOCATED_IN'")
    b = r.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(r.select("dst", "src"))
    out = b.join(seeds, b.u == seeds.id, "left_semi").join(seeds, b.v == seeds.id, "left_anti")
    return out.groupBy(F.col("v").alias("id")).agg(F.count_distinct("u").alias("n_seeds"))


@query("""WITH t AS (SELECT l_orderkey AS f, l_suppkey AS s FROM lineitem GROUP BY ALL), n AS (SELECT s, count(*) AS total FROM t GROUP BY s),
p AS (SELECT a.s AS a, b.s AS b, count(*) AS shared, count(*) / any_value(total) AS share FROM t a JOIN t b ON a.f = b.f AND a.s <> b.s JOIN n ON n.s = a.s WHERE a.s < 5 GROUP BY a.s, b.s)
SELECT b AS id, round(max(share), 6) AS share, sum(shared)::BIGINT AS shared FROM p WHERE share >= 0.01 AND b >= 5 GROUP BY b ORDER BY shared DESC, id LIMIT 100""")
def co_occurring_neighbours(spark, d):
    """Items that often stand in the facts of given items, with their largest share and number of shared facts."""
    links = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_suppkey").alias("item")).distinct()
    p = graph.co_occurrence(links, 0.01, given=links.where("item < 5").select("item")).where("b >= 5")
    out = p.groupBy(F.col("b").alias("id")).agg(F.round(F.max("share"), 6).alias("share"), F.sum("shared").alias("shared"))
    return out.orderBy(F.desc("shared"), "id").limit(100)


@query(f"""WITH RECURSIVE {GEO_SQL}, w AS (SELECT src, dst, 0.5 + (length(src) + length(dst)) % 3 / 6 AS weight FROM geo), b AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM w UNION ALL SELECT dst, src, weight FROM w) WHERE src <> dst GROUP BY ALL),
l1 AS (SELECT dst AS node, weight * 0.9 AS score FROM b WHERE src = 'n:0' AND weight * 0.9 >= 0.2 ORDER BY score DESC, node LIMIT 3),
l2 AS (SELECT b.dst AS node, max(l1.score * b.weight * 0.9) AS score FROM l1 JOIN b ON b.src = l1.node WHERE b.dst <> 'n:0' AND b.dst NOT IN (SELECT node FROM l1) GROUP BY b.dst HAVING max(l1.score * b.weight * 0.9) >= 0.2 ORDER BY score DESC, node LIMIT 3)
SELECT node, 1 AS depth, round(score, 6) AS score FROM l1 UNION ALL SELECT node, 2, round(score, 6) FROM l2""")
def beam_traversal(spark, d):
    """The three best neighbours on each of two levels, by decayed products of weights."""
    e = geo(spark, d).withColumn("weight", 0.5 + (F.length("src") + F.length("dst")) % 3 / 6)
    start = places(spark, d).where("id = 'n:0'")
    return graph.beam(e, start, 2, width=3).select("node", "depth", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {GEO_SQL}, x AS (SELECT 'n:3' AS id, 0 AS depth UNION SELECT v, depth + 1 FROM x JOIN both_ways ON u = id WHERE depth < 2), n AS (SELECT id, min(depth) AS depth FROM x GROUP BY id)
SELECT count(*) - 1 AS entities, round(avg(depth) FILTER (depth > 0), 6) AS mean_length, count(DISTINCT substr(id, 1, 1)) AS types,
round(least(1.0, ((count(*) - 1) / 20 + 1 / (1 + avg(depth) FILTER (depth > 0)) + count(DISTINCT substr(id, 1, 1)) / 5 + 0.2 * 0.6) / 3), 6) AS score FROM n""")
def context_expansion(spark, d):
    """How much context two hops around an entity give: entities, mean path length, types, and a score of all three."""
    start = places(spark, d).where("id = 'n:3'")
    n = graph.neighbours(geo(spark, d), start, 2).select("node", "distance").union(start.select("id", F.lit(0)))
    mean, kinds, size = F.avg(F.when(F.col("distance") > 0, F.col("distance"))), F.count_distinct(F.substring("node", 1, 1)), F.count("*") - 1
    score = F.least(F.lit(1.0), (size / 20 + 1 / (1 + mean) + kinds / 5 + 0.2 * 0.6) / 3)
    return n.agg(size.alias("entities"), F.round(mean, 6).alias("mean_length"), kinds.alias("types"), F.round(score, 6).alias("score"))


@query(f"""{WALK_SQL}, p AS (SELECT path, n FROM walk WHERE node = 'r:1' AND n > 0 AND NOT list_contains(path[:-2], 'r:1')), h AS (SELECT array_to_string(path, '>') AS chain, n, path, unnest(range(1, n + 1)) AS hop FROM p)
SELECT chain, hop::INT AS hop, path[hop] || ' RELATED_TO ' || path[hop + 1] AS fact, round(least(1.0, 0.8 * pow(0.9, n - 1)), 6) AS confidence FROM h""")
def path_facts(spark, d):
    """A statement for each step of a path, with the confidence of the whole chain."""
    pair = spark.createDataFrame([("n:0", "r:1")], "source string, target string")
    p = graph.simple_paths(geo(spark, d), pair, 4).withColumn("n", F.size("path") - 1)
    h = p.select("path", "n", F.array_join("path", ">").alias("chain"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("hop"))
    fact = F.concat(F.get("path", F.col("hop") - 1), F.lit(" RELATED_TO "), F.get("path", F.col("hop")))
    return h.select("chain", "hop", fact.alias("fact"), F.round(F.least(F.lit(1.0), 0.8 * F.pow(F.lit(0.9), F.col("n") - 1)), 6).alias("confidence"))


@query(f"""WITH {GRAPH_SQL}, m AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{{5,}}'))) AS name FROM documents), e AS (SELECT name, count(*) AS n_docs FROM m GROUP BY name)
SELECT name, n_docs, CASE WHEN n_docs >= 3 THEN 'shared' ELSE 'rare' END AS kind FROM e WHERE n_docs >= 2""")
def mentions(spark, d):
    """Names that several documents mention, through the distinct edges between documents and names."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), F.lit(1)), F.lower))
    m = read(spark, d, "documents").select("doc_id", F.explode(names).alias("name"))
    return m.groupBy("name").agg(F.count("*").alias("n_docs")).where("n_docs >= 2").select("name", "n_docs", F.when(F.col("n_docs") >= 3, "shared").otherwise("rare").alias("kind"))


@query("""WITH items AS (SELECT item_id, list_distinct([x FOR x IN string_split_regex(lower(text), '[^a-z]+') IF length(x) >= 7]) AS w FROM benchmark), n AS (SELECT item_id, unnest(w) AS name FROM items),
t AS (SELECT conv_id, turn, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS name FROM conversations) SELECT item_id, name, count(*) AS n_chunks, min(conv_id) AS first_conv FROM n JOIN t USING (name) GROUP BY ALL""")
def chunks_by_entity(spark, d):
    """Chunks that mention a query's long words, joined on tokens."""
    split = lambda c: F.array_distinct(F.split(F.lower(c), "[^a-z]+"))
    n = read(spark, d, "benchmark").select("item_id", F.explode(F.filter(split("text"), lambda x: F.length(x) >= 7)).alias("name"))
    t = read(spark, d, "conversations").select("conv_id", F.explode(split("text")).alias("name"))
    return t.join(n, "name").groupBy("item_id", "name").agg(F.count("*").alias("n_chunks"), F.min("conv_id").alias("first_conv"))


@query("""WITH t AS (SELECT o_custkey AS src, l_partkey % 40 AS dst, l_returnflag AS kind, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT src, dst, 'A' AS kind, n FROM t WHERE kind = 'A' UNION ALL SELECT src, dst, 'A', n FROM t WHERE kind = 'R' AND NOT EXISTS (SELECT 1 FROM t p WHERE p.kind = 'A' AND p.src = t.src AND p.dst = t.dst)""")
def merge_relation_types(spark, d):
    """Edges of a type are named like the primary type where no primary edge joins the same two."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    t = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_custkey").alias("src"), (F.col("l_partkey") % 40).alias("dst"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    first = t.where("kind = 'A'")
    rest = t.where("kind = 'R'").join(first.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("kind", F.lit("A"))
    return first.unionByName(rest)


@query("""WITH RECURSIVE e AS (SELECT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b, max(0.5 + l_discount * 4) AS c FROM lineitem GROUP BY ALL), u AS (SELECT a AS x, b AS y, c FROM e UNION ALL SELECT b, a, c FROM e),
w AS (SELECT p_partkey * 2 + 1 AS start, p_partkey * 2 + 1 AS node, 1.0::DOUBLE AS c, 0 AS n FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT start, y, max(least(w.c, u.c)), any_value(n) + 1 FROM w JOIN u ON x = node WHERE n < 2 GROUP BY start, y)
SELECT start, node, min(n)::INT AS depth, round(max(c), 6) AS confidence FROM w WHERE node <> start GROUP BY start, node""")
def related_facts(spark, d):
    """What is within two steps of sampled parts through orders, with the least confidence along the best path."""
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), (0.5 + F.col("l_discount") * 4).alias("confidence"))
    starts = read(spark, d, "part").where("p_partkey % 100 = 0").select((F.col("p_partkey") * 2 + 1).alias("id"))
    out = graph.surest(li, starts, 2)
    return out.select("start", "node", "depth", F.round("confidence", 6).alias("confidence"))


#: The graph of places and supplies, whole: nodes are numbered.
SUPPLY_SQL = """lines AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), edge AS (SELECT c_custkey * 8 + 2 AS src, c_nationkey * 8 + 1 AS dst FROM customer UNION ALL SELECT s_suppkey * 8 + 3, s_nationkey * 8 + 1 FROM supplier
UNION ALL SELECT n_nationkey * 8 + 1, n_regionkey * 8 FROM nation UNION ALL SELECT s * 8 + 3, p * 8 + 4 FROM lines),
both_ways AS (SELECT src AS u, dst AS v FROM edge UNION SELECT dst, src FROM edge), nodes AS (SELECT r_regionkey * 8 AS id FROM region UNION ALL SELECT n_nationkey * 8 + 1 FROM nation UNION ALL SELECT c_custkey * 8 + 2 FROM customer
UNION ALL SELECT s_suppkey * 8 + 3 FROM supplier UNION ALL SELECT p_partkey * 8 + 4 FROM part)"""


def _supply(spark, d):
    return relations(spark, d, numbers=True).where("type <> 'BOUGHT'").select("src", "dst")


def _numbered(spark, d):
    keys = (("region", "r"), ("nation", "n"), ("customer", "c"), ("supplier", "s"), ("part", "p"))
    return reduce(DataFrame.union, [read(spark, d, t).select(node(k, F.col(f"{k}_{'partkey' if k == 'p' else 'suppkey' if k == 's' else 'custkey' if k == 'c' else t + 'key'}")).alias("id")) for t, k in keys])


def _levels_sql(depth: int) -> str:
    """Levels of sampled suppliers with their path counts, and the dependencies handed back over them."""
    steps = ["g0 AS (SELECT s_suppkey * 8 + 3 AS s, s_suppkey * 8 + 3 AS t, 1::DOUBLE AS k FROM supplier WHERE s_suppkey % 25 = 0)"]
    for i in range(1, depth + 1):
        old = " UNION ALL ".join(f"SELECT s, t FROM g{j}" for j in range(i))
        steps.append(f"g{i} AS (SELECT s, v AS t, sum(k) AS k FROM g{i - 1} JOIN both_ways ON u = t WHERE (s, v) NOT IN (SELECT (s, t) FROM ({old})) GROUP BY s, v)")
    steps.append(f"d{depth} AS (SELECT s, t, k, 0::DOUBLE AS owed FROM g{depth})")
    for i in range(depth - 1, 0, -1):
        steps.append(f"d{i} AS (SELECT g.s, g.t, g.k, g.k * coalesce(sum((1 + owed) / d.k), 0) AS owed FROM g{i} g LEFT JOIN (both_ways JOIN d{i + 1} d ON d.t = v) ON g.t = u AND d.s = g.s GROUP BY g.s, g.t, g.k)")
    return ", ".join(steps)


@query(f"""WITH {SUPPLY_SQL}, {_levels_sql(6)}, o AS ({" UNION ALL ".join(f"SELECT t, owed FROM d{i}" for i in range(1, 7))}), n AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM g0) AS asked)
SELECT id, round(coalesce(sum(owed), 0) * any_value(n) / any_value(asked) / ((any_value(n) - 1) * (any_value(n) - 2)), 9) AS betweenness FROM nodes CROSS JOIN n LEFT JOIN o ON o.t = id GROUP BY id""")
def betweenness_of_supplies(spark, d):
    """Betweenness in the whole graph of places and supplies, from a sample of suppliers."""
    starts = read(spark, d, "supplier").where("s_suppkey % 25 = 0").select(node("s", F.col("s_suppkey")).alias("id"))
    return graph.betweenness(_supply(spark, d), _numbered(spark, d), starts).select("id", F.round("betweenness", 9).alias("betweenness"))


@query(f"""WITH RECURSIVE {SUPPLY_SQL}, walk AS (SELECT c_custkey * 8 + 2 AS start, c_custkey * 8 + 2 AS node, [c_custkey * 8 + 2] AS path, 0 AS n FROM customer WHERE c_custkey % 100 = 0 UNION ALL
  SELECT start, v, min(list_append(path, v)), any_value(n) + 1 FROM walk JOIN both_ways ON u = node WHERE n < 4 GROUP BY start, v),
best AS (SELECT start, node, min(n) AS n FROM walk GROUP BY start, node) SELECT start, node, n::INT AS distance, array_to_string(path, '>') AS path FROM walk JOIN best USING (start, node, n) WHERE n > 0""")
def paths_of_supplies(spark, d):
    """Shortest paths of up to four steps from sampled customers through places and supplies."""
    starts = read(spark, d, "customer").where("c_custkey % 100 = 0").select(node("c", F.col("c_custkey")).alias("id"))
    out = graph.shortest_paths(_supply(spark, d), starts, 4)
    return out.select("start", "node", "distance", F.array_join("path", ">").alias("path"))
