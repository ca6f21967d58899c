"""Queries over the property graph of the star schema."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowmill.functions import text as T
from knowmill.operators import dedup, graph
from knowmill.plans.registry import query
from knowmill.sources.tables import GRAPH_SQL, entities, node, node_name, read, relations

BOTH_SQL = "both_ways AS (SELECT DISTINCT u, v FROM (SELECT src u, dst v FROM rel UNION ALL SELECT dst, src FROM rel) WHERE u <> v)"


@query(f"""WITH {GRAPH_SQL} SELECT id, 'ent' || CASE WHEN c = '' THEN '_' || substr(h, 1, 16) ELSE '_' || c END || '_' || substr(h, 1, 8) AS entity_id FROM
(SELECT id, sha256(lower(name)) AS h, regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM ent)""")
def entity_ids(spark, d):
    return entities(spark, d).select("id", T.entity_id(F.col("name")).alias("entity_id"))


@query(f"""WITH {GRAPH_SQL} SELECT src, dst, type, 'rel_' || lower(type) || '_' || substr(sha256(least(src, dst) || ':' || greatest(src, dst) || ':' || type), 1, 9) AS relation_id FROM rel""")
def relation_ids(spark, d):
    return relations(spark, d).select("src", "dst", "type", T.relation_id(F.col("src"), F.col("dst"), F.col("type")).alias("relation_id"))


@query(f"""WITH {GRAPH_SQL}, e AS (SELECT src AS id, 0 AS i, 1 AS o FROM rel UNION ALL SELECT dst, 1, 0 FROM rel)
SELECT ent.id, coalesce(sum(i), 0)::BIGINT AS n_in, coalesce(sum(o), 0)::BIGINT AS n_out, coalesce(sum(i + o), 0)::BIGINT AS degree FROM ent LEFT JOIN e ON e.id = ent.id GROUP BY ent.id""")
def degree_centrality(spark, d):
    return graph.degrees(entities(spark, d), relations(spark, d))


@query(f"""WITH {GRAPH_SQL}, {BOTH_SQL}, h1 AS (SELECT u AS start, v AS node FROM both_ways WHERE u LIKE 's:%'), h2 AS (SELECT DISTINCT h1.start, b.v AS node FROM h1 JOIN both_ways b ON h1.node = b.u WHERE b.v <> h1.start)
SELECT start, node, min(d)::INT AS distance FROM (SELECT start, node, 1 AS d FROM h1 UNION ALL SELECT start, node, 2 FROM h2) GROUP BY start, node""")
def supplier_neighbours_2hop(spark, d):
    starts = read(spark, d, "supplier").select(node("s", F.col("s_suppkey")).alias("id"))
    out = graph.neighbours(relations(spark, d, numbers=True), starts, 2)
    return out.select(node_name(F.col("start")).alias("start"), node_name(F.col("node")).alias("node"), "distance")


@query(f"""WITH {GRAPH_SQL}, t AS (SELECT l_orderkey AS f, l_suppkey AS s FROM lineitem GROUP BY ALL), n AS (SELECT s, count(*) AS total FROM t GROUP BY s)
SELECT a.s AS a, b.s AS b, count(*) AS shared, any_value(total) AS total, round(count(*) / any_value(total), 6) AS share FROM t a JOIN t b ON a.f = b.f AND a.s <> b.s JOIN n ON n.s = a.s GROUP BY a.s, b.s HAVING count(*) / any_value(total) >= 0.03""")
def co_occurrence_share(spark, d):
    links = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_suppkey").alias("item"))
    return graph.co_occurrence(links, 0.03).withColumn("share", F.round("share", 6))


@query(f"WITH {GRAPH_SQL} SELECT id, name, type FROM ent WHERE id NOT IN (SELECT src FROM rel UNION SELECT dst FROM rel)")
def isolated_nodes(spark, d):
    return graph.isolated(entities(spark, d), relations(spark, d)).select("id", "name", "type")


@query(f"""WITH {GRAPH_SQL}, {BOTH_SQL}, x AS (SELECT (SELECT count(*) FROM ent) AS n, (SELECT count(*) // 2 FROM both_ways) AS m)
SELECT n, m, round(least(1.0, m / (n * (n - 1) / 2)), 9) AS density FROM x""")
def graph_density(spark, d):
    return graph.density(entities(spark, d), relations(spark, d)).withColumn("density", F.round("density", 9))


@query(f"WITH {GRAPH_SQL} SELECT type, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM ent), 6) AS percentage FROM ent GROUP BY type")
def entity_type_distribution(spark, d):
    total = Window.partitionBy()
    return entities(spark, d).groupBy("type").agg(F.count("*").alias("n")).withColumn("percentage", F.round(100 * F.col("n") / F.sum("n").over(total), 6))


@query(f"WITH {GRAPH_SQL} SELECT type, count(*) AS n, round(avg(n), 6) AS mean_weight, max(n) AS max_weight FROM rel GROUP BY type")
def relation_type_distribution(spark, d):
    return relations(spark, d).withColumnRenamed("n", "w").groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean_weight"), F.max("w").alias("max_weight"))


@query(f"""WITH {GRAPH_SQL}, k AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, type FROM (SELECT 'n:' || split_part(src, ':', 2) AS src, dst, type FROM rel))
SELECT a, b, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(DISTINCT type) AS n_types FROM k GROUP BY a, b HAVING count(DISTINCT type) > 1""")
def parallel_edge_types(spark, d):
    merged = relations(spark, d).withColumn("src", F.concat(F.lit("n:"), F.substring_index("src", ":", -1)))
    return graph.parallel_types(merged)


@query(f"""WITH {GRAPH_SQL}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id, dst AS o FROM rel UNION ALL SELECT dst, src FROM rel) GROUP BY id)
SELECT min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree, count(*) AS connected FROM deg""")
def degree_statistics(spark, d):
    deg = graph.degrees(entities(spark, d), relations(spark, d)).where("degree > 0")
    return deg.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.count("*").alias("connected"))


@query("""SELECT c_custkey, c_name, count(DISTINCT l_partkey) AS facts FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 20""")
def fact_counts(spark, d):
    c, o, li = (read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    bought = o.join(li, o.o_orderkey == li.l_orderkey).select("o_custkey", "l_partkey").distinct().groupBy("o_custkey").agg(F.count("l_partkey").alias("facts"))
    return c.join(bought.where("facts >= 20"), c.c_custkey == F.col("o_custkey")).select("c_custkey", "c_name", "facts")


EDGE_SQL = "e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS src, l_partkey % 50 AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'knows' ELSE 'KNOWS' END AS type, round(0.5 + l_discount * 4, 4) AS confidence FROM lineitem)"


def _edges(spark, d):
    return read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"),
        F.when(F.col("l_linenumber") % 2 == 0, "knows").otherwise("KNOWS").alias("type"), F.round(0.5 + F.col("l_discount") * 4, 4).alias("confidence"),
    )


@query(f"""WITH {EDGE_SQL}, r AS (SELECT id, row_number() OVER w AS rn, first(id) OVER w AS primary_id FROM e WINDOW w AS (PARTITION BY src, dst, upper(type) ORDER BY confidence DESC, id))
SELECT id, primary_id FROM r WHERE rn > 1""")
def relation_exact_duplicates(spark, d):
    return dedup.exact_duplicates(_edges(spark, d))


@query(f"""WITH {EDGE_SQL} SELECT src, dst, t AS type, id, confidence FROM (SELECT *, lower(type) AS t, row_number() OVER (PARTITION BY src, dst, lower(type) ORDER BY confidence DESC, id) AS rn FROM e) WHERE rn = 1""")
def relation_dedup(spark, d):
    e = _edges(spark, d).withColumn("type", F.lower("type"))
    return dedup.best_per_key(e, [F.col("src"), F.col("dst"), F.col("type")], [F.desc("confidence"), F.col("id")]).select("src", "dst", "type", "id", "confidence")


@query("""WITH x AS (SELECT o_orderkey AS id, o_custkey % 100 AS src, o_custkey // 100 % 100 AS dst, o_orderpriority AS type, round(o_totalprice / 1000000, 6) AS confidence FROM orders)
SELECT a.id, min(b.id) AS primary_id FROM x a JOIN x b ON a.src = b.dst AND a.dst = b.src AND a.type = b.type AND (a.confidence < b.confidence OR (a.confidence = b.confidence AND a.id > b.id)) GROUP BY a.id""")
def relation_reversed_duplicates(spark, d):
    o = read(spark, d, "orders")
    e = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("src"), (F.floor(F.col("o_custkey") / 100) % 100).alias("dst"), F.col("o_orderpriority").alias("type"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence"))
    return dedup.reversed_duplicates(e)


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS s, o_orderdate < TIMESTAMP '1996-01-01' AS old FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, old DESC, id) AS rn FROM o) SELECT k, id, s, old FROM m WHERE rn = 1""")
def entity_upsert(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("s"), (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).alias("old"))
    first = lambda df: dedup.best_per_key(df, [F.col("k")], [F.desc("s"), F.col("id")])
    return dedup.upsert(first(o.where("old")), first(o.where("not old")), "k", "s").select("k", "id", "s", "old")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, e AS (SELECT src, dst FROM rel WHERE type IN ('IN_REGION', 'LOCATED_IN')), b AS (SELECT src u, dst v FROM e UNION SELECT dst, src FROM e),
p AS (SELECT 'r:0' AS node, 0 AS distance UNION SELECT v, distance + 1 FROM p JOIN b ON u = node WHERE distance < 4) SELECT node, min(distance)::INT AS distance FROM p WHERE node <> 'r:0' GROUP BY node""")
def shortest_paths_from_region(spark, d):
    e = relations(spark, d).where("type in ('IN_REGION', 'LOCATED_IN')")
    return graph.neighbours(e, entities(spark, d).where("id = 'r:0'").select("id"), 4).select("node", "distance")


@query(f"WITH {GRAPH_SQL} SELECT src, dst, type FROM rel WHERE src IN (SELECT id FROM ent WHERE id LIKE '%7') AND dst IN (SELECT id FROM ent WHERE id LIKE '%7')")
def induced_subgraph(spark, d):
    keep = entities(spark, d).where("id like '%7'").select("id")
    r = relations(spark, d)
    return r.join(keep, r.src == keep.id, "left_semi").join(keep, r.dst == keep.id, "left_semi").select("src", "dst", "type")


@query(f"""WITH {GRAPH_SQL} SELECT id, name, type, CASE WHEN lower(name) = 'customer#000000001' THEN 0 ELSE 1 END AS exact FROM ent WHERE contains(lower(name), '00001') AND type IN ('CUSTOMER', 'SUPPLIER')""")
def entity_search(spark, d):
    hit = F.lower("name").contains("00001") & F.col("type").isin("CUSTOMER", "SUPPLIER")
    return entities(spark, d).where(hit).select("id", "name", "type", F.when(F.lower("name") == "customer#000000001", 0).otherwise(1).alias("exact"))
