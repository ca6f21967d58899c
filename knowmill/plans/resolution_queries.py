"""Entity resolution over part names, and fusion of result lists."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowmill.functions import similarity as S
from knowmill.functions import text as T
from knowmill.operators import dedup, fusion, resolve
from knowmill.plans.registry import query
from knowmill.plans.text_queries import TOKEN_SQL
from knowmill.sources.tables import read

#: Types that the test tables put in one family.
FAMILIES = (("ECONOMY", "STANDARD"),)
ENTITY_SQL = "e AS (SELECT min(p_partkey) AS ord, p_name AS name, p_type AS type, min(p_brand) AS doc FROM part GROUP BY p_name, p_type)"
#: Similarity of entities x and y.
JACCARD_SQL = "len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))"
NAME_SQL = f"""CASE WHEN lower(x.name) = lower(y.name) THEN 1.0 WHEN contains(lower(x.name), lower(y.name)) OR contains(lower(y.name), lower(x.name)) THEN 0.8
  ELSE greatest({JACCARD_SQL}, 1 - levenshtein(lower(x.name), lower(y.name)) / greatest(length(x.name), length(y.name))) END"""
SCORE_SQL = f"""0.6 * ({NAME_SQL}) + 0.3 * CASE WHEN x.type = y.type THEN 1.0 WHEN x.type IN ('ECONOMY', 'STANDARD') AND y.type IN ('ECONOMY', 'STANDARD') THEN 0.8 ELSE 0.0 END
  + 0.1 * CASE WHEN x.doc = y.doc THEN 1.0 ELSE 0.3 END"""
PAIRS_SQL = f"""{ENTITY_SQL}, tok AS (SELECT *, list_distinct({TOKEN_SQL.format("name")}) AS t FROM e),
pairs AS (SELECT x.ord AS a, y.ord AS b, {SCORE_SQL} AS score FROM tok x JOIN tok y ON x.ord < y.ord WHERE {SCORE_SQL} >= 0.7)"""
GREEDY_SQL = f"""WITH RECURSIVE {PAIRS_SQL}, seq AS (SELECT ord, row_number() OVER (ORDER BY ord) AS k, coalesce((SELECT list(a) FROM pairs WHERE b = ord), []) AS near FROM e),
g AS (SELECT 0::BIGINT AS k, -1::BIGINT AS ord, -1::BIGINT AS primary_id, []::BIGINT[] AS heads UNION ALL
  SELECT s.k, s.ord, coalesce(list_min(list_intersect(s.near, g.heads)), s.ord), CASE WHEN len(list_intersect(s.near, g.heads)) = 0 THEN list_append(g.heads, s.ord) ELSE g.heads END
  FROM g JOIN seq s ON s.k = g.k + 1), clusters AS (SELECT ord, primary_id FROM g WHERE k > 0)"""


def named(spark, d):
    g = read(spark, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return g.agg(F.min("p_partkey").alias("ord"), F.min("p_brand").alias("doc"))


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(score, 6) AS score FROM pairs")
def entity_pairs(spark, d):
    """All pairs of entities alike by name, type and document."""
    return resolve.candidates(named(spark, d), families=FAMILIES).withColumn("score", F.round("score", 6))


@query(f"{GREEDY_SQL} SELECT ord, primary_id FROM clusters")
def entity_clusters_greedy(spark, d):
    """Each entity joins the first primary like it, in order of input."""
    e = named(spark, d)
    return resolve.greedy(e, resolve.candidates(e, families=FAMILIES)).select("ord", F.col("primary").alias("primary_id"))


@query(f"""{GREEDY_SQL}, m AS (SELECT primary_id, avg(score) AS score, count(*) AS n, count(DISTINCT e.type) AS kinds FROM clusters c JOIN pairs p ON p.a = c.primary_id AND p.b = c.ord JOIN e ON e.ord = c.ord WHERE c.ord <> c.primary_id GROUP BY primary_id)
SELECT primary_id, n, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 0.9 WHEN score >= 0.7 AND kinds = 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence, score >= 0.9 OR (score >= 0.7 AND kinds = 1) AS confirmed FROM m""")
def merge_confirmation(spark, d):
    """Clusters confirmed by mean similarity, or by a lower one where all have one type."""
    e = named(spark, d)
    pairs = resolve.candidates(e, families=FAMILIES)
    c = resolve.greedy(e, pairs).where("ord <> primary")
    m = c.join(pairs, (F.col("a") == F.col("primary")) & (F.col("b") == F.col("ord"))).join(e.select("ord", "type"), "ord")
    m = m.groupBy("primary").agg(F.avg("score").alias("s"), F.count("*").alias("n"), F.count_distinct("type").alias("kinds"))
    confidence = F.when(F.col("s") >= 0.9, 0.9).when((F.col("s") >= 0.7) & (F.col("kinds") == 1), 0.8).otherwise(0.0)
    return m.select(F.col("primary").alias("primary_id"), "n", F.round("s", 6).alias("score"), confidence.alias("confidence"), (confidence >= 0.8).alias("confirmed"))


@query(f"""{GREEDY_SQL}, r AS (SELECT l_orderkey * 10 + l_linenumber AS id, a.ord AS src, l_suppkey AS dst, l_returnflag AS type, round(0.5 + l_discount * 4, 4) AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN e a ON a.name = p_name AND a.type = p_type), m AS (SELECT id, coalesce(primary_id, src) AS src, dst, type, confidence FROM r LEFT JOIN clusters ON ord = src)
SELECT src, dst, type, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, lower(type) ORDER BY confidence DESC, id) AS rn FROM m) WHERE rn = 1""")
def relations_after_merge(spark, d):
    """Relations moved to the primaries of their ends, the most confident of equal ones staying."""
    e = named(spark, d)
    clusters = resolve.greedy(e, resolve.candidates(e, families=FAMILIES))
    li, p = read(spark, d, "lineitem"), read(spark, d, "part")
    r = li.join(p, li.l_partkey == p.p_partkey).join(e, (F.col("p_name") == F.col("name")) & (F.col("p_type") == F.col("type")))
    r = r.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("ord").alias("src"), (F.col("l_suppkey") + 10**9).alias("dst"), F.col("l_returnflag").alias("type"),
        F.round(0.5 + F.col("l_discount") * 4, 4).alias("confidence"),
    )
    moved = resolve.remap(r, clusters).withColumn("dst", F.col("dst") - 10**9)
    best = dedup.best_per_key(moved, [F.col("src"), F.col("dst"), F.lower("type")], [F.desc("confidence"), F.col("id")])
    return best.select("src", "dst", "type", "id", "confidence")


VARIANT_SQL = " OR ".join(f"{f.format('n')} = {f.format('m')}" for f in ("rtrim({}, 's')", "replace({}, '-', ' ')", "replace({}, ' ', '-')", "replace({}, '3', 'drei')"))
KEYWORD_SQL = f"""k AS (SELECT min(p_partkey) AS ord, p_name AS name, 'KEYWORD' AS type, min(p_brand) AS doc FROM part GROUP BY p_name UNION ALL
  SELECT -min(p_partkey) * 2 - 2, split_part(p_name, ' ', 1) || 's', 'KEYWORD', min(p_brand) FROM part GROUP BY split_part(p_name, ' ', 1) UNION ALL
  SELECT -min(p_partkey) * 2 - 1, split_part(p_name, ' ', 1), 'KEYWORD', min(p_brand) FROM part GROUP BY split_part(p_name, ' ', 1)),
x AS (SELECT *, list_distinct({TOKEN_SQL.format("replace(name, '_', ' ')")}) AS t FROM k),
s AS (SELECT x.ord AS a, y.ord AS b, replace(lower(trim(x.name)), '_', ' ') AS n, replace(lower(trim(y.name)), '_', ' ') AS m, {JACCARD_SQL} AS j, {SCORE_SQL} AS base FROM x JOIN x y ON x.ord < y.ord),
w AS (SELECT a, b, base, CASE WHEN n = m THEN 1.0 WHEN {VARIANT_SQL} THEN 0.9 WHEN contains(n, m) OR contains(m, n) THEN 0.8 WHEN j > 0 THEN greatest(j, 0.6) ELSE 0.0 END AS score FROM s)"""


def _keywords(spark, d):
    """Part names, and their first words, alone and as plurals."""
    p = read(spark, d, "part")
    row = lambda name, ord_: p.groupBy(name.alias("name")).agg(ord_.alias("ord"), F.min("p_brand").alias("doc")).select("ord", "name", F.lit("KEYWORD").alias("type"), "doc")
    first, least = F.split("p_name", " ")[0], F.min("p_partkey")
    return row(F.col("p_name"), least).union(row(F.concat(first, F.lit("s")), -least * 2 - 2)).union(row(first, -least * 2 - 1))


@query(f"WITH {KEYWORD_SQL} SELECT a, b, round(score, 6) AS score, round(0.4 * base + 0.6 * score, 6) AS blend FROM w WHERE score > 0")
def keyword_pairs(spark, d):
    """Keywords that are variants, hold one another or share a word, with their similarity and its blend with that of entities."""
    out = resolve.keyword_candidates(_keywords(spark, d))
    return out.select("a", "b", F.round("keyword_score", 6).alias("score"), F.round("score", 6).alias("blend"))


@query(f"""WITH RECURSIVE {KEYWORD_SQL}, pairs AS (SELECT a, b, 0.4 * base + 0.6 * score AS score FROM w WHERE score > 0 AND 0.4 * base + 0.6 * score >= 0.75),
seq AS (SELECT ord, row_number() OVER (ORDER BY ord) AS k, coalesce((SELECT list(a) FROM pairs WHERE b = ord), []) AS near FROM k),
g AS (SELECT 0::BIGINT AS k, -1::BIGINT AS ord, -1::BIGINT AS primary_id, []::BIGINT[] AS heads UNION ALL
  SELECT s.k, s.ord, coalesce(list_min(list_intersect(s.near, g.heads)), s.ord), CASE WHEN len(list_intersect(s.near, g.heads)) = 0 THEN list_append(g.heads, s.ord) ELSE g.heads END FROM g JOIN seq s ON s.k = g.k + 1)
SELECT primary_id, count(*) AS n, round(avg(score), 6) AS score FROM g JOIN pairs ON a = primary_id AND b = ord WHERE ord <> primary_id GROUP BY primary_id HAVING count(*) < 7 AND avg(score) >= 0.85""")
def keyword_merges(spark, d):
    """Keywords to merge: clusters by the blend, of fewer than eight, confirmed where they are alike enough on average."""
    k = _keywords(spark, d)
    pairs = resolve.keyword_candidates(k, 0.75)
    c = resolve.greedy(k, pairs).where("ord <> primary")
    m = c.join(pairs, (F.col("a") == F.col("primary")) & (F.col("b") == F.col("ord"))).groupBy(F.col("primary").alias("primary_id"))
    return m.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score")).where("n < 7 and score >= 0.85")


@query(f"""WITH {ENTITY_SQL}, q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS mention FROM part), s AS (SELECT mention, ord, name, CASE WHEN lower(name) = lower(mention) THEN 1.0 WHEN contains(lower(name), lower(mention)) THEN 0.9 ELSE 0.0 END::DOUBLE AS score FROM q JOIN e ON contains(lower(name), lower(mention)))
SELECT mention, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, ord) AS rn FROM s WHERE score >= 0.7) WHERE rn = 1""")
def entity_linking(spark, d):
    """The best entity for each mention: equal, or holding it as a word."""
    e = named(spark, d)
    q = read(spark, d, "part").select(F.split("p_name", " ")[1].alias("mention")).distinct()
    t = e.select("ord", "name", F.explode(F.array_distinct(T.tokens(F.col("name")))).alias("token"))
    s = q.join(t, F.lower("mention") == F.col("token")).withColumn("score", F.when(F.lower("name") == F.lower("mention"), 1.0).otherwise(0.9))
    return dedup.best_per_key(s, [F.col("mention")], [F.desc("score"), F.col("ord")]).select("mention", "ord", "score")


@query("""WITH f(t) AS (VALUES ('WORKS_FOR'), ('EMPLOYED_BY'), ('LOCATED_IN'), ('BASED_IN'), ('OWNS')), x AS (SELECT o_orderkey AS id, o_custkey AS src, o_orderkey % 7 AS dst, CASE o_orderkey % 5 WHEN 0 THEN 'WORKS_FOR' WHEN 1 THEN 'EMPLOYED_BY' WHEN 2 THEN 'LOCATED_IN' WHEN 3 THEN 'BASED_IN' ELSE 'OWNS' END AS type,
round(o_totalprice / 1000000, 6) AS confidence FROM orders), y AS (SELECT *, CASE type WHEN 'EMPLOYED_BY' THEN 'WORKS_AT' WHEN 'WORKS_FOR' THEN 'WORKS_AT' WHEN 'BASED_IN' THEN 'LOCATED_IN' ELSE type END AS family FROM x)
SELECT id, primary_id, family FROM (SELECT *, row_number() OVER w AS rn, first(id) OVER w AS primary_id FROM y WINDOW w AS (PARTITION BY src, dst, family ORDER BY confidence DESC, id)) WHERE rn > 1""")
def relation_synonyms(spark, d):
    """Relations between the same two whose types mean the same: each with the most confident one."""
    o = read(spark, d, "orders")
    kinds = ["WORKS_FOR", "EMPLOYED_BY", "LOCATED_IN", "BASED_IN", "OWNS"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    x = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 7).alias("dst"), S.family(kind, S.SYNONYMS).alias("family"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence"))
    w = Window.partitionBy("src", "dst", "family").orderBy(F.desc("confidence"), "id")
    return x.withColumn("primary_id", F.first("id").over(w)).withColumn("rn", F.row_number().over(w)).where("rn > 1").select("id", "primary_id", "family")


LISTS_SQL = """v AS (SELECT p_size AS query_id, 'part ' || p_partkey AS content, round(p_retailprice / 3000, 6) AS score FROM part WHERE p_partkey % 3 <> 0),
g AS (SELECT p_size AS query_id, 'part ' || p_partkey AS content, round(0.2 + p_partkey % 17 / 20, 6) AS score FROM part WHERE p_partkey % 2 = 0 AND p_size % 5 <> 0),
a AS (SELECT DISTINCT p_size AS query_id, p_size % 3 AS n_entities, p_size % 10 / 10 AS complexity FROM part),
w AS (SELECT query_id, 0.6 * CASE WHEN n_entities >= 2 THEN 0.8 ELSE 1 END * CASE WHEN complexity > 0.7 THEN 0.9 ELSE 1 END AS x, 0.4 * CASE WHEN n_entities >= 2 THEN 1.3 ELSE 1 END * CASE WHEN complexity > 0.7 THEN 1.2 ELSE 1 END AS y FROM a),
weighted AS (SELECT query_id, content, coalesce(v.score * x / (x + y), 0) + coalesce(g.score * y / (x + y), 0) * CASE WHEN v.score IS NOT NULL AND g.score IS NOT NULL THEN 0.5 ELSE 1 END AS score,
  CASE WHEN v.score IS NULL THEN 'hybrid_graph' WHEN g.score IS NULL THEN 'hybrid_vector' ELSE 'hybrid_both' END AS found_by FROM v FULL JOIN g USING (query_id, content) JOIN w USING (query_id)),
ranks AS (SELECT query_id, content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content) AS r FROM v UNION ALL SELECT query_id, content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content) FROM g),
rrf AS (SELECT query_id, content, sum(1 / (60 + r)) AS score, 'hybrid_rank' AS found_by FROM ranks GROUP BY ALL),
pick AS (SELECT query_id, NOT (complexity > 0.6 AND n_entities >= 2) AND query_id IN (SELECT query_id FROM v) AND query_id IN (SELECT query_id FROM g) AS by_rank FROM a)"""


def _lists(spark, d):
    p = read(spark, d, "part")
    row = lambda s: [F.col("p_size").alias("query_id"), F.concat(F.lit("part "), "p_partkey").alias("content"), F.round(s, 6).alias("score")]
    v = p.where("p_partkey % 3 <> 0").select(*row(F.col("p_retailprice") / 3000))
    g = p.where("p_partkey % 2 = 0 and p_size % 5 <> 0").select(*row(0.2 + F.col("p_partkey") % 17 / 20))
    a = p.select(F.col("p_size").alias("query_id")).distinct().select("query_id", (F.col("query_id") % 3).alias("n_entities"), (F.col("query_id") % 10 / 10).alias("complexity"))
    return v, g, a


@query(f"""WITH {LISTS_SQL} SELECT query_id, content, score, found_by FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY found_by DESC, score DESC) AS rn FROM
(SELECT *, 'vector' AS found_by FROM v UNION ALL SELECT *, 'graph' FROM g)) WHERE rn = 1""")
def simple_fusion(spark, d):
    return fusion.simple(*_lists(spark, d)[:2])


@query(f"WITH {LISTS_SQL} SELECT query_id, content, round(score, 6) AS score, found_by FROM weighted")
def weighted_combination(spark, d):
    return fusion.weighted(*_lists(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {LISTS_SQL} SELECT query_id, content, round(score, 8) AS score, found_by FROM (SELECT * FROM rrf WHERE query_id IN (SELECT query_id FROM pick WHERE by_rank) UNION ALL SELECT * FROM weighted WHERE query_id IN (SELECT query_id FROM pick WHERE NOT by_rank))")
def adaptive_fusion(spark, d):
    return fusion.adaptive(*_lists(spark, d)).withColumn("score", F.round("score", 8))


@query(f"""WITH {LISTS_SQL} SELECT query_id, content, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content) AS rank FROM weighted WHERE score >= 0.3) WHERE rank <= 10""")
def ranked_results(spark, d):
    out = fusion.rank_and_filter(fusion.weighted(*_lists(spark, d)))
    return out.select("query_id", "content", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {LISTS_SQL}, found AS (SELECT query_id, content FROM v WHERE score >= 0.31) SELECT g.query_id, count(*) AS discovered, round(max(g.score), 6) AS best FROM g ANTI JOIN found f ON f.query_id = g.query_id AND f.content = g.content GROUP BY g.query_id""")
def entity_sources(spark, d):
    """Discovered entities that were not linked already."""
    v, g, _ = _lists(spark, d)
    new = g.join(v.where("score >= 0.31").select("query_id", "content"), ["query_id", "content"], "left_anti")
    return new.groupBy("query_id").agg(F.count("*").alias("discovered"), F.round(F.max("score"), 6).alias("best"))


LEGS_SQL = f"""q AS (SELECT item_id AS query_id, list_distinct({TOKEN_SQL.format("text")}) AS w, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) AS names FROM benchmark),
t AS (SELECT conv_id * 1000 + turn AS item, list_distinct({TOKEN_SQL.format("text")}) AS w, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) AS names FROM conversations WHERE text IS NOT NULL),
v AS (SELECT query_id, item::VARCHAR AS content, len(list_intersect(q.w, t.w)) / sqrt(len(q.w) * len(t.w)) AS score FROM q JOIN t ON len(list_intersect(q.w, t.w)) > 0),
g AS (SELECT query_id, item::VARCHAR AS content, least(1.0, 0.5 + 0.1 * len(list_intersect(q.names, t.names))) AS score FROM q JOIN t ON len(list_intersect(q.names, t.names)) > 0),
a AS (SELECT query_id, len(names) AS n, (least(1.0, len(w) / 20) + least(1.0, len(names) / 5)) / 3 AS complexity FROM q),
w AS (SELECT query_id, 0.6 * CASE WHEN n >= 2 THEN 0.8 ELSE 1 END * CASE WHEN complexity > 0.7 THEN 0.9 ELSE 1 END AS x, 0.4 * CASE WHEN n >= 2 THEN 1.3 ELSE 1 END * CASE WHEN complexity > 0.7 THEN 1.2 ELSE 1 END AS y FROM a),
f AS (SELECT query_id, content, coalesce(v.score * x / (x + y), 0) + coalesce(g.score * y / (x + y), 0) * CASE WHEN v.score IS NOT NULL AND g.score IS NOT NULL THEN 0.5 ELSE 1 END AS score FROM v FULL JOIN g USING (query_id, content) JOIN w USING (query_id))"""


@query(f"WITH {LEGS_SQL} SELECT query_id, content, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content) AS rank FROM f WHERE score >= 0.1) WHERE rank <= 10")
def hybrid_search(spark, d):
    """Each question's ten best turns: a leg by cosine over words, a leg by shared names, fused by weights that follow from
    the question. Both legs meet questions through an inverted index on words and names."""
    words, names = F.array_distinct(T.tokens(F.col("text"))), F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1)))
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w"), names.alias("names"))
    t = read(spark, d, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("content"), words.alias("w"), names.alias("names"))
    pairs = lambda c: q.select("query_id", F.size(c).alias("nq"), F.explode(c).alias("k")).join(t.select("content", F.size(c).alias("nt"), F.explode(c).alias("k")), "k").groupBy("query_id", "content", "nq", "nt").agg(F.count("*").alias("n"))
    v = pairs("w").select("query_id", "content", (F.col("n") / F.sqrt(F.col("nq") * F.col("nt"))).alias("score"))
    g = pairs("names").select("query_id", "content", F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n")).alias("score"))
    hard = (F.least(F.lit(1.0), F.size("w") / 20) + F.least(F.lit(1.0), F.size("names") / 5)) / 3
    a = q.select("query_id", F.size("names").alias("n_entities"), hard.alias("complexity"))
    out = fusion.rank_and_filter(fusion.weighted(v, g, a), 0.1)
    return out.select("query_id", "content", F.round("score", 6).alias("score"), "rank")
