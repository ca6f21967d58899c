"""Queries that audit, merge, summarise and segment: the maintenance and transcript side of the library."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowmill.functions import text as T
from knowmill.operators import dedup
from knowmill.plans.registry import query
from knowmill.plans.text_queries import TOKEN_SQL
from knowmill.sources.tables import GRAPH_SQL, entities, read, relations


@query("SELECT label, count(*) AS total, count(embedding) AS with_vector, count(*) - count(embedding) AS without_vector, round(avg(len(embedding)), 6) AS mean_dimension FROM embeddings GROUP BY label")
def embedding_coverage(spark, d):
    e = read(spark, d, "embeddings").groupBy("label")
    return e.agg(F.count("*").alias("total"), F.count("embedding").alias("with_vector"), (F.count("*") - F.count("embedding")).alias("without_vector"), F.round(F.avg(F.when(F.col("embedding").isNotNull(), F.size("embedding"))), 6).alias("mean_dimension"))


@query("SELECT l_suppkey, round(sum(l_discount * l_discount) / sum(l_discount), 6) AS confidence FROM lineitem GROUP BY l_suppkey HAVING sum(l_discount) > 0")
def weighted_confidence(spark, d):
    """The mean of confidences weighted by themselves."""
    c = F.col("l_discount")
    sums = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(c * c).alias("squares"), F.sum(c).alias("total")).where("total > 0")
    return sums.select("l_suppkey", F.round(F.col("squares") / F.col("total"), 6).alias("confidence"))


@query("SELECT coalesce(source, 'UNCATEGORIZED') AS category, lang, count(*) AS n FROM documents GROUP BY ALL")
def category_distribution(spark, d):
    return read(spark, d, "documents").groupBy(F.coalesce("source", F.lit("UNCATEGORIZED")).alias("category"), "lang").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, 'fact_' || substr(md5(text || ':' || conv_id::VARCHAR), 1, 12) AS fact_id FROM conversations WHERE text IS NOT NULL")
def fact_ids(spark, d):
    digest = F.md5(F.concat_ws(":", "text", F.col("conv_id").cast("string")))
    return read(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.concat(F.lit("fact_"), F.substring(digest, 1, 12)).alias("fact_id"))


@query("""WITH c AS (SELECT o_orderpriority, regexp_replace(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k, count(*) AS n FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority AS kind, CASE WHEN regexp_matches(k, '^[A-Z]') THEN k ELSE 'TYPE_' || k END AS label, n FROM c""")
def type_labels(spark, d):
    kinds = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.select("kind", T.label(F.col("kind")).alias("label"), "n")


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) AS documents, count(*) AS chunks, count(DISTINCT l_partkey) AS entities, round(avg(l_discount), 6) AS mean_confidence
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def document_path_counts(spark, d):
    """Documents, chunks and distinct entities along the paths from each owner."""
    o, li = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    paths = o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_custkey")
    return paths.agg(F.count_distinct("o_orderkey").alias("documents"), F.count("*").alias("chunks"), F.count_distinct("l_partkey").alias("entities"), F.round(F.avg("l_discount"), 6).alias("mean_confidence"))


@query(f"""WITH {GRAPH_SQL} SELECT dst AS id, count(DISTINCT src) AS connections, min(src) AS first_member, max(src) AS last_member FROM rel WHERE type = 'LOCATED_IN' GROUP BY dst HAVING count(DISTINCT src) >= 3""")
def star_clusters(spark, d):
    """Entities with three members or more around them."""
    r = relations(spark, d).where("type = 'LOCATED_IN'").groupBy(F.col("dst").alias("id"))
    return r.agg(F.count_distinct("src").alias("connections"), F.min("src").alias("first_member"), F.max("src").alias("last_member")).where("connections >= 3")


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOKEN_SQL.format("text")}) AS a, list_distinct({TOKEN_SQL.format("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")}) AS b FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS s FROM t WHERE b IS NOT NULL AND a IS NOT NULL)
SELECT conv_id, turn, round(s, 6) AS similarity, s < 0.1 AS boundary FROM s""")
def topic_boundaries(spark, d):
    """Turns that share few words with the turn before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = read(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).where("text is not null and before is not null")
    s = T.jaccard(F.col("text"), F.col("before"))
    return pairs.select("conv_id", "turn", F.round(s, 6).alias("similarity"), (s < 0.1).alias("boundary"))


@query("""SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3)::INT AS target FROM orders""")
def round_robin_balance(spark, d):
    """The i-th fact of an owner goes to target i mod 3."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", ((F.row_number().over(w) - 1) % 3).alias("target"))


@query("""SELECT lower(p_name) AS name, count(*) AS copies, min(p_partkey) AS primary_id, max(p_retailprice) AS confidence FROM part WHERE trim(p_name) <> '' GROUP BY lower(p_name)""")
def entity_name_dedup(spark, d):
    """One entity for each name regardless of case; the highest confidence stays."""
    p = read(spark, d, "part").where(F.trim("p_name") != "").groupBy(F.lower("p_name").alias("name"))
    return p.agg(F.count("*").alias("copies"), F.min("p_partkey").alias("primary_id"), F.max("p_retailprice").alias("confidence"))


@query("""SELECT conv_id, turn, key FROM (SELECT conv_id, turn, md5(lower(trim(text))) AS key, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY conv_id, turn) AS rn FROM conversations WHERE trim(text) <> '') WHERE rn = 1""")
def fact_text_dedup(spark, d):
    """The first turn of each text, compared in lower case and without outer spaces."""
    c = read(spark, d, "conversations").where(F.trim("text") != "").select("conv_id", "turn", F.md5(F.lower(F.trim("text"))).alias("key"))
    return dedup.best_per_key(c, [F.col("key")], [F.col("conv_id"), F.col("turn")])


@query("""SELECT l_suppkey AS src, l_partkey % 50 AS dst, count(DISTINCT l_orderkey) AS n_sources, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS sources, round(max(l_discount), 6) AS confidence FROM lineitem GROUP BY ALL""")
def relation_merge_lineage(spark, d):
    """Merged relations keep the union of their sources."""
    merged = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"))
    sources = F.array_sort(F.collect_set(F.col("l_orderkey").cast("string")))
    out = merged.agg(sources.alias("s"), F.round(F.max("l_discount"), 6).alias("confidence"))
    return out.select("src", "dst", F.size("s").cast("long").alias("n_sources"), F.array_join("s", ",").alias("sources"), "confidence")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')""")
def cascade_delete(spark, d):
    """Chunks that stay when old documents are deleted with all they contain."""
    old = read(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(old, "l_orderkey", "left_anti")


@query("""SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey WHERE c.c_custkey IS NULL GROUP BY e.user_id""")
def orphaned_references(spark, d):
    """References to entities that do not exist."""
    e, c = read(spark, d, "events").select("user_id"), read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return e.join(c, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH {GRAPH_SQL}, g AS (SELECT *, lower(trim(name)) AS low FROM ent)
SELECT type, sum(CASE WHEN length(low) < 3 OR low IN ('unknown', 'none', 'n/a', 'entity', 'other', 'misc') OR regexp_matches(low, '^(the|a|this) [a-z]{{1,3}}$') OR NOT regexp_matches(low, '\\p{{L}}') THEN 1 ELSE 0 END)::BIGINT AS n_generic, count(*) AS n FROM g GROUP BY type""")
def generic_names(spark, d):
    e = entities(spark, d)
    return e.groupBy("type").agg(F.sum(T.generic_name(F.col("name")).cast("long")).alias("n_generic"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[.!?]+[ \\n]+')) AS sentence FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, count(*) AS sentences, max(length(sentence)) AS longest FROM s WHERE sentence <> '' GROUP BY conv_id, turn""")
def sentence_statistics(spark, d):
    s = read(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.explode(F.split("text", r"[.!?]+[ \n]+", -1)).alias("sentence")).where("sentence <> ''")
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).cast("long").alias("longest"))


@query("""SELECT event_type, CASE WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'moderate' ELSE 'low' END AS band, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def score_bands(spark, d):
    band = F.when(F.col("value") >= 80, "high").when(F.col("value") >= 50, "moderate").otherwise("low")
    return read(spark, d, "events").where("value is not null").groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_id, (event_id * 37 % 20000)::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS stamp FROM t""")
def timestamp_labels(spark, d):
    """Seconds as MM:SS, with hours where there are any."""
    s = (F.col("event_id") * 37 % 20000).cast("long")
    return read(spark, d, "events").select("event_id", T.time_label(s).alias("stamp"))
