"""Reasoning paths, retrieval by levels and rounds, citations, topics by vectors, and batches published as a whole."""

import uuid

from pyspark.sql import functions as F

from knowmill.operators import chunking as C
from knowmill.operators import citations as L
from knowmill.operators import fact_scores as FS
from knowmill.operators import reasoning as R
from knowmill.plans.registry import query
from knowmill.sources import store as S
from knowmill.sources.shared import shared_dir
from knowmill.sources.tables import bought, node, read

BOUGHT_SQL = "bought AS (SELECT o_custkey AS c, -l_partkey AS p, count(*)::DOUBLE AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), ways AS (SELECT c AS src, p AS dst, w FROM bought UNION ALL SELECT p, c, w FROM bought)"


def _bought(spark, d):
    """Customers and (below nought) the parts they bought."""
    return bought(spark, d).select(F.col("o_custkey").alias("src"), (-F.col("l_partkey")).alias("dst"), F.col("count").alias("weight"))


@query(f"""WITH RECURSIVE {BOUGHT_SQL}, pairs AS (SELECT a.c_custkey AS source, b.c_custkey AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 50 WHERE a.c_custkey % 50 = 0),
walk AS (SELECT DISTINCT source AS start, source AS node, [source] AS path, 0::DOUBLE AS weight, 0 AS n FROM pairs UNION ALL
  SELECT start, dst, list_append(path, dst), weight + w, n + 1 FROM walk JOIN ways ON src = node WHERE n < 3 AND NOT list_contains(path, dst)),
done AS (SELECT source, target, list_append(path, target) AS path, weight + w AS weight, n + 2 AS nodes FROM walk JOIN pairs ON source = start JOIN ways ON src = node AND dst = target WHERE NOT list_contains(path, target)),
scored AS (SELECT source, target, path, round((greatest(0, 10 - nodes) + least(weight, 10)) / 2 + least(weight / 10, 2) - 0.5 * greatest(0, nodes - 4), 9) AS relevance, CASE WHEN nodes <= 3 THEN 6.0 ELSE 5.0 END::DOUBLE AS confidence FROM done)
SELECT source, target, array_to_string(path, '>') AS path, relevance, confidence, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY relevance DESC, confidence DESC, path) AS rank FROM scored) WHERE rank <= 10""")
def reasoning_paths(spark, d):
    """The ten best paths of up to four edges between customers through what they bought, walked from both ends."""
    c = read(spark, d, "customer").select("c_custkey")
    pairs = c.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") + 50).alias("target"))
    pairs = pairs.join(c.withColumnRenamed("c_custkey", "target"), "target", "left_semi")
    out = R.reasoning_paths(_bought(spark, d), pairs, "bidirectional", 4, 10)
    return out.select("source", "target", F.array_join("path", ">").alias("path"), "relevance", "confidence", "rank")


LINKS_SQL = """f AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, round(0.5 + l_discount * 4, 4) AS score, 'c' || o_custkey AS c, 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
links AS (SELECT fact_id, c AS entity, score FROM f UNION ALL SELECT fact_id, p, score FROM f UNION ALL SELECT fact_id, s, score FROM f),
front0 AS (SELECT c_custkey AS query_id, 'c' || c_custkey AS entity FROM customer WHERE c_custkey % 50 = 0), seen0 AS (SELECT * FROM front0)"""


def _levels_sql(levels: int, per_level: int) -> str:
    steps = [LINKS_SQL]
    for k in range(levels):
        old = " UNION ALL ".join(f"SELECT query_id, fact_id FROM new{i}" for i in range(k)) or "SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS fact_id"
        steps.append(f"""new{k} AS (SELECT query_id, fact_id, {k} AS level, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS k FROM
  (SELECT query_id, fact_id, max(score) * {1 - 0.2 * k} AS score FROM front{k} JOIN links USING (entity) WHERE (query_id, fact_id) NOT IN (SELECT (query_id, fact_id) FROM ({old}) WHERE query_id IS NOT NULL) GROUP BY ALL) WHERE score >= 0.1) WHERE k <= {per_level})""")
        steps.append(f"front{k + 1} AS (SELECT DISTINCT query_id, entity FROM new{k} JOIN links USING (fact_id) WHERE (query_id, entity) NOT IN (SELECT (query_id, entity) FROM seen{k}))")
        steps.append(f"seen{k + 1} AS (SELECT * FROM seen{k} UNION ALL SELECT * FROM front{k + 1})")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT query_id, fact_id, level, round(score, 6) AS score FROM new{k}" for k in range(levels))


@query(_levels_sql(3, 10))
def facts_by_level(spark, d):
    """Ten facts a level for each asking customer: their own, those of what they bought, those of what is met there."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    ends = F.explode(F.array(node("c", F.col("o_custkey")), node("p", F.col("l_partkey")), node("s", F.col("l_suppkey")))).alias("entity")
    links = li.join(o, o.o_orderkey == li.l_orderkey).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.round(0.5 + F.col("l_discount") * 4, 4).alias("score"), ends)
    asked = read(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), node("c", F.col("c_custkey")).alias("entity"))
    return R.facts_by_level(asked, links, 3, 10).withColumn("score", F.round("score", 6))


@query()
def refined_contexts(spark, d):
    """How many rounds and documents each question takes until its keywords are covered."""
    questions = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.refine(questions, read(spark, d, "documents").select("doc_id", "text"), 0.9, 2, 5)


def _answers(spark, d):
    """Assistants' turns as answers, users' turns of the same conversation before them as facts."""
    c = read(spark, d, "conversations").where("text is not null")
    answers = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", F.col("text").alias("content"))
    told = c.where("role = 'user'").select("conv_id", F.col("turn").alias("fact_id"), "text")
    source = L.citation_text(F.lit("document"), F.concat(F.lit("conversation "), F.col("conv_id")), F.col("fact_id").cast("string"), F.lit(""))
    facts = answers.select("answer_id", "conv_id", "turn").join(told, "conv_id").where(F.col("fact_id") < F.col("turn"))
    facts = facts.select("answer_id", "fact_id", "text", (0.5 + F.col("fact_id") % 5 / 10).alias("score"), source.alias("source"))
    return answers.select("answer_id", "content"), facts


@query()
def cited_answers(spark, d):
    """Answers with citations in five styles."""
    spans = L.citation_spans(*_answers(spark, d))
    return spans.select("answer_id", F.size("spans").alias("n"), *[L.render(F.col("content"), F.col("spans"), s).alias(s) for s in L.STYLES], L.verification(F.col("spans")).alias("status"))


@query("""WITH f AS (SELECT o_orderkey AS fact_id, any_value(o_orderstatus) AS kind, any_value(o_totalprice) AS price, list_sort(list(DISTINCT 'part ' || l_partkey)) AS parts, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS ends FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
s AS (SELECT fact_id, least(1.0, 0.3 + price % 100 / 200 + CASE WHEN kind = 'O' THEN 0.1 ELSE 0 END + CASE WHEN kind <> 'P' THEN 0.05 ELSE 0 END) AS confidence, CASE kind WHEN 'O' THEN parts[:5] WHEN 'F' THEN list_transform(ends[:5], lambda e: 'entity_' || e) ELSE ['unknown'] END AS sources FROM f)
SELECT fact_id, len(sources)::INT AS n, array_to_string(sources, '|') AS sources, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN confidence >= 0.8 THEN 'verified' WHEN confidence >= 0.5 THEN 'partially_verified' END AS status FROM s""")
def fact_sources(spark, d):
    """The sources of each order as a fact: documents, without them entities, without both the graph."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    f = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_orderkey").alias("fact_id"))
    f = f.agg(F.first("o_orderstatus").alias("kind"), F.first("o_totalprice").alias("price"), F.array_sort(F.collect_set(F.concat(F.lit("part "), "l_partkey"))).alias("parts"), F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("ends"))
    none = F.array().cast("array<string>")
    sources = L.sources_of(F.when(F.col("kind") == "O", F.col("parts")).otherwise(none), F.when(F.col("kind") == "F", F.col("ends")).otherwise(none))
    known = L.source_confidence(0.3 + F.col("price") % 100 / 200, F.when(F.col("kind") == "O", "title"), F.lit(None), F.lit(""), F.when(F.col("kind") != "P", "url"))
    out = f.select("fact_id", sources.alias("s"), known.alias("c"))
    return out.select("fact_id", F.size("s").alias("n"), F.array_join("s", "|").alias("sources"), F.round("c", 6).alias("confidence"), L.source_status(F.col("s"), F.col("c")).alias("status"))


@query("""WITH RECURSIVE v AS (SELECT label, row_number() OVER w - 1 AS k, list_cosine_similarity(lag(embedding::DOUBLE[]) OVER w, embedding::DOUBLE[]) AS alike FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
n AS (SELECT label, count(*)::INT AS n, coalesce(list(k::INT ORDER BY k) FILTER (alike < 0.2), []) AS lows FROM v GROUP BY label),
r AS (SELECT label, 0 AS segment, 0 AS start FROM n UNION ALL SELECT label, segment + 1, list_min(list_filter(lows, lambda x: x - start >= 3)) FROM r JOIN n USING (label) WHERE segment < 19 AND len(list_filter(lows, lambda x: x - start >= 3)) > 0)
SELECT label AS text_id, segment, start, coalesce(lead(start) OVER (PARTITION BY label ORDER BY segment), n)::INT AS stop FROM r JOIN n USING (label)""")
def vector_topics(spark, d):
    """Topics of each label's vectors in order of id: they end where neighbours are unlike, after three vectors at least."""
    v = read(spark, d, "embeddings").select(F.col("label").alias("text_id"), F.col("vec_id").alias("place"), "embedding")
    return C.topic_bounds(v, 0.2)


@query("""WITH c AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
SELECT * FROM (VALUES ('documents', (SELECT count(*) FROM documents WHERE text IS NOT NULL)), ('chunks', (SELECT count(*) FROM c)), ('entities', (SELECT count(*) FROM supplier)), ('facts', (SELECT count(*) FROM c)),
('relations', (SELECT count(*) FROM c JOIN supplier ON s_suppkey = doc_id + 1 WHERE i = 0)), ('errors', 1)) t(name, n)""")
def published_store(spark, d):
    """Rows of each table after a batch of documents is published twice, and a batch with a loose reference is turned away."""
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    chunk = F.concat(F.lit("doc_"), "doc_id", F.lit(":chunk:"), "i")
    suppliers = read(spark, d, "supplier").select("s_suppkey")
    tables = {
        "documents": docs.select(F.concat(F.lit("doc_"), "doc_id").alias("id")),
        "chunks": lines.select(chunk.alias("id"), F.concat(F.lit("doc_"), "doc_id").alias("document_id"), "text"),
        "entities": suppliers.select(F.concat(F.lit("ent_"), "s_suppkey").alias("id")),
        "facts": lines.select(F.concat(F.lit("fact_"), chunk).alias("id"), chunk.alias("chunk_id")),
        "relations": lines.where("i = 0").join(suppliers, F.col("s_suppkey") == F.col("doc_id") + 1).select(F.concat(F.lit("fact_"), chunk).alias("src"), F.concat(F.lit("ent_"), "s_suppkey").alias("dst")),
    }
    wrong = S.publish(spark, at, "first", tables) + S.publish(spark, at, "first", tables)
    loose = {"facts": spark.createDataFrame([("fact_x", "doc_none:chunk:0")], "id string, chunk_id string")}
    wrong += S.publish(spark, at, "second", loose)
    counts = [S.stored(spark, at, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in tables]
    out = spark.range(1).select(F.lit("errors").alias("name"), F.lit(len(wrong)).cast("long").alias("n"))
    for c in counts:
        out = out.unionByName(c)
    return out


_OF = lambda table: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"
DIMENSIONS_SQL = f"""r AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, 'Part ' || p_name || ' was sold new to a customer' AS content, ['DIRECT', 'CONTEXTUAL', 'CHAIN', 'INFERRED', 'TEMPORAL'][1 + l_suppkey % 5] AS kind,
  0.3 + l_discount * 4 AS given, 1 + p_size % 4 AS n_documents, p_size % 6 AS path_length, p_type AS source_type, CASE l_returnflag WHEN 'A' THEN 'CONCEPT' WHEN 'R' THEN 'Unknown' END AS target_type, l_linestatus = 'O' AS told,
  CASE WHEN l_returnflag = 'N' THEN 'enhanced rules' ELSE 'LLM' END AS method, l_quantity * 20000 AS age, 'What part was sold with ' || split_part(p_name, ' ', 1) AS query FROM lineitem JOIN part ON p_partkey = l_partkey),
w AS (SELECT *, list_distinct(string_split_regex(lower(content), '\\s+')) AS cw, list_distinct(string_split_regex(lower(query), '\\s+')) AS qw FROM r),
x AS (SELECT fact_id, kind, len(list_intersect(cw, qw)) / len(qw) AS d1,
  least(1.0, 0.5 + CASE WHEN n_documents > 1 THEN least(0.3, 0.1 * (n_documents - 1)) ELSE 0 END + {_OF(FS.OF_SOURCE)} + CASE WHEN target_type = 'CONCEPT' THEN 0.05 ELSE 0 END
    - CASE WHEN kind = 'CHAIN' AND path_length > 3 THEN least(0.2, (path_length - 3) * 0.05) ELSE 0 END + CASE WHEN method = 'LLM' THEN 0.05 ELSE 0.1 END + 0.1) AS d2,
  least(1.0, greatest(0.0, given + CASE WHEN told THEN 0.05 ELSE 0 END + CASE WHEN target_type = 'CONCEPT' THEN 0.1 ELSE 0 END + {_OF(FS.OF_CONFIDENCE)} + CASE WHEN n_documents > 1 THEN least(0.15, n_documents * 0.03) ELSE 0 END
    + CASE WHEN age < 3600 THEN 0.05 ELSE 0 END + CASE WHEN method <> 'LLM' THEN 0.1 ELSE 0 END)) AS d3,
  least(1.0, 0.7 + CASE WHEN age < 3600 THEN 0.3 WHEN age < 86400 THEN 0.2 WHEN age < 604800 THEN 0.1 ELSE 0 END + CASE WHEN kind = 'TEMPORAL' THEN 0.2 ELSE 0 END) AS d4,
  0.6 + CASE WHEN told THEN 0.2 ELSE 0 END + CASE WHEN path_length > 0 THEN 0.2 ELSE 0 END AS d5, least(1.0, len(string_split_regex(content, '\\s+')) / (2 * len(string_split_regex(query, '\\s+')))) AS d6 FROM w)"""


@query(f"""WITH {DIMENSIONS_SQL} SELECT fact_id, round(d1, 6)::DOUBLE AS relevance, round(d2, 6)::DOUBLE AS source, round(d3, 6)::DOUBLE AS confidence, round(d4, 6)::DOUBLE AS recency, round(d5, 6)::DOUBLE AS completeness, round(d6, 6)::DOUBLE AS specificity,
  round(least(1.0, 0.4 * d1 + 0.2 * d2 + 0.3 * d3 + 0.05 * d4 + 0.03 * d5 + 0.02 * d6), 6)::DOUBLE AS score FROM x""")
def fact_score_dimensions(spark, d):
    """All six dimensions of each sale as a fact, weighed for a question of facts."""
    li, p = read(spark, d, "lineitem"), read(spark, d, "part")
    kinds = F.array(*map(F.lit, FS.OF_SOURCE))
    rows = li.join(p, li.l_partkey == p.p_partkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.concat(F.lit("Part "), "p_name", F.lit(" was sold new to a customer")).alias("content"), F.get(kinds, (F.col("l_suppkey") % 5).cast("int")).alias("kind"),
        (0.3 + F.col("l_discount") * 4).alias("confidence"), (1 + F.col("p_size") % 4).alias("n_documents"), F.lit(1).alias("n_entities"), (F.col("p_size") % 6).alias("path_length"), F.col("p_type").alias("source_type"),
        F.when(F.col("l_returnflag") == "A", "CONCEPT").when(F.col("l_returnflag") == "R", "Unknown").alias("target_type"), (F.col("l_linestatus") == "O").alias("semantic_context"), F.lit(False).alias("temporal_context"),
        (F.col("l_linestatus") == "O").alias("has_context"), F.lit(True).alias("has_metadata"), (F.col("p_size") % 6 > 0).alias("has_path"), F.when(F.col("l_returnflag") == "N", "enhanced rules").otherwise("LLM").alias("method"),
        (F.col("l_quantity") * 20000).alias("age"), F.concat(F.lit("What part was sold with "), F.substring_index("p_name", " ", 1)).alias("query"),
    )
    out = FS.score(rows, F.col("query"))
    return out.select("fact_id", *[F.round(c, 6).alias(c) for c in (*FS.DIMENSIONS, "score")])
