"""Queries over facts: turns of conversations as statements, parts and lines as extracted facts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowmill.functions import text as T
from knowmill.operators import dedup, facts
from knowmill.plans.registry import query
from knowmill.plans.text_queries import STOP_SQL, TOKEN_SQL
from knowmill.sources.tables import read

#: Statements: kind, domain and confidence follow from the turn's numbers.
FACTS_SQL = """facts AS (SELECT conv_id * 1000 + turn AS fact_id, conv_id AS document_id, turn AS position, coalesce(text, '') AS text,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'statistical' WHEN 1 THEN 'definition' WHEN 2 THEN 'causal' ELSE 'opinion' END AS fact_type,
  CASE conv_id % 3 WHEN 0 THEN 'medical' WHEN 1 THEN 'technical' ELSE 'general' END AS domain,
  round(0.2 + (conv_id * 7 + turn * 13) % 80 / 100, 4) AS confidence FROM conversations)"""


def statements(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    kind = F.when((c + t) % 4 == 0, "statistical").when((c + t) % 4 == 1, "definition").when((c + t) % 4 == 2, "causal").otherwise("opinion")
    domain = F.when(c % 3 == 0, "medical").when(c % 3 == 1, "technical").otherwise("general")
    return read(spark, d, "conversations").select(
        (c * 1000 + t).alias("fact_id"), c.alias("document_id"), t.alias("position"), F.coalesce("text", F.lit("")).alias("text"),
        kind.alias("fact_type"), domain.alias("domain"), F.round(0.2 + (c * 7 + t * 13) % 80 / 100, 4).alias("confidence"),
    )


@query(f"""WITH {FACTS_SQL} SELECT fact_id, confidence, position FROM facts WHERE confidence >= 0.5 AND fact_type = 'definition' AND contains(lower(text), 'the')
ORDER BY confidence DESC, position DESC, fact_id LIMIT 25""")
def fact_search(spark, d):
    return facts.search(statements(spark, d), "the", "definition", None, 0.5, 25).select("fact_id", "confidence", "position")


@query(f"""WITH {FACTS_SQL} SELECT document_id, domain, fact_id, row_number() OVER (PARTITION BY document_id, domain ORDER BY confidence DESC, fact_id)::INT AS place FROM facts""")
def facts_by_document(spark, d):
    w = Window.partitionBy("document_id", "domain").orderBy(F.desc("confidence"), "fact_id")
    return statements(spark, d).select("document_id", "domain", "fact_id", F.row_number().over(w).alias("place"))


RULES = [("medical", ["worthless"], ["the", "of"], 1.2, 0.5), ("technical", [], ["and"], 0.9, 0.4)]
RULES_SQL = """rules AS (SELECT 'medical' AS domain, ['worthless'] AS excluded, ['the', 'of'] AS required, 1.2 AS factor, 0.5 AS least
  UNION ALL SELECT 'technical', [], ['and'], 0.9, 0.4),
kept AS (SELECT f.*, least(1.0, confidence * coalesce(factor, 1.0)) AS adjusted FROM facts f LEFT JOIN rules r USING (domain)
  WHERE factor IS NULL OR (len([w FOR w IN excluded IF contains(lower(text), w)]) = 0 AND (len(required) = 0 OR len([w FOR w IN required IF contains(lower(text), w)]) > 0)
    AND least(1.0, confidence * factor) >= least))"""


def _filtered(spark, d):
    rules = spark.createDataFrame(RULES, "domain string, excluded array<string>, required array<string>, factor double, least double")
    return facts.domain_filter(statements(spark, d), rules)


@query(f"WITH {FACTS_SQL}, {RULES_SQL} SELECT fact_id, domain, round(adjusted, 6) AS adjusted FROM kept")
def domain_fact_filter(spark, d):
    return _filtered(spark, d).select("fact_id", "domain", F.round("adjusted", 6).alias("adjusted"))


@query(f"""WITH {FACTS_SQL}, {RULES_SQL} SELECT f.domain, count(*) AS original, count(k.fact_id) AS kept, count(*) - count(k.fact_id) AS dropped, round(count(k.fact_id) / count(*), 6) AS retention
FROM facts f LEFT JOIN kept k USING (fact_id) GROUP BY f.domain""")
def fact_filter_statistics(spark, d):
    kept = _filtered(spark, d).select("fact_id", F.lit(1).alias("k"))
    n = statements(spark, d).join(kept, "fact_id", "left").groupBy("domain").agg(F.count("*").alias("original"), F.count("k").alias("kept"))
    return n.select("domain", "original", "kept", (F.col("original") - F.col("kept")).alias("dropped"), F.round(F.col("kept") / F.col("original"), 6).alias("retention"))


VAGUE_SQL = "regexp_matches(lower(text), '" + "|".join(facts.VAGUE) + "')"
META_SQL = "regexp_matches(lower(text), '" + "|".join(facts.META) + "')"
CHECKED_SQL = f"""checked AS (SELECT *, CASE WHEN {VAGUE_SQL} THEN greatest(0.3, confidence - 0.2) ELSE confidence END AS after FROM facts),
judged AS (SELECT *, list_filter([CASE WHEN trim(text) = '' THEN 'empty: no text' END, CASE WHEN length(text) < 20 THEN 'brief: too short' END,
  CASE WHEN after < 0.3 THEN 'confidence: below threshold' END, CASE WHEN {META_SQL} THEN 'meta: about the document' END,
  CASE WHEN fact_type NOT IN ({", ".join(f"'{x}'" for x in facts.FACT_TYPES)}) THEN 'type: unknown' END], lambda x: x IS NOT NULL) AS found FROM checked)"""


def _judged(spark, d):
    found, after = facts.issues(F.col("text"), F.col("fact_type"), F.col("confidence"))
    return statements(spark, d).select("*", found.alias("found"), after.alias("after"))


@query(f"WITH {FACTS_SQL}, {CHECKED_SQL} SELECT fact_id, array_to_string(found, '; ') AS issues, len(found) = 0 AS valid, round(after, 6) AS confidence FROM judged")
def fact_validation(spark, d):
    return _judged(spark, d).select("fact_id", F.array_join("found", "; ").alias("issues"), (F.size("found") == 0).alias("valid"), F.round("after", 6).alias("confidence"))


@query(f"""WITH {FACTS_SQL}, {CHECKED_SQL}, k AS (SELECT split_part(unnest(found), ':', 1) AS issue FROM judged) SELECT issue, count(*) AS n, round(count(*) / (SELECT count(*) FROM facts), 6) AS share FROM k GROUP BY issue
ORDER BY n DESC, issue LIMIT 5""")
def fact_validation_report(spark, d):
    total = statements(spark, d).agg(F.count("*").alias("all"))
    n = _judged(spark, d).select(F.explode("found").alias("i")).groupBy(F.split("i", ":")[0].alias("issue")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("issue", "n", F.round(F.col("n") / F.col("all"), 6).alias("share")).orderBy(F.desc("n"), "issue").limit(5)


@query(f"""WITH {FACTS_SQL}, {CHECKED_SQL} SELECT fact_id, round(CASE WHEN len(found) = 0 THEN least(1.0, after + 0.05 * ((text <> '')::INT + (domain <> 'general')::INT))
ELSE greatest(0.0, after - least(0.8, 0.2 * len(found))) END, 6) AS score FROM judged""")
def fact_quality(spark, d):
    filled = (F.col("text") != "").cast("int") + (F.col("domain") != "general").cast("int")
    return _judged(spark, d).select("fact_id", F.round(facts.quality(F.col("found"), F.col("after"), filled), 6).alias("score"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, length(text) < 20 OR {VAGUE_SQL} AS unspecific FROM facts")
def strict_specificity(spark, d):
    """The stricter test: vague words or fewer than 20 characters."""
    low = F.lower("text")
    return statements(spark, d).select("fact_id", ((F.length("text") < 20) | low.rlike("|".join(facts.VAGUE))).alias("unspecific"))


@query(f"WITH {FACTS_SQL} SELECT document_id, count(*) AS deleted FROM facts WHERE confidence < 0.4 GROUP BY document_id")
def low_quality_facts(spark, d):
    """What a clean-up of facts below 0.4 deletes."""
    return statements(spark, d).where("confidence < 0.4").groupBy("document_id").agg(F.count("*").alias("deleted"))


@query(f"""WITH {FACTS_SQL} SELECT domain, count(DISTINCT fact_id) AS n_facts, string_agg(DISTINCT fact_type, ',' ORDER BY fact_type) AS types, round(avg(confidence), 6) AS mean_confidence,
min(confidence) AS least, max(confidence) AS most FROM facts GROUP BY domain""")
def fact_statistics(spark, d):
    g = statements(spark, d).groupBy("domain")
    return g.agg(
        F.count_distinct("fact_id").alias("n_facts"), F.array_join(F.array_sort(F.collect_set("fact_type")), ",").alias("types"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.min("confidence").alias("least"), F.max("confidence").alias("most"),
    )


@query(f"""WITH {FACTS_SQL}, w AS (SELECT fact_id, [x FOR x IN regexp_extract_all(lower(text), '[a-z]+') IF length(x) >= 4 AND x NOT IN {STOP_SQL}] AS w FROM facts)
SELECT fact_id, array_to_string([x FOR x, i IN w IF list_position(w, x) = i][1:10], ' ') AS keywords FROM w""")
def fact_keywords(spark, d):
    return statements(spark, d).select("fact_id", F.array_join(facts.keywords(F.col("text")), " ").alias("keywords"))


@query(f"""WITH {FACTS_SQL} SELECT document_id, round(avg(confidence), 6) AS confidence, round(least(1.0, avg(confidence) * count(*) / 10), 6) AS answer_confidence,
round(least(1.0, (count(*) / count(DISTINCT fact_type) + count(*) / count(DISTINCT position)) / 2), 6) AS completeness FROM facts GROUP BY document_id""")
def answer_confidence(spark, d):
    """Mean confidence, the confidence of an answer from so many facts, and completeness by entities and chunks."""
    n = F.count("*")
    return statements(spark, d).groupBy("document_id").agg(
        F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.least(F.lit(1.0), F.avg("confidence") * n / 10), 6).alias("answer_confidence"),
        F.round(F.least(F.lit(1.0), (n / F.count_distinct("fact_type") + n / F.count_distinct("position")) / 2), 6).alias("completeness"),
    )


#: A turn by the assistant is scored as a fact for the user's turn before it.
ASKED_SQL = f"""asked AS (SELECT *, lag(text) OVER (PARTITION BY document_id ORDER BY position) AS question FROM facts),
scored AS (SELECT *, CASE WHEN regexp_matches(lower(question), 'what|who|when|where') THEN 'factual' WHEN regexp_matches(lower(question), 'recent|latest|current|now') THEN 'recent'
    WHEN regexp_matches(lower(question), 'analyze|explain|why|how') THEN 'analytical' ELSE 'balanced' END AS kind,
  list_distinct({TOKEN_SQL.format("text")}) AS a, list_distinct({TOKEN_SQL.format("question")}) AS b FROM asked WHERE question IS NOT NULL),
dims AS (SELECT *, CASE WHEN len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(b) END AS d1, CASE fact_type WHEN 'opinion' THEN 0.6 ELSE 0.8 END AS d2, confidence AS d3,
  CASE WHEN regexp_matches(lower(text), 'recent|latest|current|new|today') THEN 0.7 ELSE 0.5 END AS d4, least(1.0, len(a) / 20) AS d5, least(1.0, length(text) / 200) AS d6 FROM scored),
total AS (SELECT *, least(1.0, CASE kind {" ".join(f"WHEN '{k}' THEN " + " + ".join(f"{w} * d{i}" for i, w in enumerate(v, 1)) for k, v in facts.WEIGHTS.items())} END) AS score FROM dims)"""


def _scored(spark, d):
    w = Window.partitionBy("document_id").orderBy("position")
    f = statements(spark, d).withColumn("question", F.lag("text").over(w)).where("question is not null")
    text = F.col("text")
    dims = {
        "d1": facts.keyword_relevance(text, F.col("question")), "d2": F.when(F.col("fact_type") == "opinion", 0.6).otherwise(0.8), "d3": F.col("confidence"),
        "d4": F.when(F.lower(text).rlike("recent|latest|current|new|today"), 0.7).otherwise(0.5), "d5": F.least(F.lit(1.0), F.size(F.array_distinct(T.tokens(text))) / 20),
        "d6": F.least(F.lit(1.0), F.length(text) / 200),
    }
    f = f.withColumns(dims | {"kind": facts.strategy(F.col("question"))})
    return f.withColumn("score", facts.weighted([F.col(x) for x in dims], F.col("kind")))


@query(f"WITH {FACTS_SQL}, {ASKED_SQL} SELECT fact_id, kind AS strategy, round(d1, 6) AS relevance, round(score, 6) AS score FROM total WHERE score >= 0.2")
def fact_scores(spark, d):
    """Six dimensions weighed by the strategy that the query's words choose; scores below 0.2 are dropped."""
    return _scored(spark, d).where("score >= 0.2").select("fact_id", F.col("kind").alias("strategy"), F.round("d1", 6).alias("relevance"), F.round("score", 6).alias("score"))


@query(f"""WITH {FACTS_SQL}, {ASKED_SQL} SELECT fact_id, array_to_string(list_filter([CASE WHEN d1 > 0.7 THEN 'High relevance' WHEN d1 > 0.4 THEN 'Moderate relevance' END,
CASE WHEN d2 > 0.7 THEN 'High source' WHEN d2 > 0.4 THEN 'Moderate source' END, CASE WHEN d3 > 0.7 THEN 'High confidence' WHEN d3 > 0.4 THEN 'Moderate confidence' END], lambda x: x IS NOT NULL), '; ') AS reason FROM total""")
def fact_score_reasons(spark, d):
    bands = [facts.banded(n, F.col(c)) for n, c in (("relevance", "d1"), ("source", "d2"), ("confidence", "d3"))]
    return _scored(spark, d).select("fact_id", F.array_join(F.array_compact(F.array(*bands)), "; ").alias("reason"))


@query(f"""WITH {FACTS_SQL}, {ASKED_SQL} SELECT document_id, fact_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY round(d1, 6) DESC, confidence DESC, fact_id) AS rank FROM total
WHERE confidence >= 0.3) WHERE rank <= 3""")
def fact_extraction_ranking(spark, d):
    w = Window.partitionBy("document_id").orderBy(F.desc(F.round("d1", 6)), F.desc("confidence"), "fact_id")
    return _scored(spark, d).where("confidence >= 0.3").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("document_id", "fact_id", "rank")


@query(f"""WITH {FACTS_SQL}, known AS (SELECT fact_id FROM facts WHERE position < 2) SELECT f.document_id, count(k.fact_id) AS existing, count(*) - count(k.fact_id) AS new FROM facts f LEFT JOIN known k USING (fact_id) GROUP BY f.document_id""")
def known_and_new_facts(spark, d):
    """How many facts of a document are stored already."""
    f = statements(spark, d)
    known = f.where("position < 2").select("fact_id")
    have = f.join(known, "fact_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("existing"))
    new = f.join(known, "fact_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("new"))
    return have.join(new, "document_id", "full").na.fill(0, ["existing", "new"])


@query(f"""WITH {FACTS_SQL}, ids AS (SELECT substr(md5(text), 1, 3) AS id, fact_id FROM facts) SELECT id, count(*) AS n, min(fact_id) AS first_fact FROM ids GROUP BY id HAVING count(*) > 1""")
def id_collisions(spark, d):
    """Short ids that several facts share."""
    ids = statements(spark, d).groupBy(F.substring(F.md5("text"), 1, 3).alias("id")).agg(F.count("*").alias("n"), F.min("fact_id").alias("first_fact"))
    return ids.where("n > 1")


@query(f"""WITH {FACTS_SQL}, e AS (SELECT fact_id, confidence, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'))) AS name FROM facts)
SELECT lower(name) AS key, min(name) AS name, count(DISTINCT fact_id) AS n_facts, min(fact_id) AS first_fact, round(max(confidence) * 0.8, 6) AS confidence FROM e GROUP BY lower(name)""")
def fact_entities(spark, d):
    """Entities named in facts, one for each name regardless of case, less confident than their facts."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1)))
    e = statements(spark, d).select("fact_id", "confidence", F.explode(names).alias("name"))
    return e.groupBy(F.lower("name").alias("key")).agg(
        F.min("name").alias("name"), F.count_distinct("fact_id").alias("n_facts"), F.min("fact_id").alias("first_fact"), F.round(F.max("confidence") * 0.8, 6).alias("confidence")
    )


@query(f"""WITH {FACTS_SQL}, e AS (SELECT fact_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) AS n FROM facts)
SELECT fact_id, 'MENTIONED_IN' AS kind, lower(unnest(n)) AS src, fact_id::VARCHAR AS dst FROM e UNION ALL
SELECT fact_id, 'TAGGED_IN', domain, fact_id::VARCHAR FROM facts""")
def fact_to_entity_edges(spark, d):
    """Edges from the entities and the domain of a fact to the fact."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1)))
    f, to = statements(spark, d), F.col("fact_id").cast("string").alias("dst")
    said = f.select("fact_id", to, F.explode(names).alias("name")).select("fact_id", F.lit("MENTIONED_IN").alias("kind"), F.lower("name").alias("src"), "dst")
    return said.union(f.select("fact_id", F.lit("TAGGED_IN"), "domain", to))


@query(f"""WITH {FACTS_SQL}, b AS (SELECT fact_id, text, confidence, 0 AS ord FROM facts WHERE position % 2 = 0 UNION ALL SELECT fact_id, text || '!', least(1.0, confidence + 0.1), 1 FROM facts WHERE position % 3 = 0)
SELECT fact_id, md5(text) AS digest, confidence FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY ord DESC) AS rn FROM b) WHERE rn = 1""")
def fact_upsert(spark, d):
    """Stored and new facts merged by id, the last write winning."""
    f = statements(spark, d).select("fact_id", "text", "confidence", "position")
    old = f.where("position % 2 = 0").select("fact_id", "text", "confidence", F.lit(0).alias("ord"))
    new = f.where("position % 3 = 0").select("fact_id", F.concat("text", F.lit("!")), F.least(F.lit(1.0), F.col("confidence") + 0.1), F.lit(1))
    return dedup.best_per_key(old.union(new), [F.col("fact_id")], [F.desc("ord")]).select("fact_id", F.md5("text").alias("digest"), "confidence")


@query(f"""WITH {FACTS_SQL}, g AS (SELECT fact_id, md5(lower(trim(text))) AS key, 0 AS prio FROM facts WHERE position % 2 = 0), v AS (SELECT fact_id, md5(lower(trim(text))), 1 FROM facts WHERE confidence >= 0.5)
SELECT fact_id, key, CASE prio WHEN 0 THEN 'graph' ELSE 'vector' END AS found_by FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY prio) AS rn FROM (SELECT * FROM g UNION ALL SELECT * FROM v)) WHERE rn = 1""")
def graph_and_vector_facts(spark, d):
    """Facts of two legs, the graph's first, one for each source."""
    f = statements(spark, d).select("fact_id", F.md5(F.lower(F.trim("text"))).alias("key"), "position", "confidence")
    both = f.where("position % 2 = 0").select("fact_id", "key", F.lit(0).alias("prio")).union(f.where("confidence >= 0.5").select("fact_id", "key", F.lit(1)))
    best = dedup.best_per_key(both, [F.col("fact_id")], [F.col("prio")])
    return best.select("fact_id", "key", F.when(F.col("prio") == 0, "graph").otherwise("vector").alias("found_by"))
