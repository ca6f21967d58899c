"""Rules on names, texts, questions and answers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowmill.functions import lexical as X
from knowmill.functions import text as T
from knowmill.plans.registry import query
from knowmill.plans.text_queries import TOKEN_SQL
from knowmill.sources.tables import read


@query("""WITH f AS (SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/\\\\]*)$', 1) AS base, substr(sha256(html), 1, 12) AS sum FROM pages)
SELECT page_id, 'doc_' || regexp_replace(regexp_replace(regexp_replace(base, '[^\\p{L}\\p{N}_.\\-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') || '_' || sum AS document_id FROM f""")
def document_ids(spark, d):
    file = F.substring_index("url", "?", 1)
    return read(spark, d, "pages").select("page_id", X.document_id(file, F.substring(F.sha2("html", 256), 1, 12)).alias("document_id"))


@query("""WITH i AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'doc_' || conv_id WHEN 1 THEN 'ent_x_' || conv_id WHEN 2 THEN 'rel_y' WHEN 3 THEN 'conv:1:chunk:' || turn ELSE 'x' || conv_id END AS id FROM conversations)
SELECT CASE WHEN contains(id, ':chunk:') THEN 'chunk' WHEN id LIKE 'doc\\_%' ESCAPE '\\' THEN 'document' WHEN id LIKE 'ent\\_%' ESCAPE '\\' THEN 'entity' WHEN id LIKE 'rel\\_%' ESCAPE '\\' THEN 'relation' ELSE 'unknown' END AS kind, count(*) AS n FROM i GROUP BY kind""")
def id_types(spark, d):
    t, c = F.col("turn") % 5, F.col("conv_id").cast("string")
    ident = F.when(t == 0, F.concat(F.lit("doc_"), c)).when(t == 1, F.concat(F.lit("ent_x_"), c)).when(t == 2, "rel_y").when(t == 3, F.concat(F.lit("conv:1:chunk:"), "turn")).otherwise(F.concat(F.lit("x"), c))
    return read(spark, d, "conversations").groupBy(X.id_type(ident).alias("kind")).agg(F.count("*").alias("n"))


BARE_SQL = "trim(regexp_replace(regexp_replace(lower(raw), '[ \\t]*\\([^)]*\\)', '', 'g'), '^(the|a|an|der|die|das|le|la|les|el|los|las) ', ''))"


@query(f"""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'The ' || p_name || 's (old)' WHEN 1 THEN p_name || ' boxes' ELSE 'die ' || p_name || ' batteries' END AS raw FROM part), b AS (SELECT p_partkey, raw, {BARE_SQL} AS b FROM n),
s AS (SELECT *, CASE WHEN regexp_matches(b, 'ies$') THEN regexp_replace(b, 'ies$', 'y') WHEN regexp_matches(b, '(s|x|ch|sh)es$') THEN regexp_replace(b, 'es$', '') WHEN regexp_matches(b, '[^su]s$') THEN regexp_replace(b, 's$', '') ELSE b END AS s FROM b)
SELECT p_partkey, array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(s, ' ')], ' ') AS name, lower(replace(raw, '_', ' ')) AS keyword FROM s""")
def normalised_names(spark, d):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit("The "), name, F.lit("s (old)"))).when(k == 1, F.concat(name, F.lit(" boxes"))).otherwise(F.concat(F.lit("die "), name, F.lit(" batteries")))
    return read(spark, d, "part").select("p_partkey", X.singular_name(raw).alias("name"), X.keyword_name(raw).alias("keyword"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '#+ ', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '`([^`]+)`', '\\1', 'g'), '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')) AS plain,
md5(trim(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '([a-z,])\\n([a-z])', '\\1 \\2', 'g'))) AS clean FROM documents WHERE text IS NOT NULL""")
def cleaned_texts(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.plain_chunk(t)).alias("plain"), F.md5(X.cleaned_markdown(t)).alias("clean"))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '[' || lpad((turn % 60)::VARCHAR, 2, '0') || ':' || lpad((conv_id % 60)::VARCHAR, 2, '0') || '] ' WHEN 1 THEN '[01:0' || turn % 10 || ':30] ' ELSE '' END || coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN turn % 60 * 60 + conv_id % 60 WHEN 1 THEN 3600 + turn % 10 * 60 + 30 END::INT AS seconds, CASE WHEN length(trim(regexp_replace(split_part(t, chr(10), 1), '\\[[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\\]', '', 'g'))) BETWEEN 1 AND 99
THEN trim(regexp_replace(split_part(t, chr(10), 1), '\\[[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\\]', '', 'g')) END AS title FROM t""")
def time_stamps(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = F.col("turn") % 3
    stamp = F.when(k == 0, F.concat(F.lit("["), two(F.col("turn") % 60), F.lit(":"), two(F.col("conv_id") % 60), F.lit("] "))).when(k == 1, F.concat(F.lit("[01:0"), F.col("turn") % 10, F.lit(":30] "))).otherwise("")
    t = F.concat(stamp, F.coalesce("text", F.lit("")))
    return read(spark, d, "conversations").select("conv_id", "turn", X.seconds(t).alias("seconds"), X.section_title(t).alias("title"))


DOMAIN_SQL = ", ".join(f"{' + '.join(f'contains(low, {chr(39)}{w}{chr(39)})::INT' for w in words)} AS {k}" for k, words in X.DOMAIN_WORDS.items())
DOMAIN_PICK_SQL = " ".join(f"WHEN {k} = most THEN '{k}'" for k in X.DOMAIN_WORDS)


@query(f"""WITH l AS (SELECT page_id, lower(html) AS low FROM pages), h AS (SELECT page_id, {DOMAIN_SQL} FROM l), m AS (SELECT *, greatest({", ".join(X.DOMAIN_WORDS)}) AS most FROM h)
SELECT page_id, CASE WHEN most < 1 THEN 'general' {DOMAIN_PICK_SQL} END AS domain FROM m""")
def domain_inference(spark, d):
    return read(spark, d, "pages").select("page_id", X.domain(F.col("html"), 1).alias("domain"))


INTENT_SQL = ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN least(1.0, 0.8 + CASE WHEN contains(low, '?') THEN 0.1 ELSE 0 END) ELSE 0 END::DOUBLE AS {k}" for k, p in X.INTENTS.items())


@query(f"""WITH l AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, {INTENT_SQL} FROM l), g AS (SELECT *, CASE WHEN greatest({", ".join(X.INTENTS)}) < 0.3 THEN 0.5 ELSE 0 END::DOUBLE AS general FROM s),
u AS (UNPIVOT g ON {", ".join(X.INTENTS)}, general INTO NAME intent VALUE score) SELECT doc_id, intent, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, intent DESC) AS rn FROM u) WHERE rn = 1""")
def intent_ranking(spark, d):
    """The intent of the highest score, the last in order among equals."""
    best = F.array_max(F.transform(F.map_entries(X.intent_scores(F.col("text"))), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("intent"))))
    out = read(spark, d, "documents").where("text is not null").select("doc_id", best.alias("b"))
    return out.select("doc_id", F.col("b.intent").alias("intent"), F.round("b.score", 6).alias("score"))


@query(f"""WITH q AS (SELECT item_id, {TOKEN_SQL.format("text")} AS w, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{2,}}')) AS names FROM benchmark)
SELECT item_id, len(w) AS words, len(names) AS entities, CASE WHEN len(names) = 0 THEN 'general' WHEN len(names) = 1 THEN 'single_entity' WHEN len(names) = 2 THEN 'entity_pair' ELSE 'multi_entity' END AS query_type,
round((least(1.0, len(w) / 20) + least(1.0, len(names) / 5) + 0.0) / 3, 6) AS complexity FROM q""")
def query_analysis(spark, d):
    """Type and complexity of questions from their words and names."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1)))
    q = read(spark, d, "benchmark").select("item_id", F.size(T.tokens(F.col("text"))).cast("long").alias("words"), F.size(names).cast("long").alias("entities"))
    n = F.col("entities")
    kind = F.when(n == 0, "general").when(n == 1, "single_entity").when(n == 2, "entity_pair").otherwise("multi_entity")
    return q.select("item_id", "words", "entities", kind.alias("query_type"), F.round((F.least(F.lit(1.0), F.col("words") / 20) + F.least(F.lit(1.0), n / 5)) / 3, 6).alias("complexity"))


@query("""SELECT item_id, length(text) BETWEEN 3 AND 1000 AND NOT regexp_matches(lower(text), '<script|drop table|javascript:') AS valid, list_filter([CASE WHEN length(text) < 3 THEN 'too short' END, CASE WHEN length(text) > 1000 THEN 'too long' END,
CASE WHEN regexp_matches(lower(text), '<script|drop table|javascript:') THEN 'forbidden' END, CASE WHEN NOT contains(text, '?') THEN 'no question mark' END], lambda x: x IS NOT NULL)::VARCHAR AS remarks FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -page_id - 1, html FROM pages)""")
def query_validation(spark, d):
    """Which texts may be asked as questions."""
    t = read(spark, d, "benchmark").select("item_id", "text").union(read(spark, d, "pages").select(-F.col("page_id") - 1, "html"))
    bad, n = F.lower("text").rlike("<script|drop table|javascript:"), F.length("text")
    remarks = F.array_compact(F.array(F.when(n < 3, "too short"), F.when(n > 1000, "too long"), F.when(bad, "forbidden"), F.when(~F.col("text").contains("?"), "no question mark")))
    shown = F.concat(F.lit("["), F.array_join(F.transform(remarks, lambda x: F.when(x.contains(" "), F.concat(F.lit("'"), x, F.lit("'"))).otherwise(x)), ", "), F.lit("]"))
    return t.select("item_id", (n.between(3, 1000) & ~bad).alias("valid"), F.regexp_replace(shown, "'", "").alias("remarks"))


@query("""SELECT p_partkey, 'Subject: ' || p_name || '. Relation: MADE_BY. Object: ' || p_brand || CASE WHEN p_size > 25 THEN '. Remark: large' ELSE '' END AS text, '[part:' || p_name || ':' || p_partkey || ':size=' || p_size || CASE WHEN p_size > 25 THEN ':note=large' ELSE '' END || ']' AS citation FROM part""")
def fact_texts(spark, d):
    note = F.when(F.col("p_size") > 25, "large")
    return read(spark, d, "part").select(
        "p_partkey", X.fact_text(F.col("p_name"), F.lit("MADE_BY"), F.col("p_brand"), note).alias("text"),
        X.citation(F.lit("part"), F.col("p_name"), F.col("p_partkey").cast("string"), size=F.col("p_size").cast("string"), note=note).alias("citation"),
    )


@query("""SELECT event_type, count(*) AS n, sum((props->>'k')::INT)::BIGINT AS total FROM events GROUP BY event_type""")
def model_answers(spark, d):
    """Objects read from answers with fences, remarks and trailing commas around them."""
    broken = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", "}", ",}"), F.lit("\n```"))
    k = F.get_json_object(X.json_object(broken), "$.k").cast("int")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations), x AS (SELECT *, {TOKEN_SQL.format("text")} AS w, {TOKEN_SQL.format("q")} AS v,
  greatest(1, len([s FOR s IN string_split_regex(text, '[.!?]+') IF trim(s, chr(32) || chr(10)) <> ''])) AS n FROM t WHERE role = 'assistant' AND q IS NOT NULL),
m AS (SELECT conv_id, turn, least(1.0, len(w) / greatest(1, len(v) * 10)) AS completeness, CASE WHEN len(v) = 0 THEN 0 ELSE len(list_intersect(list_distinct(w), list_distinct(v))) / len(list_distinct(v)) END AS relevance,
  CASE WHEN n >= 3 THEN 0.8 WHEN n = 2 THEN 0.6 ELSE 0.4 END::DOUBLE AS coherence, CASE WHEN len(w) / n BETWEEN 5 AND 25 THEN 0.9 ELSE 0.5 END::DOUBLE AS readability,
  CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS consistency FROM x)
SELECT conv_id, turn, round(0.25 * completeness + 0.2 * 0.5 + 0.2 * relevance + 0.15 * coherence + 0.1 * 0.0 + 0.05 * readability + 0.05 * consistency, 6) AS overall,
array_to_string(list_filter([CASE WHEN completeness >= 0.8 THEN 'complete' END, CASE WHEN relevance >= 0.8 THEN 'relevant' END, CASE WHEN readability >= 0.8 THEN 'readable' END], lambda x: x IS NOT NULL), ',') AS strengths,
array_to_string(list_filter([CASE WHEN completeness < 0.5 THEN 'incomplete' END, CASE WHEN relevance < 0.5 THEN 'off topic' END, CASE WHEN coherence < 0.5 THEN 'incoherent' END], lambda x: x IS NOT NULL), ',') AS weaknesses FROM m""")
def response_assessment(spark, d):
    """Seven lexical dimensions of an answer, their weighted mean, and what stands out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, d, "conversations").withColumn("q", F.lag("text").over(w)).where("role = 'assistant' and q is not null")
    text = F.coalesce("text", F.lit(""))
    t = t.select("conv_id", "turn", T.tokens(text).alias("w"), T.tokens(F.col("q")).alias("v"), F.greatest(F.lit(1), F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(F.replace(s, F.lit("\n"), F.lit(" "))) != ""))).alias("n"))
    n, a, b = F.size("w"), F.array_distinct("w"), F.array_distinct("v")
    t = t.withColumns({
        "completeness": F.least(F.lit(1.0), n / F.greatest(F.lit(1), F.size("v") * 10)), "relevance": F.when(F.size("v") == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b)),
        "coherence": F.when(F.col("n") >= 3, 0.8).when(F.col("n") == 2, 0.6).otherwise(0.4), "readability": F.when((n / F.col("n")).between(5, 25), 0.9).otherwise(0.5),
        "consistency": F.when(n == 0, 0.0).otherwise(F.size(a) / n),
    })
    c = F.col
    overall = 0.25 * c("completeness") + 0.2 * F.lit(0.5) + 0.2 * c("relevance") + 0.15 * c("coherence") + 0.05 * c("readability") + 0.05 * c("consistency")
    said = lambda *xs: F.array_join(F.array_compact(F.array(*[F.when(x, label) for x, label in xs])), ",")
    return t.select(
        "conv_id", "turn", F.round(overall, 6).alias("overall"), said((c("completeness") >= 0.8, "complete"), (c("relevance") >= 0.8, "relevant"), (c("readability") >= 0.8, "readable")).alias("strengths"),
        said((c("completeness") < 0.5, "incomplete"), (c("relevance") < 0.5, "off topic"), (c("coherence") < 0.5, "incoherent")).alias("weaknesses"),
    )


#: Without word boundaries, whose meaning next to accents depends on the engine.
PATTERNS = {"PERSON": r"(?:Dr|Mr|Mrs|Ms|Prof)\. [A-Z][a-z]+", "DATE": r"\d{4}-\d{2}-\d{2}", "EMAIL": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "NUMBER": r"\d+(?:\.\d+)?%", "NAME": r"[A-Z][a-z]{7,}"}
PATTERN_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS name FROM documents" for k, p in PATTERNS.items())


@query(f"""WITH f AS ({PATTERN_SQL}), o AS (SELECT doc_id, lower(name) AS key, min(type) AS type FROM f GROUP BY ALL) SELECT doc_id, type, key, 0.3::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY type, key) AS rn FROM o) WHERE rn <= 20""")
def pattern_entities(spark, d):
    """Entities by pattern, each name once, twenty to a document: what extraction falls back to."""

    def found(kind, pattern):
        hits = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)))
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("type"), F.lower(x).alias("key")))

    hits = [found(k, p) for k, p in PATTERNS.items()]
    f = read(spark, d, "documents").select("doc_id", F.explode(F.concat(*hits)).alias("e")).groupBy("doc_id", F.col("e.key").alias("key")).agg(F.min("e.type").alias("type"))
    w = Window.partitionBy("doc_id").orderBy("type", "key")
    return f.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("doc_id", "type", "key", F.lit(0.3).alias("confidence"))


@query("""WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS all_names, text FROM documents), s AS (SELECT doc_id, list_sort(all_names)[1:5] AS n FROM n),
p AS (SELECT doc_id, n, unnest(range(1, len(n) + 1)) AS i FROM s), q AS (SELECT doc_id, n[i] AS src, n[i + g] AS dst FROM p, (VALUES (1), (2)) v(g) WHERE i + g <= len(n)) SELECT doc_id, src, 'MENTIONED_WITH' AS type, dst, 0.2::DOUBLE AS confidence FROM q""")
def pattern_relations(spark, d):
    """The first five names of a document, each related to the next two."""
    n = F.slice(F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), F.lit(1)))), 1, 5)
    p = read(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", "n", F.posexplode("n").alias("i", "src")).withColumn("gap", F.explode(F.array(F.lit(1), F.lit(2))))
    return p.withColumn("dst", F.get("n", F.col("i") + F.col("gap"))).where("dst is not null").select("doc_id", "src", F.lit("MENTIONED_WITH").alias("type"), "dst", F.lit(0.2).alias("confidence"))


@query("""WITH s AS (SELECT conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '[.!?]+')) AS s FROM conversations), o AS (SELECT conv_id, turn, trim(s, chr(32) || chr(10)) AS s FROM s WHERE trim(s, chr(32) || chr(10)) <> ''),
m AS (SELECT conv_id, turn, s, length(s) % 10 / 10 AS confidence FROM o) SELECT conv_id, turn, md5(s) AS digest, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.9 THEN 'verified' WHEN confidence >= 0.7 THEN 'partial' END AS status FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY confidence DESC, s) AS rn FROM (SELECT DISTINCT * FROM m)) WHERE rn <= 3""")
def citation_cap(spark, d):
    """The three most certain matches of an answer and whether they count as verified."""
    s = read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split(F.coalesce("text", F.lit("")), "[.!?]+", -1)).alias("s"))
    s = s.withColumn("s", F.regexp_replace("s", "^[ \n]+|[ \n]+$", "")).where("s <> ''").withColumn("confidence", F.length("s") % 10 / 10).distinct()
    w = Window.partitionBy("conv_id", "turn").orderBy(F.desc("confidence"), "s")
    status = F.when(F.col("confidence") >= 0.9, "verified").when(F.col("confidence") >= 0.7, "partial")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("conv_id", "turn", F.md5("s").alias("digest"), F.round("confidence", 6).alias("confidence"), status.alias("status"))
