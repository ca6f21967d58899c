"""Queries over documents, pages, conversations, vectors and events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowmill.functions import text as T
from knowmill.operators import chunking, dedup, ranking
from knowmill.plans.registry import query
from knowmill.sources.tables import read
from knowmill.streaming import events as stream

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in T.STOP) + ")"
TOKEN_SQL = "[x FOR x IN string_split_regex(lower({}), '[ \\t\\n\\x0B\\f\\r]+') IF x <> '']"
WORDS_SQL = f"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), k AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN {STOP_SQL} GROUP BY ALL)"


def _row_counts(spark, d):
    """doc_id and its keywords with counts, most frequent first: a document is one row, so nothing is shuffled."""
    docs = read(spark, d, "documents").select("doc_id", F.sort_array(T.keywords(F.col("text"))).alias("w"))
    # Of a sorted list, a word's count is the distance between its first place and the next word's.
    firsts = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda e: (e["i"] == 0) | (e["word"] != F.get("w", F.greatest(e["i"] - 1, F.lit(0)))))
    docs = docs.withColumn("f", firsts)
    counted = F.transform("f", lambda e, k: F.struct((e["i"] - F.coalesce(F.get("f", k + 1)["i"], F.size("w"))).alias("minus"), e["word"].alias("word")))
    return docs.select("doc_id", F.size("w").alias("total"), F.sort_array(counted).alias("k"))


def _counts(spark, d):
    # A plain explode makes the optimizer test the array's size below, computing all of it again for each word.
    rows = _row_counts(spark, d).select("doc_id", F.explode_outer("k").alias("e")).where("e is not null")
    return rows.select("doc_id", F.col("e.word").alias("word"), (-F.col("e.minus")).cast("long").alias("n"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, word, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM k) WHERE rank <= 20 AND n > 1")
def keyword_topk(spark, d):
    top = _row_counts(spark, d).select("doc_id", F.posexplode_outer(F.slice("k", 1, 20)).alias("at", "e")).where("e.minus < -1")
    return top.select("doc_id", F.col("e.word").alias("word"), (-F.col("e.minus")).cast("long").alias("n"), (F.col("at") + 1).alias("rank"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, word, round(n / sum(n) OVER (PARTITION BY doc_id), 8) AS tf FROM k")
def sparse_tf(spark, d):
    rows = _row_counts(spark, d).select("doc_id", "total", F.explode_outer("k").alias("e")).where("e is not null")
    return rows.select("doc_id", F.col("e.word").alias("word"), F.round(-F.col("e.minus") / F.col("total"), 8).alias("tf"))


@query(f"WITH {WORDS_SQL} SELECT word, count(*) AS n_docs, sum(n)::BIGINT AS n FROM k GROUP BY word HAVING count(*) >= 3")
def keyword_index(spark, d):
    return _counts(spark, d).groupBy("word").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")).where("n_docs >= 3")


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 800)) AS start FROM documents)
SELECT doc_id, (start // 800)::INT AS chunk, start::INT AS start, md5(substr(text, start + 1, 1000)) AS digest FROM s""")
def stride_chunks(spark, d):
    return chunking.stride_chunks(read(spark, d, "documents"), 1000, 200).select("doc_id", "chunk", "start", F.md5("content").alias("digest"))


BOUNDS_SQL = """WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, 0 AS chunk, 0 AS a, CASE WHEN n <= 1000 THEN n WHEN strpos(reverse(substr(text, 1, 1000)), ' ') BETWEEN 1 AND 999 THEN 1000 - strpos(reverse(substr(text, 1, 1000)), ' ') ELSE 1000 END AS b FROM t
  UNION ALL SELECT doc_id, chunk + 1, s, CASE WHEN s + 1000 >= n THEN n WHEN strpos(reverse(substr(text, s + 1, 1000)), ' ') BETWEEN 1 AND 999 THEN s + 1000 - strpos(reverse(substr(text, s + 1, 1000)), ' ') ELSE s + 1000 END
  FROM (SELECT r.doc_id, chunk, text, n, greatest(a + 1, b - 200) AS s FROM r JOIN t USING (doc_id) WHERE b < n))"""


@query(f"""{BOUNDS_SQL} SELECT r.doc_id, chunk::INT AS chunk, a::INT AS start, b::INT AS stop, trim(substr(text, a + 1, b - a), chr(32) || chr(9) || chr(10) || chr(13)) AS content FROM r JOIN t USING (doc_id)""")
def word_chunks(spark, d):
    return chunking.word_chunks(read(spark, d, "documents"), 1000, 200).withColumnRenamed("end", "stop")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p FROM documents), q AS (SELECT doc_id, p, unnest(range(len(p))) AS i FROM l)
SELECT doc_id, i::INT AS chunk, md5(p[i + 1]) AS digest FROM q""")
def paragraph_chunks(spark, d):
    return chunking.paragraph_chunks(read(spark, d, "documents")).select("doc_id", "chunk", F.md5("content").alias("digest"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents), q AS (SELECT doc_id, unnest(p) AS content, unnest(range(len(p)))::INT AS sentence FROM s) SELECT * FROM q WHERE content <> ''""")
def sentence_chunks(spark, d):
    return chunking.sentences(read(spark, d, "documents"))


@query("""SELECT conv_id, turn, coalesce(substr(lag(text, 2) OVER w, 1, 200), '') AS before_2, coalesce(substr(lag(text) OVER w, 1, 200), '') AS before_1, coalesce(substr(lead(text) OVER w, 1, 200), '') AS after_1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_window(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    cut = lambda c: F.coalesce(F.substring(c, 1, 200), F.lit(""))
    return read(spark, d, "conversations").select("conv_id", "turn", cut(F.lag("text", 2).over(w)).alias("before_2"), cut(F.lag("text").over(w)).alias("before_1"), cut(F.lead("text").over(w)).alias("after_1"))


@query("""SELECT conv_id, turn, coalesce(substr(lag(text, 2) OVER w, 1, 200), '') AS before_2, coalesce(substr(lag(text) OVER w, 1, 200), '') AS before_1, coalesce(substr(lead(text) OVER w, 1, 200), '') AS after_1, coalesce(substr(lead(text, 2) OVER w, 1, 200), '') AS after_2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_window_two(spark, d):
    """As context_window, with two turns after as well as before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    cut = lambda c: F.coalesce(F.substring(c.over(w), 1, 200), F.lit(""))
    sides = {"before_2": F.lag("text", 2), "before_1": F.lag("text"), "after_1": F.lead("text"), "after_2": F.lead("text", 2)}
    return read(spark, d, "conversations").select("conv_id", "turn", *[cut(c).alias(k) for k, c in sides.items()])


@query("SELECT conv_id, role, count(*) AS turns, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean_chars, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id, role")
def speaker_statistics(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id", "role")
    return c.agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
x AS (SELECT conv_id, turn, list_distinct({TOKEN_SQL.format("text")}) AS a, list_distinct({TOKEN_SQL.format("q")}) AS b, length(text) AS n FROM t WHERE role = 'assistant' AND q IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b) END, 6) AS coverage, round(least(1.0, n / 500), 6) AS length_score FROM x""")
def response_quality(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, d, "conversations").withColumn("q", F.lag("text").over(w)).where("role = 'assistant' and q is not null")
    a, b = (F.array_distinct(T.tokens(F.col(c))) for c in ("text", "q"))
    coverage = F.when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))
    return t.select("conv_id", "turn", F.round(coverage, 6).alias("coverage"), F.round(F.least(F.lit(1.0), F.length("text") / 500), 6).alias("length_score"))


COS_SQL = "list_sum([a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE FOR i IN range(1, len(a.embedding) + 1)]) / (sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN a.embedding])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN b.embedding])))"


@query(f"""WITH s AS (SELECT a.label AS query_label, b.vec_id AS id, {COS_SQL} AS score FROM (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1) a, embeddings b)
SELECT query_label, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1) WHERE rank <= 10""")
def cosine_topk(spark, d):
    """The ten vectors nearest to the first vector of each label."""
    e = read(spark, d, "embeddings")
    q = dedup.best_per_key(e, [F.col("label")], [F.col("vec_id")]).select(F.col("label").alias("query_label"), F.col("embedding").alias("q"))
    out = ranking.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), q.withColumnRenamed("query_label", "query"), 10, 0.1)
    return out.select(F.col("query").alias("query_label"), "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS_SQL} AS score FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) a, embeddings b)
SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1) WHERE rank <= 10""")
def cosine_topk_all(spark, d):
    """The ten vectors nearest to every vector whose id is divisible by 50, itself among them."""
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    out = ranking.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), q.withColumnRenamed("query_id", "query"), 10, 0.1)
    return out.select(F.col("query").alias("query_id"), "id", "rank", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT label, vec_id, list_sum([x::DOUBLE FOR x IN embedding]) AS a, list_max(embedding)::DOUBLE AS b FROM embeddings),
r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY a DESC, vec_id) AS ra, row_number() OVER (PARTITION BY label ORDER BY b DESC, vec_id) AS rb FROM s)
SELECT label AS query_id, vec_id AS item, round(CASE WHEN ra <= 50 THEN 1 / (60 + ra) ELSE 0 END + CASE WHEN rb <= 50 THEN 1 / (60 + rb) ELSE 0 END, 8) AS score, ((ra <= 50)::BIGINT + (rb <= 50)::BIGINT) AS n_lists FROM r WHERE ra <= 50 OR rb <= 50""")
def reciprocal_rank_fusion(spark, d):
    s = read(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("item"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("a"), F.array_max("embedding").cast("double").alias("b"))
    one, two = (ranking.top(s, "query_id", c, "item", 50).select("query_id", "item", "rank") for c in "ab")
    return ranking.reciprocal_rank_fusion(one.union(two)).withColumn("score", F.round("score", 8))


@query("""WITH v AS (SELECT p_size AS query_id, p_partkey AS item, round(p_retailprice / 3000, 6) AS score FROM part WHERE p_partkey % 3 <> 0),
g AS (SELECT p_size AS query_id, p_partkey AS item, round(1.0 / (1 + p_size), 6) AS score FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(v.item, g.item) AS item, round(coalesce(v.score, 0) * 0.6 + coalesce(g.score, 0) * 0.4, 6) AS score, CASE WHEN v.item IS NULL THEN 'graph' WHEN g.item IS NULL THEN 'vector' ELSE 'both' END AS found_by FROM v FULL JOIN g ON v.query_id = g.query_id AND v.item = g.item""")
def weighted_fusion(spark, d):
    p = read(spark, d, "part")
    row = lambda s: [F.col("p_size").alias("query_id"), F.col("p_partkey").alias("item"), F.round(s, 6).alias("score")]
    v, g = p.where("p_partkey % 3 <> 0").select(*row(F.col("p_retailprice") / 3000)), p.where("p_partkey % 2 = 0").select(*row(1 / (1 + F.col("p_size"))))
    return ranking.weighted_fusion(v, g).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT doc_id, len({TOKEN_SQL.format("text")}) AS n, contains(text, '# ') AS h FROM documents)
SELECT doc_id, round((least(1.0, n / 100) + 0.9 + CASE WHEN h THEN 0.8 ELSE 0.5 END) / 3, 6) AS score, (least(1.0, n / 100) + 0.9 + CASE WHEN h THEN 0.8 ELSE 0.5 END) / 3 >= 0.8 AS passed FROM t""")
def web_quality_gate(spark, d):
    s = T.web_quality(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.round(s, 6).alias("score"), (s >= 0.8).alias("passed"))


LANG_SQL = ", ".join("len([x FOR x IN t IF x IN (" + ", ".join(f"'{w}'" for w in v) + f")]) AS {k}" for k, v in T.LANGUAGE_WORDS.items())


@query(f"""WITH t AS (SELECT doc_id, lang, length(text) AS n, {TOKEN_SQL.format("text")} AS t FROM documents), h AS (SELECT doc_id, lang, n, {LANG_SQL} FROM t)
SELECT doc_id, lang, CASE WHEN n < 10 OR greatest(en, de, fr, es) = 0 THEN 'unknown' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS detected FROM h""")
def document_language(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", T.language(F.col("text"), None).alias("detected"))


@query(f"""WITH t AS (SELECT doc_id, lang, length(text) AS n, {TOKEN_SQL.format("text")} AS t FROM documents), h AS (SELECT doc_id, lang, n, {LANG_SQL} FROM t)
SELECT doc_id, lang, CASE WHEN n < 10 OR greatest(en, de, fr, es) = 0 THEN 'unknown' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS detected FROM h""")
def document_language_whole(spark, d):
    """As document_language, by the words of whole texts."""
    return read(spark, d, "documents").select("doc_id", "lang", T.language(F.col("text"), None).alias("detected"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(compare|versus|difference)\\b') THEN 'comparison' WHEN regexp_matches(lower(text), '\\b(how|steps)\\b') THEN 'procedural' WHEN regexp_matches(lower(text), '\\b(why|because)\\b') THEN 'causal'
WHEN regexp_matches(lower(text), '\\b(when|date)\\b') THEN 'temporal' WHEN regexp_matches(lower(text), '\\b(who|where|what|which)\\b') THEN 'factual' ELSE 'general' END AS intent FROM conversations WHERE role = 'user'""")
def query_intent(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://(www\\.|m\\.)?(youtube\\.com|youtu\\.be)/') THEN 'YOUTUBE' WHEN regexp_matches(url, '(?i)^https?://') THEN 'WEB' ELSE 'TEXT' END AS kind,
coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, regexp_extract(html, '(?is)<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages""")
def page_metadata(spark, d):
    one = lambda p: F.regexp_extract("html", p, 1)
    return read(spark, d, "pages").select("page_id", T.content_type(F.col("url")).alias("kind"), one(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), one(r'(?is)<html[^>]*lang="([^"]*)"').alias("lang"))


@query("""SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)) AS link FROM pages) WHERE NOT regexp_matches(link, '(?i)^(javascript:|mailto:|tel:|#)')""")
def page_links(spark, d):
    links = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.where(~F.col("link").rlike("(?i)^(javascript:|mailto:|tel:|#)")).distinct()


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|nav|header|footer)\\b.*?</(script|style|noscript|nav|header|footer)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS content FROM pages""")
def page_text(spark, d):
    noise = r"(?is)<(script|style|noscript|nav|header|footer)\b.*?</(script|style|noscript|nav|header|footer)>"
    bare = F.regexp_replace(F.regexp_replace("html", noise, " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return read(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " ")).alias("content"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def document_duplicates(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT n.doc_id, md5(n.text) AS digest FROM documents n LEFT JOIN (SELECT doc_id + 1 AS doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 0) o ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM md5(n.text)")
def checksum_diff(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    old = docs.where("doc_id % 2 = 0").withColumn("doc_id", F.col("doc_id") + 1)
    return dedup.changed(old, docs, "doc_id", "digest").select("doc_id", "digest")


NAMES_SQL = f"""WITH p AS (SELECT p_type, p_name, min(p_partkey) AS k, count(*) AS n, list_distinct({TOKEN_SQL.format("p_name")}) AS t FROM part GROUP BY p_type, p_name)
SELECT a.k AS a, b.k AS b, a.n * b.n AS pairs, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jaccard, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS edit
FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 0.5 * greatest(length(a.p_name), length(b.p_name))"""


def _similar(spark, d):
    """Names of a type that are half alike or more, each distinct name once with the number of pairs of parts behind it. Names
    meet those of admissible lengths only."""
    p = read(spark, d, "part").groupBy("p_type", F.col("p_name").alias("na")).agg(F.min("p_partkey").alias("a"), F.count("*").alias("n"))
    p = p.withColumn("size", F.length("na"))
    b = p.toDF("p_type", "nb", "b", "m", "key")
    reach = F.sequence(F.ceil(F.col("size") / 2).cast("int"), (2 * F.col("size")).cast("int"))
    pairs = p.withColumn("key", F.explode(reach)).join(b, ["p_type", "key"]).where("na < nb")
    na, nb = F.col("na"), F.col("nb")
    near = F.levenshtein(na, nb) <= 0.5 * F.greatest(F.length(na), F.length(nb))
    return pairs.where(near).select("a", "b", (F.col("n") * F.col("m")).alias("pairs"), F.round(T.jaccard(na, nb), 6).alias("jaccard"), F.round(T.edit_similarity(na, nb), 6).alias("edit"))


@query(NAMES_SQL)
def similar_names(spark, d):
    """Similar names of parts of one type."""
    return _similar(spark, d)


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    return stream.windowed_counts(read(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS started FROM s GROUP BY user_id, session""")
def event_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes")
    e = read(spark, d, "events").withColumn("new", F.when(gap, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 6) AS success_rate, max((props->>'k')::INT) AS max_k FROM events GROUP BY event_type""")
def job_log_summary(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("success_rate"), F.max(k).alias("max_k"))


@query("""SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic""")
def label_summary(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("""SELECT c_custkey, round(greatest(0, 1 - 0.2 * (c_nationkey % 6)) * c_acctbal, 4) AS score FROM customer WHERE greatest(0, 1 - 0.2 * (c_nationkey % 6)) * c_acctbal >= 1000""")
def decayed_ranking(spark, d):
    s = ranking.decayed(F.col("c_acctbal"), F.col("c_nationkey") % 6)
    return read(spark, d, "customer").where(s >= 1000).select("c_custkey", F.round(s, 4).alias("score"))


@query(f"""WITH b AS (SELECT item_id, unnest(list_distinct({TOKEN_SQL.format("text")})) AS w FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct({TOKEN_SQL.format("text")})) AS w FROM documents),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id), s AS (SELECT item_id, doc_id, count(*) AS hits FROM b JOIN t USING (w) WHERE length(w) >= 6 GROUP BY ALL)
SELECT item_id, doc_id, round(hits / n, 6) AS score, rank::INT AS rank FROM (SELECT s.item_id, doc_id, hits, n, row_number() OVER (PARTITION BY s.item_id ORDER BY hits / n DESC, doc_id) AS rank FROM s JOIN n ON n.item_id = s.item_id) WHERE rank <= 10""")
def hybrid_retrieval(spark, d):
    """The ten documents that hold most of a benchmark item's words, by an inverted index on words of six letters or more."""
    words = lambda t, k: read(spark, d, t).select(k, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    items = words("benchmark", "item_id")
    n = items.groupBy("item_id").agg(F.count("*").alias("n"))
    hits = words("documents", "doc_id").where(F.length("w") >= 6).join(items, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    s = hits.join(n, "item_id").withColumn("score", F.col("hits") / F.col("n"))
    return ranking.top(s, "item_id", "score", "doc_id", 10).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")
