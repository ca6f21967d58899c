"""Pages, transcripts, upserts, audits and maintenance of stored tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowmill.operators import dedup, graph
from knowmill.plans.registry import query
from knowmill.sources.tables import GRAPH_SQL, entities, read, relations
from knowmill.streaming import events as stream

# --- pages -----------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS domain, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, len(regexp_extract_all(html, '(?i)<meta ')) AS n_meta,
regexp_extract(html, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1) AS description, regexp_extract(html, '(?is)<meta[^>]*charset="([^"]*)"', 1) AS charset FROM pages""")
def page_meta_tags(spark, d):
    one = lambda p: F.regexp_extract("html", p, 1)
    site = F.substring_index(F.split("url", "://")[1], "/", 1)
    return read(spark, d, "pages").select(
        "page_id", site.alias("domain"), one(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"), F.regexp_count("html", F.lit("(?i)<meta ")).cast("long").alias("n_meta"),
        one(r'(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"').alias("description"), one(r'(?is)<meta[^>]*charset="([^"]*)"').alias("charset"),
    )


@query("""WITH a AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1))) AS link FROM pages), s AS (SELECT page_id, link, split_part(url, '://', 1) AS scheme, regexp_extract(url, '^(.*?://[^/?#]*)', 1) AS site, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)', 1) AS folder FROM a WHERE NOT regexp_matches(link, '(?i)^(javascript:|mailto:|tel:|#)'))
SELECT DISTINCT page_id, CASE WHEN regexp_matches(link, '(?i)^[a-z]+:') THEN link WHEN link LIKE '//%' THEN scheme || ':' || link WHEN link LIKE '/%' THEN site || link ELSE folder || link END AS link FROM s""")
def absolute_links(spark, d):
    """Distinct links of a page, made absolute."""
    p = read(spark, d, "pages").select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="([^"]*)"'), F.lit(1)))).alias("link"))
    p = p.where(~F.col("link").rlike("(?i)^(javascript:|mailto:|tel:|#)"))
    site, folder = F.regexp_extract("url", r"^(.*?://[^/?#]*)", 1), F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^(.*/)", 1)
    link = F.col("link")
    whole = F.when(link.rlike("(?i)^[a-z]+:"), link).when(link.startswith("//"), F.concat(F.substring_index("url", "://", 1), F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(folder, link))
    return p.select("page_id", whole.alias("link")).distinct()


@query("""WITH m AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1) AS a, regexp_extract(html, '(?is)<main[^>]*>(.*)</main>', 1) AS m, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) AS b FROM pages),
c AS (SELECT page_id, CASE WHEN a <> '' THEN a WHEN m <> '' THEN m ELSE b END AS c, CASE WHEN a <> '' THEN 'article' WHEN m <> '' THEN 'main' ELSE 'body' END AS part FROM m)
SELECT page_id, part, trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS content FROM c""")
def main_content(spark, d):
    """The article of a page, else its main part, else its body, as text."""
    part = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*)</{tag}>", 1)
    c = read(spark, d, "pages").select("page_id", part("article").alias("a"), part("main").alias("m"), part("body").alias("b"))
    kind = F.when(F.col("a") != "", "article").when(F.col("m") != "", "main").otherwise("body")
    c = c.select("page_id", kind.alias("part"), F.when(F.col("a") != "", F.col("a")).when(F.col("m") != "", F.col("m")).otherwise(F.col("b")).alias("c"))
    return c.select("page_id", "part", F.trim(F.regexp_replace(F.regexp_replace("c", "<[^>]*>", " "), r"[ \t\n\r]+", " ")).alias("content"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS c FROM documents),
s AS (SELECT doc_id, 1.0 - CASE WHEN length(t) < 100 THEN 0.4 ELSE 0 END - CASE WHEN length(t) > 20000 THEN 0.1 ELSE 0 END - CASE WHEN len(c) = 0 THEN 0.5 ELSE 0 END - CASE WHEN len(c) > 0 AND 2 * len(list_filter(c, lambda x: length(x) < 50)) > len(c) THEN 0.2 ELSE 0 END AS s FROM t)
SELECT doc_id, round(greatest(0.1, s)::DOUBLE, 6) AS score, length(coalesce(text, '')) >= 50 AND NOT contains(coalesce(text, ''), chr(0)) AS converted FROM s JOIN documents USING (doc_id)""")
def document_quality(spark, d):
    """Penalties for short, huge, empty and chopped texts, 0.1 at least; and whether a conversion counts as done."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x) != "")
    n = F.size(lines)
    off = lambda cond, x: F.when(cond, x).otherwise(0.0)
    s = 1.0 - off(F.length(t) < 100, 0.4) - off(F.length(t) > 20000, 0.1) - off(n == 0, 0.5) - off((n > 0) & (2 * F.size(F.filter(lines, lambda x: F.length(x) < 50)) > n), 0.2)
    return read(spark, d, "documents").select("doc_id", F.round(F.greatest(F.lit(0.1), s), 6).alias("score"), ((F.length(t) >= 50) & ~t.contains("\0")).alias("converted"))


@query("""SELECT page_id, CASE regexp_extract(lower(split_part(url, '?', 1)), '\\.([a-z0-9]+)$', 1) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'net' THEN 'site' WHEN 'com' THEN 'site' WHEN 'org' THEN 'site'
ELSE CASE WHEN html ILIKE '<!doctype html%' THEN 'html' ELSE 'text' END END AS format FROM pages""")
def page_formats(spark, d):
    """The format by suffix, else by the first characters."""
    suffix = F.regexp_extract(F.lower(F.substring_index("url", "?", 1)), r"\.([a-z0-9]+)$", 1)
    known = F.create_map(*[F.lit(x) for k, v in {"html": "html", "htm": "html", "pdf": "pdf", "md": "markdown", "json": "json", "net": "site", "com": "site", "org": "site"}.items() for x in (k, v)])
    sniffed = F.when(F.lower("html").startswith("<!doctype html"), "html").otherwise("text")
    return read(spark, d, "pages").select("page_id", F.coalesce(F.try_element_at(known, suffix), sniffed).alias("format"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript, count(*) AS segments FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id""")
def transcripts(spark, d):
    """Segments with text joined in order."""
    c = read(spark, d, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("conv_id")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.agg(parts.alias("p"), F.count("*").alias("segments")).select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("transcript"), "segments")


@query("""SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)""")
def unprocessed_pages(spark, d):
    """Pages that no log names as processed."""
    done = read(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("page_id"))
    return read(spark, d, "pages").select("page_id").join(done, "page_id", "left_anti")


# --- transcripts in time ---------------------------------------------------------------------------------------------

#: Segments of ten seconds a turn and one more for each hundred characters; speakers overlap by two seconds.
SEGMENTS_SQL = """seg AS (SELECT conv_id, turn, role AS speaker, turn * 10.0::DOUBLE AS a, turn * 10.0::DOUBLE + 12 + length(coalesce(text, '')) // 100 AS b FROM conversations)"""


def segments(spark, d):
    start = F.col("turn") * F.lit(10.0)
    return read(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), start.alias("a"), (start + 12 + F.floor(F.length(F.coalesce("text", F.lit(""))) / 100)).cast("double").alias("b"))


@query(f"""WITH {SEGMENTS_SQL} SELECT x.conv_id, x.speaker AS one, y.speaker AS other, count(*) AS n_overlaps, round(sum(least(x.b, y.b) - greatest(x.a, y.a)), 6) AS seconds FROM seg x JOIN seg y ON x.conv_id = y.conv_id AND x.turn < y.turn AND x.speaker <> y.speaker AND x.a < y.b AND y.a < x.b GROUP BY ALL""")
def speaker_overlap(spark, d):
    """Time in which two speakers of a conversation talk at once."""
    s = segments(spark, d)
    y = s.toDF("conv_id", "turn_y", "other", "c", "e")
    both = s.join(y, "conv_id").where("turn < turn_y and speaker <> other and a < e and c < b")
    return both.groupBy("conv_id", F.col("speaker").alias("one"), "other").agg(F.count("*").alias("n_overlaps"), F.round(F.sum(F.least("b", "e") - F.greatest("a", "c")), 6).alias("seconds"))


@query(f"""WITH {SEGMENTS_SQL}, topic AS (SELECT conv_id, turn // 3 AS topic, min(a) AS ta, max(b) AS tb FROM seg GROUP BY ALL), o AS (SELECT t.conv_id, topic, speaker, sum(least(b, tb) - greatest(a, ta)) AS s FROM topic t JOIN seg ON seg.conv_id = t.conv_id AND a < tb AND ta < b GROUP BY ALL)
SELECT conv_id, topic::INT AS topic, speaker, round(s, 6) AS seconds, round(s / sum(s) OVER (PARTITION BY conv_id, topic), 6) AS share FROM o""")
def speaker_shares(spark, d):
    """Each speaker's share of the time of a topic (three turns)."""
    s = segments(spark, d)
    topic = s.groupBy("conv_id", F.floor(F.col("turn") / 3).cast("int").alias("topic")).agg(F.min("a").alias("ta"), F.max("b").alias("tb"))
    o = topic.join(s, "conv_id").where("a < tb and ta < b").groupBy("conv_id", "topic", "speaker").agg(F.sum(F.least("b", "tb") - F.greatest("a", "ta")).alias("s"))
    w = Window.partitionBy("conv_id", "topic")
    return o.select("conv_id", "topic", "speaker", F.round("s", 6).alias("seconds"), F.round(F.col("s") / F.sum("s").over(w), 6).alias("share"))


@query(f"""WITH {SEGMENTS_SQL}, m AS (SELECT *, CASE WHEN turn = 0 OR turn % 4 = 3 THEN 1 ELSE 0 END AS new FROM seg), n AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m)
SELECT conv_id, 'TOPIC_' || lpad(k::VARCHAR, 2, '0') AS topic, count(*) AS turns, min(a) AS started, max(b) AS ended FROM n GROUP BY conv_id, k""")
def topic_segments(spark, d):
    """Topics from boundaries, by a running count, with their times."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when((F.col("turn") == 0) | (F.col("turn") % 4 == 3), 1).otherwise(0)
    s = segments(spark, d).withColumn("new", new).withColumn("k", F.sum("new").over(w)).groupBy("conv_id", "k")
    out = s.agg(F.count("*").alias("turns"), F.min("a").alias("started"), F.max("b").alias("ended"))
    return out.select("conv_id", F.concat(F.lit("TOPIC_"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("topic"), "turns", "started", "ended")


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), k AS (SELECT *, least(3, greatest(2, n // 10)) AS k FROM c)
SELECT conv_id, turn, least(k - 1, CASE WHEN n < k THEN i ELSE i // (n // k) END)::INT AS slice FROM k""")
def equal_segments(spark, d):
    """Two or three slices of equal size, the last taking what is left: used where no boundary is found."""
    w = Window.partitionBy("conv_id")
    c = read(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w.orderBy("turn")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    k = F.least(F.lit(3), F.greatest(F.lit(2), F.floor(F.col("n") / 10)))
    place = F.when(F.col("n") < k, F.col("i")).otherwise(F.floor(F.col("i") / F.floor(F.col("n") / k)))
    return c.select("conv_id", "turn", F.least(k - 1, place).cast("int").alias("slice"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, p, unnest(range(len(p))) AS i FROM l), m AS (SELECT doc_id, i, p[i + 1] AS line, CASE WHEN length(p[i + 1]) < 40 AND trim(p[i + 1]) <> '' THEN p[i + 1] END AS head FROM k)
SELECT doc_id, i::INT AS line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM m WHERE trim(line) <> ''""")
def running_sections(spark, d):
    """Each line with the last short line before it as its section."""
    lines = read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    head = F.when((F.length("line") < 40) & (F.trim("line") != ""), F.col("line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).where(F.trim("line") != "").select("doc_id", "line_no", "section")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part), b AS (SELECT *, ('0x' || substr(md5('job-7'), 1, 8))::BIGINT % ((n + 99) // 100) * 100 AS first FROM r) SELECT p_partkey FROM b WHERE rn >= first AND rn < first + 100""")
def rotation_batch(spark, d):
    """The hundred rows that a job's tag picks, by the order of ids; ids are cut by range, so that no task ranks them all."""
    import hashlib

    p = read(spark, d, "part").select("p_partkey")
    batches = max(1, -(-p.count() // 100))
    first = int(hashlib.md5(b"job-7").hexdigest()[:8], 16) % batches * 100
    return p.orderBy("p_partkey").offset(first).limit(100)


# --- upserts, audits and jobs ----------------------------------------------------------------------------------------


@query(f"""WITH {GRAPH_SQL}, old AS (SELECT src, dst, type, n, 0 AS ord FROM rel WHERE type = 'SUPPLIES'), new AS (SELECT src, dst, type, n + 1, 1 FROM rel WHERE type = 'SUPPLIES' AND n > 1 UNION ALL SELECT 's:none', 'p:1', 'SUPPLIES', 1, 1),
known AS (SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM new) WHERE src IN (SELECT id FROM ent) AND dst IN (SELECT id FROM ent)) SELECT src, dst, type, n FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY ord DESC) AS rn FROM known) WHERE rn = 1""")
def relation_upsert(spark, d):
    """Relations whose ends exist, merged by key, the last write winning."""
    e, r = entities(spark, d).select("id"), relations(spark, d).where("type = 'SUPPLIES'")
    none = spark.createDataFrame([("s:none", "p:1", "SUPPLIES", 1, 1)], "src string, dst string, type string, n long, ord int")
    both = r.withColumn("ord", F.lit(0)).union(r.where("n > 1").withColumn("n", F.col("n") + 1).withColumn("ord", F.lit(1))).union(none)
    known = both.join(e, both.src == e.id, "left_semi").join(e, both.dst == e.id, "left_semi")
    return dedup.best_per_key(known, [F.col("src"), F.col("dst"), F.col("type")], [F.desc("ord")]).select("src", "dst", "type", "n")


@query("""WITH c AS (SELECT o_orderkey AS document_id, o_custkey AS owner FROM orders), k AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk, min(l_partkey) AS part FROM lineitem GROUP BY ALL)
SELECT k.document_id, 'doc:' || k.document_id || ':chunk:' || chunk AS chunk_id, owner, 'CONTAINS' AS edge FROM k JOIN c USING (document_id)""")
def document_contains(spark, d):
    """Chunks, once each, with the edge from their document."""
    c = read(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("owner"))
    k = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk")).distinct().join(c, "document_id")
    return k.select("document_id", F.concat(F.lit("doc:"), "document_id", F.lit(":chunk:"), "chunk").alias("chunk_id"), "owner", F.lit("CONTAINS").alias("edge"))


@query("""WITH new AS (SELECT vec_id, label, [x * 2 FOR x IN embedding] AS e FROM embeddings WHERE label % 3 = 0), kept AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE label NOT IN (SELECT label FROM new))
SELECT vec_id, label, round(list_sum([x::DOUBLE FOR x IN e]), 4) AS total FROM (SELECT * FROM kept UNION ALL SELECT * FROM new)""")
def vector_replace(spark, d):
    """All vectors of a document (label) replaced by new ones, others kept."""
    e = read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    new = e.where("label % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2).cast("float")))
    kept = e.join(new.select("label").distinct(), "label", "left_anti").select("vec_id", "label", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return kept.union(new).select("vec_id", "label", F.round(total, 4).alias("total"))


@query(f"""WITH {GRAPH_SQL}, m AS (SELECT 'p:' || p_partkey AS old, 'p:' || (p_partkey - p_partkey % 2) AS new FROM part), r AS (SELECT src, coalesce(new, dst) AS dst, type, n FROM rel LEFT JOIN m ON old = dst)
SELECT src, dst, type, sum(n)::BIGINT AS n, count(*) AS merged FROM r WHERE src <> dst GROUP BY src, dst, type""")
def entity_merge(spark, d):
    """Edges moved from duplicates to the entities they are merged into; parallel edges become one."""
    m = read(spark, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("dst"), F.concat(F.lit("p:"), F.col("p_partkey") - F.col("p_partkey") % 2).alias("new"))
    r = relations(spark, d).join(m, "dst", "left").withColumn("dst", F.coalesce("new", "dst")).where("src <> dst")
    return r.groupBy("src", "dst", "type").agg(F.sum("n").alias("n"), F.count("*").alias("merged"))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS src, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey % 50 END AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'UNRELATED' ELSE 'RELATED_TO' END AS type, 0.2 + l_discount * 4 AS confidence FROM lineitem)
SELECT CASE WHEN type = 'UNRELATED' THEN 'type' WHEN dst IS NULL THEN 'orphan' WHEN src = dst THEN 'loop' WHEN confidence < 0.3 THEN 'confidence' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY reason""")
def relation_cleanup(spark, d):
    """What a clean-up drops and keeps, by reason."""
    dst = F.when(F.col("l_partkey") % 50 == 0, None).otherwise(F.col("l_partkey") % 50)
    reason = F.when(F.col("l_linenumber") % 3 == 0, "type").when(dst.isNull(), "orphan").when(F.col("l_suppkey") == dst, "loop").when(0.2 + F.col("l_discount") * 4 < 0.3, "confidence").otherwise("kept")
    return read(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_suppkey AS k, l_orderkey AS f, min(l_partkey) AS p FROM lineitem GROUP BY ALL), t AS (SELECT k, count(*) AS total FROM f GROUP BY k HAVING count(*) >= 10), a AS (SELECT f.k, f, p % 4 AS target, row_number() OVER (PARTITION BY f.k, p % 4 ORDER BY f) AS rn, total FROM f JOIN t ON t.k = f.k)
SELECT k, target::INT AS target, count(*) AS facts, round(count(*) / any_value(total), 6) AS share FROM a GROUP BY k, target HAVING count(*) >= 2""")
def keyword_hierarchy(spark, d):
    """Facts of a keyword with ten facts or more, dealt to its proposals; proposals with fewer than two are dropped."""
    f = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("f")).agg(F.min("l_partkey").alias("p"))
    t = f.groupBy("k").agg(F.count("*").alias("total")).where("total >= 10")
    a = f.join(t, "k").groupBy("k", (F.col("p") % 4).cast("int").alias("target")).agg(F.count("*").alias("facts"), F.first("total").alias("total"))
    return a.where("facts >= 2").select("k", "target", "facts", F.round(F.col("facts") / F.col("total"), 6).alias("share"))


@query("""WITH t AS (SELECT l_orderkey AS f, l_suppkey AS s, max(l_shipdate) AS last FROM lineitem GROUP BY ALL), n AS (SELECT s, count(*) AS total FROM t GROUP BY s), p AS (SELECT a.s AS parent, b.s AS child, count(*) AS shared, count(*) / any_value(total) AS share FROM t a JOIN t b ON a.f = b.f AND a.s <> b.s JOIN n ON n.s = a.s AND total >= 10 GROUP BY ALL)
SELECT parent, child, round(share, 6) AS share, CASE WHEN shared >= 3 THEN 'CAUSES' WHEN shared = 2 THEN 'PART_OF' ELSE 'INFLUENCES' END AS type, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY share DESC, child) AS rank FROM p) WHERE rank <= 6""")
def keyword_links(spark, d):
    """Up to six links of a keyword with ten facts or more to those it shares most facts with."""
    links = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_suppkey").alias("item"))
    p = graph.co_occurrence(links, 0.0).where("total >= 10")
    w = Window.partitionBy("a").orderBy(F.desc("share"), "b")
    kind = F.when(F.col("shared") >= 3, "CAUSES").when(F.col("shared") == 2, "PART_OF").otherwise("INFLUENCES")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 6").select(F.col("a").alias("parent"), F.col("b").alias("child"), F.round("share", 6).alias("share"), kind.alias("type"), "rank")


@query("""SELECT 'lineitem without order' AS audit, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'repeated line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'vector without value', count(*) FROM embeddings WHERE embedding IS NULL UNION ALL SELECT 'turn without text', count(*) FROM conversations WHERE text IS NULL OR trim(text) = ''""")
def consistency_audit(spark, d):
    """References without a target, repeated keys and missing values of all stores."""
    t = {x: read(spark, d, x) for x in ("lineitem", "orders", "customer", "labels", "documents", "embeddings", "conversations")}
    lost = lambda a, b, ka, kb: t[a].join(t[b].select(F.col(kb).alias(ka)), ka, "left_anti")
    found = {
        "lineitem without order": lost("lineitem", "orders", "l_orderkey", "o_orderkey"), "order without customer": lost("orders", "customer", "o_custkey", "c_custkey"),
        "label without document": lost("labels", "documents", "doc_id", "doc_id"), "repeated line": t["lineitem"].groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "vector without value": t["embeddings"].where("embedding is null"), "turn without text": t["conversations"].where("text is null or trim(text) = ''"),
    }
    out = None
    for name, df in found.items():
        one = df.agg(F.lit(name).alias("audit"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {GRAPH_SQL}, o AS (SELECT id, CASE WHEN type = 'NATION' THEN 'ent_' || lower(name) ELSE id END AS new FROM ent), r AS (SELECT coalesce(a.new, src) AS src, coalesce(b.new, dst) AS dst, rel.type FROM rel LEFT JOIN o a ON a.id = src LEFT JOIN o b ON b.id = dst WHERE rel.type <> 'BOUGHT')
SELECT type, count(*) AS n, sum((src LIKE 'ent\\_%' ESCAPE '\\')::INT + (dst LIKE 'ent\\_%' ESCAPE '\\')::INT)::BIGINT AS moved FROM r GROUP BY type""")
def id_migration(spark, d):
    """New ids carried to all references: how many ends of each type of relation moved."""
    new = F.when(F.col("type") == "NATION", F.concat(F.lit("ent_"), F.lower("name"))).otherwise(F.col("id"))
    o = entities(spark, d).select("id", new.alias("new"))
    r = relations(spark, d).where("type <> 'BOUGHT'")
    r = r.join(o.toDF("src", "a"), "src", "left").join(o.toDF("dst", "b"), "dst", "left").select("type", F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    moved = F.col("src").startswith("ent_").cast("int") + F.col("dst").startswith("ent_").cast("int")
    return r.groupBy("type").agg(F.count("*").alias("n"), F.sum(moved).alias("moved"))


@query("""SELECT event_id, event_type FROM events WHERE (props->>'k')::INT = 42 AND event_type IN ('view', 'click')""")
def metadata_search(spark, d):
    """Rows whose payload fits all conditions."""
    return read(spark, d, "events").where((F.get_json_object("props", "$.k").cast("int") == 42) & F.col("event_type").isin("view", "click")).select("event_id", "event_type")


@query("""WITH s AS (SELECT user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type AS state, value FROM s WHERE rn = 1""")
def job_states(spark, d):
    """The latest state of each job."""
    latest = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    return read(spark, d, "events").groupBy("user_id").agg(latest.alias("x")).select("user_id", F.col("x.event_type").alias("state"), F.col("x.value").alias("value"))


@query("""SELECT o_orderstatus AS stage, count(*) AS runs, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS successes, round(avg(o_totalprice), 4) AS mean_cost FROM orders GROUP BY o_orderstatus""")
def processing_counters(spark, d):
    good = F.sum(F.when(F.col("o_totalprice") > 100000, 1).otherwise(0))
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("runs"), good.alias("successes"), F.round(F.avg("o_totalprice"), 4).alias("mean_cost"))


@query("""SELECT event_type, count(DISTINCT event_id) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type""")
def streamed_events(spark, d):
    """Events read as a stream, repeats within the watermark removed, then counted. The path is a pattern, since a stream
    takes a plain one for a folder."""
    table = read(spark, d, "events").select("event_id", "ts", "event_type", "value")
    seen = stream.run_once(stream.unique_events(stream.event_stream(spark, f"{d}/[e]vents.parquet", table.schema)), "events")
    return seen.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
