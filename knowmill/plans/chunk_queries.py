"""Chunking strategies over documents and transcripts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowmill.operators import chunking as C
from knowmill.plans.registry import query
from knowmill.sources.tables import read

#: DuckDB has no look-behind: a mark is put where a sentence ends.
SENTENCES_SQL = "string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def packed_sql(pieces: str, size: int, sep: str, table: str = "documents") -> str:
    """Greedy packing as recursion over a document's pieces."""
    n = len(sep)
    grow = f"n + {n} + length(p[i + 1]) > {size}"
    return f"""WITH RECURSIVE p AS (SELECT doc_id, {pieces} AS p FROM {table} WHERE text IS NOT NULL),
r AS (SELECT doc_id, 1::BIGINT AS i, 0 AS chunk, length(p[1]) AS n FROM p WHERE len(p) > 0 UNION ALL
  SELECT r.doc_id, i + 1, CASE WHEN {grow} THEN chunk + 1 ELSE chunk END, CASE WHEN {grow} THEN length(p[i + 1]) ELSE n + {n} + length(p[i + 1]) END FROM r JOIN p USING (doc_id) WHERE i < len(p)),
packed AS (SELECT doc_id, chunk, string_agg(p[i], {"chr(10) || chr(10)" if sep == chr(10) * 2 else "chr(10)" if sep == chr(10) else f"'{sep}'"} ORDER BY i) AS content FROM r JOIN p USING (doc_id) GROUP BY doc_id, chunk)"""


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text").where("text is not null")


def _digest(df, *more):
    return df.select("doc_id", "chunk", F.length("content").alias("chars"), F.md5("content").alias("digest"), *more)


FOLD_SQL = """WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, 0 AS chunk, 0 AS a, CASE WHEN n <= 1000 THEN n WHEN strpos(reverse(substr(text, 1, 1000)), ' ') BETWEEN 1 AND 999 THEN 1000 - strpos(reverse(substr(text, 1, 1000)), ' ') ELSE 1000 END AS b FROM t
  UNION ALL SELECT doc_id, chunk + 1, s, CASE WHEN s + 1000 >= n THEN n WHEN strpos(reverse(substr(text, s + 1, 1000)), ' ') BETWEEN 1 AND 999 THEN s + 1000 - strpos(reverse(substr(text, s + 1, 1000)), ' ') ELSE s + 1000 END
  FROM (SELECT r.doc_id, chunk, text, n, greatest(a + 1, b - 200) AS s FROM r JOIN t USING (doc_id) WHERE b < n))"""


@query(f"{FOLD_SQL} SELECT r.doc_id, chunk::INT AS chunk, a::INT AS start, b::INT AS stop, md5(trim(substr(text, a + 1, b - a), chr(32) || chr(9) || chr(10) || chr(13))) AS digest FROM r JOIN t USING (doc_id)")
def fixed_chunks(spark, d):
    """A thousand characters back to the last space, 200 of overlap."""
    out = C.word_chunks(_docs(spark, d), 1000, 200)
    return out.select("doc_id", "chunk", "start", F.col("end").alias("stop"), F.md5("content").alias("digest"))


@query(f"WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS content FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n, max(length(content)) AS longest, sum(length(content))::BIGINT AS chars FROM s WHERE content <> '' GROUP BY doc_id")
def sentence_split(spark, d):
    s = C.sentences(_docs(spark, d)).groupBy("doc_id")
    return s.agg(F.count("*").alias("n"), F.max(F.length("content")).cast("long").alias("longest"), F.sum(F.length("content")).alias("chars"))


LINES_SQL = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"


@query(f"{packed_sql(LINES_SQL, 1500, chr(10) * 2)} SELECT doc_id, chunk::INT AS chunk, length(content) AS chars, md5(content) AS digest FROM packed")
def semantic_chunks(spark, d):
    """Paragraphs packed to 1500 characters."""
    return _digest(C.chunks(_docs(spark, d), C.packed(C.nonblank(F.split("text", "\n", -1)), 1500, "\n\n")))


@query(f"{packed_sql(f'list_filter({SENTENCES_SQL}, lambda x: trim(x) <> {chr(39) * 2})', 800, ' ')} SELECT doc_id, chunk::INT AS chunk, length(content) AS chars, md5(content) AS digest FROM packed")
def sentence_packed_chunks(spark, d):
    """Sentences packed to 800 characters."""
    return _digest(C.chunks(_docs(spark, d), C.packed(C.nonblank(F.split("text", C.SENTENCE, -1)), 800, " ")))


@query(f"""{packed_sql(LINES_SQL, 1500, chr(10) * 2)} SELECT doc_id, chunk::INT AS chunk, coalesce(right(lag(content) OVER w, 100), '') AS before, length(content) + length(coalesce(right(lag(content) OVER w, 100), '')) <= 1800 AS fits
FROM packed WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)""")
def chunk_overlap(spark, d):
    """The last hundred characters of the chunk before, and whether they fit in front."""
    c = C.chunks(_docs(spark, d), C.packed(C.nonblank(F.split("text", "\n", -1)), 1500, "\n\n"))
    w = Window.partitionBy("doc_id").orderBy("chunk")
    before = F.coalesce(F.right(F.lag("content").over(w), F.lit(100)), F.lit(""))
    return c.withColumn("before", before).select("doc_id", "chunk", "before", (F.length("content") + F.length("before") <= 1800).alias("fits"))


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, {LINES_SQL} AS p FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, 1::BIGINT AS i, 0 AS chunk, length(p[1]) AS n FROM p WHERE len(p) > 0 UNION ALL
  SELECT r.doc_id, i + 1, CASE WHEN n < 200 AND n + 1 + length(p[i + 1]) <= 1000 THEN chunk ELSE chunk + 1 END, CASE WHEN n < 200 AND n + 1 + length(p[i + 1]) <= 1000 THEN n + 1 + length(p[i + 1]) ELSE length(p[i + 1]) END FROM r JOIN p USING (doc_id) WHERE i < len(p)),
k AS (SELECT doc_id, chunk, string_agg(p[i], ' ' ORDER BY i) AS content FROM r JOIN p USING (doc_id) GROUP BY doc_id, chunk)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1)::INT AS chunk, length(content) AS chars, md5(content) AS digest FROM k WHERE length(content) >= 50""")
def repaired_chunks(spark, d):
    """Lines below 200 characters joined with the next, what stays below 50 dropped."""
    return _digest(C.chunks(_docs(spark, d), C.merged(C.nonblank(F.split("text", "\n", -1)), 200, 1000)))


@query("""WITH s AS (SELECT page_id, regexp_replace(html, '(?i)<h[1-6][^>]*>', chr(10) || '# ', 'g') AS text FROM pages), l AS (SELECT page_id, list_filter(string_split(regexp_replace(text, '\\n# ', chr(1) || '# ', 'g'), chr(1)), lambda x: trim(x) <> '') AS p FROM s),
k AS (SELECT page_id, unnest(range(len(p))) AS i, p FROM l) SELECT page_id, i::INT AS chunk, length(p[i + 1]) AS chars, p[i + 1] LIKE '# %' AS headed FROM k""")
def heading_chunks(spark, d):
    """Pages cut at their headings."""
    text = F.regexp_replace("html", "(?i)<h[1-6][^>]*>", "\n# ")
    p = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text"))
    c = C.chunks(p, C.headed(F.col("text"), "# "))
    return c.select(F.col("doc_id").alias("page_id"), "chunk", F.length("content").alias("chars"), F.col("content").startswith("# ").alias("headed"))


@query("""WITH m AS (SELECT conv_id, string_agg('[' || lpad((turn // 2)::VARCHAR, 2, '0') || ':' || lpad((turn * 17 % 60)::VARCHAR, 2, '0') || '] ' || replace(coalesce(text, ''), chr(10), ' '), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, string_split(t, chr(10)) AS p FROM m), k AS (SELECT conv_id, unnest(range(len(p))) AS i, p FROM l)
SELECT conv_id, i::INT AS chunk, (split_part(substr(p[i + 1], 2, 5), ':', 1)::INT * 60 + split_part(substr(p[i + 1], 2, 5), ':', 2)::INT)::INT AS seconds, length(p[i + 1]) AS chars FROM k""")
def timestamp_chunks(spark, d):
    """Transcripts cut at their time stamps, read as seconds."""
    line = F.concat(
        F.lit("["), F.lpad(F.floor(F.col("turn") / 2).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("turn") * 17 % 60).cast("string"), 2, "0"), F.lit("] "),
        F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")),
    )
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    text = turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))
    c = C.chunks(text, C.headed(F.col("text"), r"\[\d\d:\d\d\]"))
    at = lambda k: F.regexp_extract("content", r"^\[(\d+):(\d+)\]", k).cast("int")
    return c.select(F.col("doc_id").alias("conv_id"), "chunk", (at(1) * 60 + at(2)).alias("seconds"), F.length("content").alias("chars"))


@query("""WITH w AS (SELECT doc_id, string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 150)) AS a FROM w) SELECT doc_id, (a // 150)::INT AS chunk, md5(array_to_string(w[a + 1:a + 200], ' ')) AS digest FROM s""")
def word_stride_chunks(spark, d):
    """Two hundred words, every 150 words."""
    w = _docs(spark, d).select("doc_id", F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    at = w.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(150))).alias("chunk", "a"))
    return at.select("doc_id", "chunk", F.md5(F.array_join(F.slice("w", F.col("a") + 1, F.lit(200)), " ")).alias("digest"))


@query("""WITH t AS (SELECT doc_id, source, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN n <= 1000 THEN 'single' WHEN source LIKE '%1' THEN 'timestamp' WHEN source LIKE '%2' THEN 'document' WHEN source LIKE '%3' THEN 'web' WHEN source LIKE '%4' THEN 'code' ELSE 'character' END AS strategy,
CASE WHEN n < 10000 THEN 1000 WHEN n < 100000 THEN 2000 ELSE 4000 END AS size, CASE WHEN n < 10000 THEN 100 WHEN n < 100000 THEN 200 ELSE 400 END AS overlap, n < 1000 AS fast_track FROM t""")
def chunk_configuration(spark, d):
    """The strategy by kind of content, and sizes by length."""
    n = F.length("text")
    ends = lambda x: F.col("source").endswith(x)
    kind = F.when(n <= 1000, "single").when(ends("1"), "timestamp").when(ends("2"), "document").when(ends("3"), "web").when(ends("4"), "code").otherwise("character")
    band = lambda a, b, c: F.when(n < 10_000, a).when(n < 100_000, b).otherwise(c)
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", kind.alias("strategy"), band(1000, 2000, 4000).alias("size"), band(100, 200, 400).alias("overlap"), (n < 1000).alias("fast_track"))


@query(f"""{packed_sql(LINES_SQL, 1500, chr(10) * 2)} SELECT doc_id, chunk::INT AS chunk, 'doc:' || doc_id || ':chunk:' || chunk AS chunk_id, substr(split_part(content, chr(10), 1), 1, 99) AS title, chunk // 3 + 1 AS page,
len(regexp_extract_all(content, '[0-9]+')) AS numbers FROM packed""")
def chunk_metadata(spark, d):
    """Ids, titles, pages and numbers of chunks."""
    c = C.chunks(_docs(spark, d), C.packed(C.nonblank(F.split("text", "\n", -1)), 1500, "\n\n"))
    ident = F.concat(F.lit("doc:"), "doc_id", F.lit(":chunk:"), "chunk")
    title = F.substring(F.substring_index("content", "\n", 1), 1, 99)
    numbers = F.regexp_count("content", F.lit("[0-9]+")).cast("long")
    return c.select("doc_id", "chunk", ident.alias("chunk_id"), title.alias("title"), (F.floor(F.col("chunk") / 3) + 1).cast("int").alias("page"), numbers.alias("numbers"))


@query("""WITH c AS (SELECT conv_id, turn, 'conv:' || conv_id || ':chunk:' || turn AS id FROM conversations) SELECT id, split_part(id, ':chunk:', 1) AS document_id, split_part(id, ':chunk:', 2)::INT AS chunk_index, regexp_matches(id, '^[a-z]+:[0-9]+:chunk:[0-9]+$') AS valid FROM c""")
def chunk_ids(spark, d):
    c = read(spark, d, "conversations").select(F.concat(F.lit("conv:"), "conv_id", F.lit(":chunk:"), "turn").alias("id"))
    part = lambda k: F.split("id", ":chunk:")[k]
    return c.select("id", part(0).alias("document_id"), part(1).cast("int").alias("chunk_index"), F.col("id").rlike("^[a-z]+:[0-9]+:chunk:[0-9]+$").alias("valid"))
