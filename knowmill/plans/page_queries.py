"""Queries over raw pages and over texts that are cut by structure."""

from pyspark.sql import functions as F

from knowmill.operators import chunking as C
from knowmill.operators import html as H
from knowmill.operators import markdown as M
from knowmill.plans.registry import query
from knowmill.sources.tables import read

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BLANK = "[ \\t\\n\\x0B\\f\\r]"


def descended_sql(size: int) -> str:
    """The descent as one step a level. DuckDB has no look-around: a mark is put where a piece may be cut."""
    marks = (
        (f"regexp_replace(x, '\\n(##{BLANK})', chr(1) || '\\1', 'g')", "chr(10) || chr(10)", 2), ("replace(x, chr(10) || chr(10), chr(1))", "chr(10) || chr(10)", 2),
        (f"regexp_replace(x, '([.!?]){BLANK}+', '\\1' || chr(1), 'g')", "' '", 1), (f"regexp_replace(x, '{BLANK}+', chr(1), 'g')", "' '", 1),
    )
    steps = [f"l0 AS (SELECT doc_id, [text] AS p FROM documents WHERE text IS NOT NULL AND trim(text, {SPACES}) <> '')"]
    for i, (mark, sep, n) in enumerate(marks):
        parts = f"list_filter(list_transform(string_split({mark}, chr(1)), lambda y: trim(y, {SPACES})), lambda y: y <> '')"
        fits = f"length(a[-1]) + {n} + length(b[1]) <= {size}"
        pack = f"list_reduce(list_transform({parts}, lambda y: [y]), lambda a, b: CASE WHEN {fits} THEN list_append(a[1:len(a) - 1], a[-1] || {sep} || b[1]) ELSE list_concat(a, b) END)"
        steps.append(f"l{i + 1} AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {size} THEN [x] ELSE {pack} END)) AS p FROM l{i})")
    return f"WITH {', '.join(steps)}, d AS (SELECT doc_id, unnest(p) AS content, unnest(range(len(p)))::INT AS chunk FROM l4)"


@query(f"{descended_sql(600)} SELECT doc_id, chunk, length(trim(content, {SPACES})) AS chars, md5(trim(content, {SPACES})) AS digest FROM d")
def descended_chunks(spark, d):
    """Documents cut into pieces of 600 characters: by sections, then paragraphs, then sentences, then words."""
    docs = read(spark, d, "documents").where(F.btrim("text", F.lit(" \t\n\x0b\f\r")) != "")
    out = C.chunks(docs, C.descended(F.col("text"), 600))
    return out.select("doc_id", "chunk", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _attribute_sql(name: str) -> str:
    p = f"(?i)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))"
    return "CASE WHEN kind = 'open' THEN " + " || ".join(f"regexp_extract(token, '{p}', {k})" for k in (1, 2, 3)) + " END"


_FITS = [f"name = '{s}'" if s[0] not in "[.#" else "role = 'main'" if s[0] == "[" else f"list_contains(classes, '{s[1:]}')" if s[0] == "." else f"ident = '{s[1:]}'" for s in H.MAIN]
ELEMENTS_SQL = f"""a AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{H.TOKENS}') AS ts FROM pages),
b AS (SELECT page_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM a),
c AS (SELECT *, lower(regexp_extract(token, '{H.TAG}', 1)) AS tag, regexp_matches(token, '{H.WHOLE}') AS whole FROM b),
k AS (SELECT page_id, pos, token, CASE WHEN whole THEN 'none' WHEN tag = '' THEN 'text' WHEN tag IN ({_in(H.VOID)}) OR token LIKE '%/>' THEN 'none' WHEN token LIKE '</%' THEN 'close' ELSE 'open' END AS kind,
  CASE WHEN kind IN ('open', 'close') THEN tag END AS name FROM c),
t AS (SELECT *, regexp_split_to_array(coalesce({_attribute_sql("class")}, ''), '\\s+') AS classes, {_attribute_sql("id")} AS ident, {_attribute_sql("role")} AS role FROM k),
l AS (SELECT *, CASE WHEN name IN ({_in(H.FLAT)}) THEN 0 ELSE sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, name ORDER BY pos) + (kind = 'close')::INT END AS level,
  (kind = 'open' AND (name IN ({_in(H.NOISE_TAGS)}) OR len(list_intersect(classes, [{_in(H.NOISE_CLASSES)}])) > 0 OR ident IN ({_in(H.NOISE_IDS)})))::INT AS noise FROM t),
n AS (SELECT *, noise - CASE WHEN name IS NULL THEN 0 ELSE coalesce(lag(noise) OVER (PARTITION BY page_id, name, level ORDER BY pos), 0) END AS change FROM l),
r AS (SELECT *, sum(change) OVER (PARTITION BY page_id ORDER BY pos) > 0 AS removed FROM n),
s AS (SELECT *, sum(CASE WHEN kind = 'text' AND NOT removed THEN length(token) ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS so_far FROM r),
e AS (SELECT *, coalesce(lead(pos) OVER w, 2147483647) AS stop, coalesce(lead(so_far) OVER w, max(so_far) OVER (PARTITION BY page_id)) - so_far AS chars FROM s WINDOW w AS (PARTITION BY page_id, name, level ORDER BY pos)),
f AS (SELECT *, CASE {" ".join(f"WHEN {x} THEN {i}" for i, x in enumerate(_FITS))} END AS rank FROM e WHERE kind = 'open' AND NOT removed),
o AS (SELECT page_id, pos, stop, row_number() OVER (PARTITION BY page_id ORDER BY rank IS NULL, rank, name NOT IN ({_in(H.BLOCKS)}), CASE WHEN name IN ({_in(H.BLOCKS)}) THEN -chars END, pos) AS rn,
  CASE WHEN rank IS NOT NULL THEN [{_in(H.MAIN)}][rank + 1] WHEN name IN ({_in(H.BLOCKS)}) THEN 'largest block' ELSE 'body' END AS part FROM f WHERE rank IS NOT NULL OR name IN ({_in(H.BLOCKS)}) OR name = 'body')"""


@query(f"""WITH {ELEMENTS_SQL} SELECT p.page_id, coalesce(any_value(part), 'page') AS part,
  trim(regexp_replace(coalesce(string_agg(token, ' ' ORDER BY e.pos) FILTER (kind = 'text' AND NOT removed AND e.pos > coalesce(o.pos, -1) AND e.pos < coalesce(o.stop, 2147483647)), ''), '{BLANK}+', ' ', 'g')) AS content
FROM pages p LEFT JOIN e USING (page_id) LEFT JOIN o ON o.page_id = p.page_id AND o.rn = 1 GROUP BY p.page_id""")
def main_block(spark, d):
    """The main text of each page by nested elements, without navigation, notices and other noise."""
    return H.main_text(read(spark, d, "pages"))


MARKDOWN_SQL = """m AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), '<[^>]*>', chr(10), 'g') AS body FROM pages),
t AS (SELECT page_id, url, title, body, CASE page_id % 3 WHEN 0 THEN '# ' || title || chr(10) || chr(10) || '## Page Information' || chr(10) || '- **Source Url**: ' || url || chr(10) || '- **Format**: html' || chr(10) || chr(10) || '## Content' || chr(10) || chr(10) || body
  WHEN 1 THEN '---' || chr(10) || 'url: "' || url || '"' || chr(10) || 'kind: page' || chr(10) || '---' || chr(10) || body ELSE '# ' || title || chr(10) || '## File details' || chr(10) || 'size: 3' || chr(10) || '## Other details' || chr(10) || 'x' || chr(10) || '## Text' || chr(10) || body END AS text FROM m)"""


def _markdown(spark, d):
    """Pages as markdown of three forms."""
    p = read(spark, d, "pages")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(F.regexp_extract("html", r"(?is)<article[^>]*>(.*)</article>", 1), "<[^>]*>", "\n")
    told = F.concat(F.lit("# "), title, F.lit("\n\n## Page Information\n- **Source Url**: "), "url", F.lit("\n- **Format**: html\n\n## Content\n\n"), body)
    front = F.concat(F.lit('---\nurl: "'), "url", F.lit('"\nkind: page\n---\n'), body)
    other = F.concat(F.lit("# "), title, F.lit("\n## File details\nsize: 3\n## Other details\nx\n## Text\n"), body)
    return p.select("page_id", F.when(F.col("page_id") % 3 == 0, told).when(F.col("page_id") % 3 == 1, front).otherwise(other).alias("text"))


@query(f"""WITH {MARKDOWN_SQL}, l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM t),
k AS (SELECT *, {" OR ".join(f"contains(lower(line), '{x}')" for x in M.LINE_MARKS)} AS mark, line LIKE '## %' AND ({" OR ".join(f"contains(lower(line), '{x}')" for x in M.ABOUT)}) AS about,
  line LIKE '## %' AND ({" OR ".join(f"contains(lower(line), '{x}')" for x in M.CONTENT)}) AS own FROM l),
s AS (SELECT *, last_value(CASE WHEN mark THEN NULL WHEN about THEN TRUE WHEN own THEN FALSE END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS skip FROM k)
SELECT page_id, md5(trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT mark AND NOT about AND NOT own AND NOT coalesce(skip, FALSE) AND NOT regexp_matches(line, '^\\s*[-*]\\s*\\*\\*[^:]+\\*\\*:\\s*')), ''), {SPACES})) AS digest FROM s GROUP BY page_id""")
def without_metadata(spark, d):
    """Markdown without lines and parts about the file."""
    return _markdown(spark, d).select("page_id", F.md5(M.without_metadata(F.col("text"))).alias("digest"))


@query(f"""WITH {MARKDOWN_SQL} SELECT page_id, CASE page_id % 3 WHEN 2 THEN NULL ELSE url END AS url, (CASE page_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END)::INT AS n, CASE page_id % 3 WHEN 1 THEN NULL ELSE trim(title, {SPACES}) END AS title,
  md5(CASE page_id % 3 WHEN 2 THEN CASE WHEN trim(body, {SPACES}) = '' THEN text ELSE trim(body, {SPACES}) END ELSE body END) AS digest FROM t""")
def split_headers(spark, d):
    """Metadata and content of markdown with front matter, with an information part, and without."""
    h = _markdown(spark, d).select("page_id", M.split_header(F.col("text")).alias("h"))
    get = lambda k: F.try_element_at(F.col("h.metadata"), F.lit(k))
    return h.select("page_id", F.coalesce(get("source_url"), get("url")).alias("url"), F.size("h.metadata").alias("n"), get("title").alias("title"), F.md5("h.content").alias("digest"))


def _pack(parts: str, sep: str, n: int, size: int) -> str:
    fits = f"length(a[-1]) + {n} + length(b[1]) <= {size}"
    return f"CASE WHEN len({parts}) = 0 THEN [] ELSE list_reduce(list_transform({parts}, lambda y: [y]), lambda a, b: CASE WHEN {fits} THEN list_append(a[1:len(a) - 1], a[-1] || {sep} || b[1]) ELSE list_concat(a, b) END) END"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda y: y <> '')"


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"


@query(f"""{descended_sql(500)}, o AS (SELECT doc_id, list_transform(p, lambda x: trim(x, {SPACES})) AS p FROM l4),
q AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM o), r AS (SELECT doc_id, i, p[i] AS piece, p[i - 1] AS prev, right(p[i - 1], 80) AS tail FROM q),
s AS (SELECT *, CASE WHEN strpos(tail, ' ') > 1 THEN substr(tail, strpos(tail, ' ') + 1) ELSE tail END || ' ' || piece AS whole FROM r)
SELECT doc_id, (i - 1)::INT AS chunk, md5(CASE WHEN i = 1 OR length(prev) <= 80 OR length(whole) > 600 THEN piece ELSE whole END) AS digest FROM s""")
def overlapped_chunks(spark, d):
    """Pieces of 500 characters with up to 80 characters of the piece before."""
    docs = read(spark, d, "documents").where(F.btrim("text", F.lit(" \t\n\x0b\f\r")) != "")
    # The pieces are a column of their own, so that they are not made anew for each of them.
    cut = docs.select("doc_id", C.descended(F.col("text"), 500).alias("pieces"))
    return C.chunks(cut, C.overlapped(F.col("pieces"), 80, 500)).select("doc_id", "chunk", F.md5("content").alias("digest"))


_MERGED = f"""CASE WHEN len({_LINES}) = 0 THEN [] ELSE list_filter(list_reduce(list_transform({_LINES}, lambda y: [y]), lambda a, b: CASE WHEN length(a[-1]) < 100 AND length(a[-1]) + 1 + length(b[1]) <= 400
  THEN list_append(a[1:len(a) - 1], a[-1] || ' ' || b[1]) ELSE list_concat(a, b) END), lambda x: length(x) >= 50) END"""
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(x, '([.!?]){BLANK}+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, {SPACES})), lambda y: y <> '')"


@query(f"""WITH m AS (SELECT doc_id, {_MERGED} AS p FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 400 THEN [x] ELSE {_pack(_SENTENCES, "' '", 1, 400)} END)) AS p FROM m),
b AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 400 THEN [x] ELSE {_pack(_words("x"), "' '", 1, 400)} END)) AS p FROM a)
SELECT doc_id, unnest(range(len(p)))::INT AS chunk, md5(unnest(p)) AS digest FROM b""")
def sized_chunks(spark, d):
    """Lines merged below 100 characters and cut above 400."""
    docs = read(spark, d, "documents").where("text is not null")
    return C.chunks(docs, C.sized(C.nonblank(F.split("text", "\n", -1)), 100, 400)).select("doc_id", "chunk", F.md5("content").alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS p FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(list_transform(p, lambda y: [y]), lambda a, b: CASE WHEN length(a[-1]) + length(b[1]) > 700 THEN list_append(a, array_to_string({_words("a[-1]")}[-10:], ' ') || ' ' || b[1])
  ELSE list_append(a[1:len(a) - 1], a[-1] || chr(10) || chr(10) || b[1]) END) AS p FROM l WHERE len(p) > 0),
g AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 700 THEN [x] ELSE {_pack(_words("x"), "' '", 1, 700)} END)) AS p FROM f)
SELECT doc_id, unnest(range(len(p)))::INT AS chunk, md5(unnest(p)) AS digest FROM g""")
def carried_chunks(spark, d):
    """Lines packed to 700 characters, each chunk behind the last ten words of the one before."""
    docs = read(spark, d, "documents").where("text is not null")
    return C.chunks(docs, C.carried(C.nonblank(F.split("text", "\n", -1)), 700, 10)).select("doc_id", "chunk", F.md5("content").alias("digest"))


@query(f"""WITH t AS (SELECT conv_id, string_agg(CASE turn % 3 WHEN 0 THEN '[Page ' || turn || ']' WHEN 1 THEN chr(12) ELSE '<!-- page 7 -->' END || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_filter(list_transform(string_split(regexp_replace(text, '\\[Page \\d+\\]|\\f|<!-- page \\d+ -->', chr(1), 'g'), chr(1)), lambda x: trim(x, {SPACES})), lambda x: x <> '') AS p FROM t)
SELECT conv_id, unnest(range(1, len(p) + 1))::INT AS page, md5(unnest(p)) AS digest FROM p""")
def page_chunks(spark, d):
    """Pages of texts with page marks, blank ones left out."""
    c = read(spark, d, "conversations")
    mark = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[Page "), "turn", F.lit("]"))).when(F.col("turn") % 3 == 1, "\f").otherwise("<!-- page 7 -->")
    rows = c.select("conv_id", F.struct("turn", "role", F.concat(mark, F.coalesce("text", F.lit(""))).alias("t")).alias("x"))
    t = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))
    return t.select("conv_id", F.posexplode(C.paged(F.col("text"))).alias("i", "p")).select("conv_id", (F.col("i") + 1).alias("page"), F.md5("p").alias("digest"))
