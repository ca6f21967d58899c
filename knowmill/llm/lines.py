"""Removal of lines that many documents share, as DataFrame expressions only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``least_chars`` code
points that stand in at least ``least_docs`` documents keep their lines in the document of the largest id only. Lines are
range-partitioned by a 128-bit hash of their key and sorted by document (largest first) and position; a stream over each
hash's lines finds the first document and counts the others. The result is no text but, for each document, a compressed
bitmap of the lines that stay: the lengths of alternate runs of kept and dropped lines, a (possibly empty) kept run first.

A hash that would fill more than a quarter of a partition (at most four for each partition, found by a sketch of frequent
items) is dealt by document over several ranges, and the ranges' counts are added; every line is judged alike.

Defined cases: a null or empty text is one empty line. Rows that repeat an id are one document when documents are counted,
and each row gets its own result; null ids are one document below all others. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, lower_ascii, release, stash, table

BLANK = " \t\n\x0b\f\r"
#: Letters beyond ASCII that lower() would change too.
OTHER_CAPITALS = r"[\x{80}-\x{10FFFF}&&[\p{IsUppercase}\p{Lt}]]"


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased; lower() does so faster where no other letter has a case to lose."""
    stripped = F.btrim(line, F.lit(BLANK))
    plain = (F.octet_length(stripped) == F.length(stripped)) | ~stripped.rlike(OTHER_CAPITALS)
    return F.when(plain, F.lower(stripped)).otherwise(lower_ascii(stripped))


def _named(docs: DataFrame) -> DataFrame:
    """doc, mark (a hash of the text, which tells rows of one id apart) and the text's lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("mark"), F.split(text, "\n", -1).alias("lines"))


def _long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row for each line that is long enough; n: lines of its document."""
    lines = _named(docs).select("doc", "mark", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.where(F.length(F.btrim("line", F.lit(BLANK))) >= least_chars).withColumn("key", line_key(F.col("line")))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(UPPER), "key").alias("h2"), "doc", "mark", "pos", "n")


def _frequent(lines: DataFrame) -> DataFrame:
    """h1 and the number of ranges for hashes that fill over a quarter of a partition; at most four for each partition."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = F.call_function("approx_top_k", F.col("h1"), F.lit(min(4 * parts, 100_000)), F.lit(min(32 * parts, 1_000_000)))
    found = lines.agg(top.alias("top"), F.count("*").alias("n")).select(F.explode("top").alias("x"), "n")
    ranges = F.ceil(4 * parts * F.col("x.count") / F.col("n"))
    return found.select(F.col("x.item").alias("h1"), ranges.alias("ranges")).where("ranges > 1")


def _dropped(lines: DataFrame, least_docs: int) -> DataFrame:
    """doc, mark, pos, n of the lines that go."""
    hot = F.broadcast(stash(_frequent(lines), "frequent"))
    cell = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("ranges")) + 1, F.lit(0))
    dealt = lines.join(hot, "h1", "left").withColumn("cell", cell)
    group, order = ["h1", "h2", "cell"], [F.desc_nulls_last("doc"), "mark", "pos"]
    sorted_ = dealt.repartitionByRange(*group).sortWithinPartitions(*group, *order)
    stream = Window.partitionBy(*group).orderBy(*order)
    other = ~F.col("doc").eqNullSafe(F.lag("doc").over(stream)) | (F.row_number().over(stream) == 1)
    seen = sorted_.withColumn("first_doc", F.first("doc").over(stream)).withColumn("other", other.cast("int"))
    seen = seen.withColumn("n_docs", F.sum("other").over(Window.partitionBy(*group)))
    by_doc = lines.join(hot, "h1", "left_semi").groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    over_ranges = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("all_docs"), F.max("doc").alias("last_doc"))
    seen = seen.join(F.broadcast(over_ranges), ["h1", "h2"], "left")
    first = F.when(F.col("all_docs").isNull(), F.col("first_doc")).otherwise(F.col("last_doc"))
    many = F.coalesce("all_docs", "n_docs") >= least_docs
    return seen.where(many & ~F.col("doc").eqNullSafe(first)).select("doc", "mark", "pos", "n")


def _runs(places: Column, n: Column) -> Column:
    """Run lengths of a bitmap of n lines whose dropped ones stand at the sorted places: kept, dropped, kept ..."""
    starts = F.filter(places, lambda p, i: (i == 0) | (F.get(places, F.greatest(i - 1, F.lit(0))) != p - 1))
    ends = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + 1), F.lit(-1)) != p + 1)
    edges = F.concat(F.flatten(F.zip_with(starts, ends, lambda s, e: F.array(s, e + 1))), F.array(n))
    return F.transform(edges, lambda e, i: e - F.when(i == 0, 0).otherwise(F.get(edges, F.greatest(i - 1, F.lit(0)))))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines that a bitmap of runs keeps, in their order."""
    bits = F.split(F.array_join(F.transform(runs, lambda n, i: F.repeat(F.when(i % 2 == 0, "1").otherwise("0"), n)), ""), "")
    return F.filter(lines, lambda x, i: F.get(bits, i) == "1")


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc, mark, n_dropped (long) and keep (array of run lengths), one row for each text that loses a line; all lines of
    the others stay. docs: doc_id, text."""
    lines = stash(_long_lines(docs, least_chars), "lines")
    places = _dropped(lines, least_docs).groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("places"), F.max("n").alias("n"))
    out = stash(places.select("doc", "mark", F.size("places").cast("long").alias("n_dropped"), _runs(F.col("places"), F.col("n")).alias("keep")), "keep")
    release(lines)
    return out


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped (long), keep_bitmap (array of run lengths), kept_text: one row for each row of docs."""
    maps = keep_bitmaps(docs, least_chars, least_docs).alias("m")
    rows = _named(docs).alias("d")
    both = rows.join(maps, F.col("d.doc").eqNullSafe(F.col("m.doc")) & (F.col("d.mark") == F.col("m.mark")), "left")
    n = F.size("lines")
    kept = F.when(F.col("keep").isNull(), F.col("lines")).otherwise(kept_lines(F.col("lines"), F.col("keep")))
    return both.select(
        F.col("d.doc").alias("doc_id"), n.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("keep", F.array(n)).alias("keep_bitmap"), F.array_join(kept, "\n").alias("kept_text"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), F.array_join("keep_bitmap", ",").alias("keep_bitmap"))


ORACLE = {
    "op13_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN often USING (key)),
j AS (SELECT *, gone <> coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS turns FROM m),
r AS (SELECT *, sum(turns::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM j),
s AS (SELECT doc_id, run, count(*)::INT AS size FROM r GROUP BY ALL),
b AS (SELECT doc_id, CASE WHEN min(run) = 1 THEN list_prepend(0, list(size ORDER BY run)) ELSE list(size ORDER BY run) END AS runs, max(run) AS last_run FROM s GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256,
  array_to_string(any_value(CASE WHEN last_run % 2 = 1 THEN list_append(runs, 0) ELSE runs END), ',') AS keep_bitmap
FROM m JOIN b USING (doc_id) GROUP BY doc_id""",
}
