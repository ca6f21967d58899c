"""Headers and metadata lines of markdown, by folds over a text's lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a line as metadata, and words of headings that begin and end a part without content.
LINE_MARKS = (
    "duration:", "resolution:", "frame rate:", "codec:", "audio codec:", "file size:", "format:", "created:", "modified:", "author:", "video information", "file information", "metadata:",
    "available in formats:", "uses codec:", "has duration:", "has resolution:", "has frame rate:", "has audio codec:",
)
ABOUT = ("information", "metadata", "properties", "details", "file info")
CONTENT = ("content", "transcript", "text", "body", "summary")
PAIR = r"^\s*[-*]\s*\*\*[^:]+\*\*:\s*"
BLANKS = " \t\n\x0b\f\r"


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def _last(entries: Column) -> Column:
    """Entries (key, value) without those whose key comes again."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))


def without_metadata(text: Column) -> Column:
    """The text without lines of metadata, key-value items and the parts under headings about the file; a heading of content
    ends such a part, and goes too."""

    def step(a: Column, line: Column) -> Column:
        low, heading = F.lower(line), line.startswith("## ")
        mark, about, content = _holds(low, LINE_MARKS), heading & _holds(low, ABOUT), heading & _holds(low, CONTENT)
        skip = F.when(mark, a["skip"]).when(about, True).when(content, False).otherwise(a["skip"])
        drop = mark | about | content | a["skip"] | line.rlike(PAIR)
        return F.struct(skip.alias("skip"), F.when(drop, a["kept"]).otherwise(F.concat(a["kept"], F.array(line))).alias("kept"))

    first = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))
    return F.btrim(F.aggregate(F.split(text, "\n", -1), first, step, lambda a: F.array_join(a["kept"], "\n")), F.lit(BLANKS))


def _front_matter(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, "---\n", 3)
    pairs = F.filter(F.split(F.btrim(F.get(parts, F.lit(1)), F.lit(BLANKS)), "\n"), lambda x: x.contains(":"))
    clean = lambda x: F.btrim(F.btrim(x, F.lit(BLANKS)), F.lit("\"'"))
    entry = lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1), F.lit(BLANKS)).alias("key"), clean(F.substr(x, F.instr(x, ":") + 1)).alias("value"))
    return F.transform(pairs, entry), F.get(parts, F.lit(2))


def _sections(text: Column) -> tuple[Column, Column]:
    """Title and items of the information part, and the content part (else all parts but those about the file)."""
    lines = F.split(text, "\n", -1)
    place = lambda test, after=0: F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(x) & (i > after), i)), lambda i: i.isNotNull())), F.lit(-1))
    heading = lambda x: x.startswith("## ")
    own = lambda x: heading(x) & ~x.contains("Information") & (x.contains("Content") | x.contains("Transcript"))
    content = place(own)
    # The last information part ahead of the content.
    info = F.coalesce(F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(heading(x) & x.contains("Information") & ((content < 0) | (i < content)), i)), lambda i: i.isNotNull())), F.lit(-1))
    stop = F.coalesce(F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(BLANKS)).startswith("## ") & (i > info), i)), lambda i: i.isNotNull())), F.size(lines))
    items = F.when(info > 0, F.slice(lines, info + 2, F.greatest(stop - info - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    items = F.transform(items, lambda x: F.btrim(x, F.lit(BLANKS)))
    items = F.filter(items, lambda x: x.startswith("- **") & (F.instr(F.substr(x, F.lit(5)), "**:") > 1))
    key = lambda x: F.substr(x, F.lit(5), F.instr(F.substr(x, F.lit(5)), "**:") - 1)
    entry = lambda x: F.struct(F.replace(F.lower(F.btrim(key(x), F.lit(BLANKS))), F.lit(" "), F.lit("_")).alias("key"), F.btrim(F.substr(x, F.length(key(x)) + 8), F.lit(BLANKS)).alias("value"))
    title = F.struct(F.lit("title").alias("key"), F.btrim(F.substr(F.get(lines, F.lit(0)), F.lit(3)), F.lit(BLANKS)).alias("value"))

    def step(a: Column, line: Column) -> Column:
        low = F.lower(line)
        about, text_ = heading(line) & _holds(low, ABOUT[:4]), heading(line) & _holds(low, CONTENT[:4])
        skip = F.when(about, True).when(text_, False).otherwise(a["skip"])
        return F.struct(skip.alias("skip"), F.when(about | text_ | a["skip"], a["kept"]).otherwise(F.concat(a["kept"], F.array(line))).alias("kept"))

    first = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))
    rest = F.btrim(F.aggregate(F.slice(lines, F.lit(2), F.size(lines)), first, step, lambda a: F.array_join(a["kept"], "\n")), F.lit(BLANKS))
    body = F.array_join(F.slice(lines, content + 3, F.size(lines)), "\n")
    return F.concat(F.array(title), F.transform(items, entry)), F.when(content > 0, body).otherwise(F.when(rest == "", text).otherwise(rest))


def split_header(text: Column) -> Column:
    """metadata (a map) and content: of front matter between lines of three dashes, of a title with an information part, or
    no metadata and the whole text. Of repeated keys the last counts."""
    front, after = _front_matter(text)
    titled, body = _sections(text)
    has_front = text.startswith("---\n") & (F.size(F.split(text, "---\n", 3)) >= 3)
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.when(has_front, front).when(text.startswith("# "), titled).otherwise(none)
    return F.struct(F.map_from_entries(_last(entries)).alias("metadata"), F.when(has_front, after).when(text.startswith("# "), body).otherwise(text).alias("content"))
