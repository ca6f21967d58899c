"""The main text of raw HTML: a tag stack as running sums over each page's tokens.

A page is cut into tags, texts and whole scripts, styles and comments. The open tags of one name are a stack whose depth is
a running sum, so an element ends at the next token of its name and depth; elements of names that do not nest (paragraphs,
list items, cells) end at the next tag of their name, and one that is never closed at the end of the page. A running sum of
removed elements that are open tells which texts go, and a running sum of the others' lengths gives each element's text
length as a difference. All windows are within a page, so a page's tokens are dealt once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowmill.sources.shared import dealt

TOKENS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+|<"
WHOLE = r"(?i)^<(!|\?|script\b|style\b|noscript\b)"
TAG = r"^</?([A-Za-z][A-Za-z0-9-]*)"
#: Elements without content, elements that do not nest, what is removed, and where main content stands, best first.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
FLAT = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
NOISE_TAGS = ("nav", "header", "footer")
NOISE_CLASSES = (
    "navigation", "nav", "navbar", "footer", "ad", "ads", "advertisement", "banner", "cookie-notice", "popup", "modal", "sidebar", "widget", "social-media", "share", "sharing",
    "related-posts", "comments", "comment-form",
)
NOISE_IDS = ("nav", "menu", "footer", "comments")
MAIN = ("main", "article", '[role="main"]', ".content", ".main-content", ".post-content", "#content", "#main-content", "#post-content")
BLOCKS = ("div", "section", "article")
#: Characters of HTML that count as a row where tokens are dealt: a task sorts them several times.
CHARS = 8


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or bare; empty where there is none."""
    p = rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, p, k) for k in (1, 2, 3)])


def fits(selector: str, name: Column, classes: Column, ident: Column, role: Column) -> Column:
    if selector.startswith("["):
        return role == "main"
    return F.array_contains(classes, selector[1:]) if selector[0] == "." else ident == selector[1:] if selector[0] == "#" else name == selector


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, token, kind (open, close, text or none) and an open tag's name, classes, id, role."""
    t = pages.select("page_id", F.posexplode_outer(F.regexp_extract_all("html", F.lit(TOKENS), F.lit(0))).alias("pos", "token"))
    t = t.withColumn("token", F.coalesce("token", F.lit("")))
    name = F.lower(F.regexp_extract("token", TAG, 1))
    whole, token = F.col("token").rlike(WHOLE), F.col("token")
    kind = F.when(whole, "none").when(name == "", "text").when(name.isin(*VOID) | token.endswith("/>"), "none").when(token.startswith("</"), "close").otherwise("open")
    t = t.withColumn("kind", kind).withColumn("name", F.when(F.col("kind").isin("open", "close"), name))
    is_open = F.col("kind") == "open"
    of = lambda a: F.when(is_open, attribute(token, a))
    return t.withColumn("classes", F.split(F.coalesce(of("class"), F.lit("")), r"\s+")).withColumn("ident", of("id")).withColumn("role", of("role"))


def elements(pages: DataFrame) -> DataFrame:
    """Tokens with ``removed`` and, for open tags, ``stop`` (the place of their end) and ``chars`` (text that stays in them)."""
    chars = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    t = dealt(tokens(pages), chars // CHARS, "page_id")
    page = Window.partitionBy("page_id").orderBy("pos")
    is_open = F.col("kind") == "open"
    depth = F.sum(F.when(is_open, 1).when(F.col("kind") == "close", -1).otherwise(0)).over(Window.partitionBy("page_id", "name").orderBy("pos"))
    t = t.withColumn("level", F.when(F.col("name").isin(*FLAT), 0).otherwise(depth + F.when(F.col("kind") == "close", 1).otherwise(0)))
    pair = Window.partitionBy("page_id", "name", "level").orderBy("pos")
    noise = is_open & (F.col("name").isin(*NOISE_TAGS) | F.arrays_overlap("classes", F.array(*map(F.lit, NOISE_CLASSES))) | F.col("ident").isin(*NOISE_IDS))
    t = t.withColumn("noise", F.when(F.col("name").isNotNull() & F.coalesce(noise, F.lit(False)), 1).otherwise(0))
    change = F.col("noise") - F.when(F.col("name").isNull(), 0).otherwise(F.coalesce(F.lag("noise").over(pair), F.lit(0)))
    t = t.withColumn("change", change).withColumn("removed", F.sum("change").over(page) > 0)
    t = t.withColumn("so_far", F.sum(F.when((F.col("kind") == "text") & ~F.col("removed"), F.length("token")).otherwise(0)).over(page))
    all_ = F.max("so_far").over(Window.partitionBy("page_id"))
    t = t.withColumn("all_chars", all_).withColumn("stop", F.when(is_open, F.lead("pos").over(pair)))
    return t.withColumn("chars", F.when(is_open, F.coalesce(F.lead("so_far").over(pair), F.col("all_chars")) - F.col("so_far")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, part (what was chosen), content: the text of the first element that fits the best selector, else of the
    largest block, else of the body, else of the page, without what is removed; white space is one space."""
    t = elements(pages)
    shape = [F.col(c) for c in ("name", "classes", "ident", "role")]
    best = F.coalesce(*[F.when(fits(s, *shape), i) for i, s in enumerate(MAIN)])
    stop = F.coalesce("stop", F.lit(2**31 - 1)).alias("stop")
    alive = (F.col("kind") == "open") & ~F.col("removed")
    whole = Window.partitionBy("page_id")
    t = t.withColumn("named", F.min(F.when(alive & best.isNotNull(), F.struct(best.alias("rank"), "pos", stop))).over(whole))
    t = t.withColumn("block", F.min(F.when(alive & F.col("name").isin(*BLOCKS), F.struct((-F.col("chars")).alias("minus"), "pos", stop))).over(whole))
    t = t.withColumn("body", F.min(F.when(alive & (F.col("name") == "body"), F.struct("pos", stop))).over(whole))
    pick = lambda f, none: F.coalesce(F.col(f"named.{f}"), F.col(f"block.{f}"), F.col(f"body.{f}"), F.lit(none))
    part = F.when(F.col("named").isNotNull(), F.element_at(F.array(*map(F.lit, MAIN)), F.col("named.rank") + 1)).when(F.col("block").isNotNull(), "largest block")
    part = part.when(F.col("body").isNotNull(), "body").otherwise("page")
    inside = (F.col("pos") > pick("pos", -1)) & (F.col("pos") < pick("stop", 2**31 - 1))
    kept = F.when((F.col("kind") == "text") & ~F.col("removed") & inside, F.col("token"))
    out = t.select("page_id", "pos", part.alias("part"), kept.alias("token")).groupBy("page_id")
    out = out.agg(F.first("part").alias("part"), F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token")))).alias("texts"))
    text = F.array_join(F.transform("texts", lambda x: x["token"]), " ")
    return out.select("page_id", "part", F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), F.lit(" ")).alias("content"))
