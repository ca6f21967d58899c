"""URL rules with redirect equivalence.

Each page's url gets the verdict of the longest rule that fits its host and path. Pages without a rule take the
decision of their alias class: the connected component over redirect edges (meta refresh), canonical links and the
url without tracking parameters. Relative targets are resolved against the page's url, and both ends are spelled alike
(``normal``) before they meet. In a class an explicit allow precedes a block; a class without either is allowed.
Components are found by Spark jobs; nothing is collected.

A null url, or one without ``://``, has an empty host and path, fits no rule and has no aliases. Null html has no links.
Rows that repeat a page_id or url stay and share a class. Extra columns stay, but for those named as the added ones. Empty tables give
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, components, lower_ascii, release, stash, table

#: (verdict, host, path) of the registered query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Query parameters that do not change what a url names.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.when(url.contains("://"), rest).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict; rules are few and given by the caller."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), h + p, v) for v, h, p in ordered]
    pick = lambda k: reduce(lambda c, f: c.when(f[0], f[k]), fits[1:], F.when(fits[0][0], fits[0][k]))
    return pick(1), pick(2)


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its segments ``.`` and ``..``."""
    parts = F.slice(F.split(path, "/", -1), F.lit(2), F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    # A last segment of dots leaves its slash.
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    kept = F.array_join(F.aggregate(parts, none, step), "/")
    return F.concat(F.lit("/"), kept, F.when(kept == "", "").otherwise(closed))


def resolve(url: Column, target: Column) -> Column:
    """target as a whole url, read on the page ``url``, with &amp; decoded (RFC 3986, 5.2)."""
    t = F.regexp_replace(target, r"(?i)&(?:amp|#38|#x26);", "&")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    own, rest = F.regexp_extract(t, r"(?s)^([^?#]*)", 1), F.regexp_extract(t, r"(?s)^[^?#]*(.*)$", 1)
    joined = F.when(t.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when((t == "") | t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("#"), F.concat(F.substring_index(url, "#", 1), t))
        .when(t.startswith("?"), F.concat(site, path, t))
        .otherwise(F.concat(site, F.when(joined.rlike(r"/\.\.?(/|$)"), without_dots(joined)).otherwise(joined), rest))
    )


def normal(url: Column) -> Column:
    """One spelling of urls that name the same page: scheme and host in lower case, no fragment, no port that the scheme
    implies, and a slash where there is no path."""
    site = F.lower(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1))
    site = F.regexp_replace(site, r"^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(site, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v) of normal urls that name one resource. Comments and scripts hold no links, and a base element moves the
    place that relative links start from."""
    has = lambda x: F.coalesce(F.lower("html").contains(x), F.lit(False))
    some = has("canonical") | has("refresh")
    pages = pages.select("url", F.when(some, F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", " ")).alias("html"))
    tag = lambda p: F.regexp_extract("html", p, 1)
    bare = F.regexp_replace(F.substring_index("url", "#", 1), rf"(?i)(?<=[?&]){TRACKING}=[^&]*&?", "")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    rel = r"rel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"
    href = r"href\s*=\s*[\"']?([^\"'\s>]+)"
    canonical = F.coalesce(F.nullif(tag(rf"(?is)<link\s(?:[^>]*?\s)?{rel}[^>]*?\s{href}"), F.lit("")), tag(rf"(?is)<link\s(?:[^>]*?\s)?{href}[^>]*?\s{rel}"))
    refresh = F.coalesce(F.nullif(tag(r"(?is)<meta\s[^>]*http-equiv=[\"']?refresh[^>]*?url=['\"]?([^\"'\s>]+)"), F.lit("")), tag(r"(?is)<meta\s[^>]*?[\s;\"']url=['\"]?([^\"'\s>]+)[^>]*?http-equiv=[\"']?refresh"))
    base = F.coalesce(F.nullif(tag(rf"(?is)<base\s(?:[^>]*?\s)?{href}"), F.lit("")), F.lit(""))
    start = F.when(base == "", F.col("url")).otherwise(resolve(F.col("url"), base))
    pages = pages.withColumn("start", F.when(start.contains("://"), start).otherwise(F.col("url")))
    whole = lambda c: F.when(F.coalesce(c, F.lit("")) != "", resolve(F.col("start"), c))
    targets = F.array(bare, whole(canonical), whole(refresh))
    edges = pages.where(F.col("url").contains("://")).select(F.col("url").alias("u"), F.explode(targets).alias("v"))
    edges = edges.where(F.col("v").contains("://")).select(normal(F.col("u")).alias("u"), normal(F.col("v")).alias("v"))
    return edges.where(F.col("u") != F.col("v")).distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages: url, html. Adds host, path, rule, verdict and alias (the class's least url)."""
    return beside(pages, {"url": "url", "html": "html"}, ["host", "path", "rule", "verdict", "alias"], lambda x: _judge(x, rules))


def _judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    host, path = host_path(F.coalesce(F.col("url"), F.lit("")))
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule, own = rule_for(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule)
    links = stash(link_edges(pages), "links")
    aliases = stash(components(links), "aliases")
    release(links)
    # Decisions of classes, from pages and from linked urls that no page has.
    named_host, named_path = host_path(F.col("node"))
    _, named = rule_for(named_host, named_path, rules)
    decided = aliases.withColumn("own", named).groupBy("component").agg(F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
    classes = stash(aliases.join(decided, "component"), "classes").toDF("_alias", "_node", "_allow", "_block")
    out = pages.withColumn("_own", own).withColumn("_url", F.when(F.col("url").contains("://"), normal(F.col("url"))))
    out = out.join(classes, F.col("_url") == F.col("_node"), "left")
    by_class = F.when(F.col("_allow"), "allow").when(F.col("_block"), "block").otherwise("allow")
    out = out.withColumn("verdict", F.coalesce("_own", by_class)).withColumn("alias", F.col("_alias"))
    return out


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "alias")
