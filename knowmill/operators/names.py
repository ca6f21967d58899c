"""Joins of like names that lose no pair and do not compare all of them.

Three ways in which two names can be alike each give an equi-join that every such pair meets in:

* one name holds the other: the shorter one's rarest run of three characters (all of it, if shorter) is one of the longer's;
* their edit distance is small: of the longer name cut into one more pieces than edits are allowed, one piece stands in the
  shorter, at most so many places off;
* their words overlap: among their rarest words, as many as the overlap leaves room for, one is shared.

Keys are made within blocks (a type, a family of types, a document), each with the similarity that it asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions import text as T
from knowmill.sources.shared import written

#: The similarity of a name and one that holds it.
HELD = 0.8
GRAM = 3


def _grams(name: Column, size: Column) -> Column:
    """All runs of ``size`` characters with their places."""
    places = F.sequence(F.lit(0), F.length(name) - size)
    return F.when(F.length(name) >= size, F.transform(places, lambda p: F.struct(F.substring(name, p + 1, size).alias("gram"), p.cast("int").alias("at"))))


def held(names: DataFrame) -> DataFrame:
    """a, b of names (id, block, name) of which b's holds a's or equals it; both in one block. Empty names hold nothing."""
    n = names.where("name <> ''")
    all_ = n.select("id", "block", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.transform(_grams(F.col("name"), F.lit(k)), lambda x: x["gram"]), F.array().cast("array<string>")) for k in range(1, GRAM + 1)])))).alias("gram"))
    often = all_.groupBy("block", "gram").agg(F.count("*").alias("often"))
    own = n.select("id", "block", "name", F.explode(_grams(F.col("name"), F.least(F.length("name"), F.lit(GRAM)))).alias("x")).select("id", "block", "name", "x.gram")
    rare = own.join(often.hint("merge"), ["block", "gram"]).groupBy("id", "block").agg(F.min(F.struct("often", "gram")).alias("x"), F.first("name").alias("name"))
    rare = rare.select(F.col("id").alias("a"), "block", F.col("x.gram").alias("gram"), F.length("name").alias("chars"))
    longer = all_.join(n.select("id", "block", F.length("name").alias("chars_b")).hint("merge"), ["id", "block"]).withColumnRenamed("id", "b")
    return rare.join(longer.hint("merge"), ["block", "gram"]).where("a <> b and chars <= chars_b").select("a", "b", "block")


def near(names: DataFrame) -> DataFrame:
    """a, b of names (id, block, least, name) whose edit similarity may reach ``least`` (above 0, the same within a block)."""
    n = names.where("name <> ''").withColumn("n", F.length("name"))
    edits = F.floor((1 - F.col("least")) * F.col("n") + 1e-9).cast("int")
    cut = lambda i: F.floor(i * F.col("n") / (F.col("edits") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("edits")), lambda i: F.struct(F.substring(F.col("name"), cut(i) + 1, cut(i + 1) - cut(i)).alias("gram"), cut(i).alias("at")))
    y = n.withColumn("edits", edits).where("edits < n").withColumn("x", F.explode(pieces)).select(F.col("id").alias("b"), "block", F.col("n").alias("m"), "edits", "x.gram", F.col("x.at").alias("at_b"))
    # A longer name's pieces may have these lengths.
    lengths = F.transform(F.sequence(F.col("n"), F.floor(F.col("n") / F.col("least") + 1e-9).cast("int")), lambda m: F.floor(m / (F.floor((1 - F.col("least")) * m + 1e-9) + 1)).cast("int"))
    sizes = F.filter(F.array_distinct(F.flatten(F.transform(lengths, lambda k: F.array(k, k + 1)))), lambda k: k > 0)
    grams = F.flatten(F.filter(F.transform(sizes, lambda k: _grams(F.col("name"), k)), lambda g: g.isNotNull()))
    x = n.withColumn("x", F.explode(F.array_distinct(grams))).select(F.col("id").alias("a"), "block", "n", "x.gram", "x.at")
    fits = (F.col("a") != F.col("b")) & (F.col("n") <= F.col("m")) & (F.col("m") - F.col("n") <= F.col("edits")) & (F.abs(F.col("at") - F.col("at_b")) <= F.col("edits"))
    return x.join(y, ["block", "gram"]).where(fits).select("a", "b", "block")


def worded(names: DataFrame) -> DataFrame:
    """a, b of names (id, block, least, name) the overlap of whose words may reach ``least``."""
    w = names.select("id", "block", "least", F.array_distinct(T.tokens(F.col("name"))).alias("words")).withColumn("word", F.explode("words"))
    often = w.groupBy("block", "word").agg(F.count("*").alias("often"))
    room = F.size("words") - F.ceil(F.col("least") * F.size("words") - 1e-9).cast("int") + 1
    ranked = w.withColumn("room", room).join(often, ["block", "word"]).groupBy("id", "block").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("ranked"), F.first("room").alias("room"))
    rare = ranked.select("id", "block", F.explode(F.slice("ranked", F.lit(1), F.col("room"))).alias("x")).select("id", "block", "x.word")
    return rare.withColumnRenamed("id", "a").join(rare.withColumnRenamed("id", "b"), ["block", "word"]).where("a < b").select("a", "b", "block")


def like(names: DataFrame) -> DataFrame:
    """Distinct a, b (a < b) of names (id, block, least, name) that may be alike to ``least`` in a block they share: of each
    two names whose similarity (1 equal, 0.8 one holding the other, else by words or edits) reaches it, none is lost. Empty
    names are like none."""
    n = written(names, "names")
    found = near(n).union(worded(n)).union(held(n.where(F.col("least") <= HELD).select("id", "block", "name")))
    out = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return written(out, "like")
