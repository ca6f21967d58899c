"""Which texts hold which names: a multi-pattern automaton over a dictionary that is cut into parts of bounded size.

The distinct names are dealt by a hash into parts of at most about ``part_names`` names and ``part_chars`` characters. Each
part is sent to the executors, which scan all texts with an automaton of it; so a text is scanned once a part, whatever the
number of names, and no text meets names that it does not hold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowmill.sources.shared import written

PART_NAMES, PART_CHARS = 200_000, 8_000_000
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(part) -> ahocorasick.Automaton:
    """The automaton of a broadcast list, built once in a worker; earlier parts' ones are dropped."""
    if part.value[0] not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for name in part.value[1]:
            a.add_word(name, name)
        a.make_automaton()
        _built[part.value[0]] = a
    return _built[part.value[0]]


def holding(texts: DataFrame, names: DataFrame, part_names: int = PART_NAMES, part_chars: int = PART_CHARS) -> DataFrame:
    """id, name_id: the texts (id, text) that hold a name (name_id, name), both in lower case. Empty names and null texts hold
    nothing; ids may repeat and are then returned once."""
    low = written(names.where(F.length("name") > 0).select("name_id", F.lower("name").alias("name")), "names")
    distinct = low.select("name").distinct()
    n, chars = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    parts = max(1, -(-n // part_names), -(-chars // part_chars))
    dealt = written(distinct.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts))), "dictionary")
    rows = texts.where("text is not null").select("id", F.lower("text").alias("text"))
    found = None
    for k in range(parts):
        # A hashed part is as large as the bound within a few percent.
        own = [r.name for r in dealt.where(F.col("part") == k).select("name").collect()]
        if not own:
            continue
        part = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, own))

        def scan(frames: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            a = _automaton(part)
            for f in frames:
                hits = [(i, name) for i, t in zip(f["id"], f["text"], strict=True) for name in {x for _, x in a.iter(t)}]
                yield pd.DataFrame(hits, columns=["id", "name"])

        some = rows.mapInPandas(scan, rows.select("id", F.col("text").alias("name")).schema)
        found = some if found is None else found.union(some)
    if found is None:
        return rows.join(low, F.lit(False)).select("id", "name_id")
    return found.join(low, "name").select("id", "name_id").distinct()
