"""A store of several tables that batches are published to as a whole.

A batch's tables are first staged in a folder of the batch. References are checked on the staged tables; only if all hold is
the batch published, by one file that is moved into place. Readers see the batches that have such a file, so a batch that
fails, or whose writer dies, leaves them on what was published before, and a batch that is stored again changes nothing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: table.column: tables and columns one of which must hold its values.
REFERENCES = {
    "chunks.document_id": ("documents.id",),
    "facts.chunk_id": ("chunks.id",),
    "relations.src": ("entities.id", "facts.id"),
    "relations.dst": ("entities.id", "facts.id"),
    "fact_relations.src": ("facts.id",),
    "fact_relations.dst": ("facts.id",),
}


def _files(spark: SparkSession, store: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(store).getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, store: str) -> list[str]:
    """Ids of the batches that readers see, in order."""
    path, fs = _files(spark, store)
    folder = path(f"{store}/published")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def broken(staged: dict[str, DataFrame], known: dict[str, DataFrame], references: dict[str, tuple[str, ...]] = REFERENCES) -> DataFrame | None:
    """reference, value, n: values in columns of the staged tables that no column they refer to holds, in the known tables.
    Nulls refer to nothing; None where no reference starts in a staged table."""
    found = []
    for here, there in references.items():
        name, column = here.split(".")
        if name not in staged:
            continue
        targets = [known[t].select(F.col(c).alias("value")) for t, c in (x.split(".") for x in there) if t in known]
        used = staged[name].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        loose = used.join(reduce(DataFrame.union, targets), "value", "left_anti") if targets else used
        found.append(loose.select(F.lit(here).alias("reference"), F.col("value").cast("string").alias("value"), "n"))
    return reduce(DataFrame.union, found) if found else None


def publish(spark: SparkSession, store: str, batch: str, tables: dict[str, DataFrame], references: dict[str, tuple[str, ...]] = REFERENCES) -> list[str]:
    """Stores the tables as one batch; returns what is wrong with it, at most a line for each reference, and publishes nothing
    then. References are held against the batch itself and what is published."""
    if batch in published(spark, store):
        return []
    path, fs = _files(spark, store)
    stage = f"{store}/batches/{batch}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{stage}/{name}")
    staged = {name: spark.read.schema(df.schema).parquet(f"{stage}/{name}") for name, df in tables.items()}
    old = _tables(spark, store)
    known = staged | {name: df.unionByName(staged[name], allowMissingColumns=True) if name in staged else df for name, df in old.items()}
    loose = broken(staged, known, references)
    if loose is not None:
        rows = loose.groupBy("reference").agg(F.count("*").alias("n"), F.min("value").alias("first")).orderBy("reference").collect()
        if rows:
            fs.delete(path(stage), True)
            return [f"{reference}: {n} values without target, the first is {first}" for reference, n, first in rows]
    manifest = path(f"{stage}/_manifest")
    out = fs.create(manifest, True)
    out.write(bytearray(stage.rsplit("/", 1)[1].encode()))
    out.close()
    fs.mkdirs(path(f"{store}/published"))
    # A rename onto an existing file fails: of two writers of a batch one publishes.
    if not fs.rename(manifest, path(f"{store}/published/{batch}")):
        fs.delete(path(stage), True)
    return []


def _tables(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    path, fs = _files(spark, store)
    names: dict[str, list[str]] = {}
    for batch in published(spark, store):
        folder = spark.read.text(f"{store}/published/{batch}", wholetext=True).first()[0]
        for s in fs.listStatus(path(f"{store}/batches/{folder}")):
            names.setdefault(s.getPath().getName(), []).append(str(s.getPath()))
    return {name: spark.read.option("mergeSchema", "true").parquet(*paths) for name, paths in names.items()}


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of all published batches."""
    return _tables(spark, store)[name]
