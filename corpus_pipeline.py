"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing; part of knowmill.llm.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
ORACLE_SQL is None: near duplicates are connected components, and keyed pseudonyms, Pfair slots and token ids
have no SQL either; tests/llm holds brute-force versions.
"""

from pyspark.sql import DataFrame, SparkSession

from knowmill.llm.common import stash, table
from knowmill.llm.jaccard import stage_near_duplicates
from knowmill.llm.mixing import stage_mixing
from knowmill.llm.packing import stage_packing
from knowmill.llm.pii import stage_pii
from knowmill.llm.quality import stage_quality

STAGES = [
    ("quality rules", stage_quality),
    ("near duplicates", stage_near_duplicates),
    ("personal data", stage_pii),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
