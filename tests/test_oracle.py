"""Every registered query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from knowmill import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    def cell(x):
        if isinstance(x, float):
            return round(x, 5)
        return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x

    return sorted((tuple(cell(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = norm(tuple(r) for r in df.select(*cols).collect())
    if name not in catalog.ORACLE:
        assert got
        return
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    want = norm(duck.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE[name]})").fetchall())
    assert got == want
