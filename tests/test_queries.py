"""Every query with SQL is held against DuckDB on the smallest tables."""

import duckdb
import pytest
from siftwork.plans import queries

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{AT}/{t}.parquet')")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value.isoformat()[:19] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, AT)
    names = sorted(df.columns)
    got = sorted(tuple(repr(plain(v)) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    found = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert got == sorted(tuple(repr(plain(r[i])) for i in at) for r in found.fetchall())


def test_every_query_has_sql_or_says_why():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["rule_id", "severity", "n", "n_files"]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
