"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from stationmine.plans import oracle, queries

ROOT = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean", "DATE": "date",
}
QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        [tuple("null" if r[i] is None else repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    )


def test_every_query_has_sql():
    # these depend on hashes that SQL does not have; tests/test_trees.py holds them against plain versions
    assert set(QUERIES) - set(SQL) == {"forest_confusion", "tuned_trees"} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_as_sql(spark, duck, key):
    df = QUERIES[key](spark, ROOT)
    rel = duck.sql(SQL[key])
    types = {n: TYPES[str(t)] for n, t in zip(rel.columns, rel.types)}
    assert types == dict(df.dtypes)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(rel.fetchall(), rel.columns)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
