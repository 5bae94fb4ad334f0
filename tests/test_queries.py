"""Every query with SQL gives what DuckDB gives; the others run."""

import decimal
import os

import duckdb
import pytest

from quillspark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(float(x), 6) if isinstance(x, (float, decimal.Decimal)) else x
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    found = rows(df.columns, df.collect())
    if name in queries.ORACLES:
        expected = db.sql(queries.ORACLES[name])
        assert found == rows(expected.columns, expected.fetchall())
