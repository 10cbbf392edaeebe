"""Registered queries of the corpus operators against their SQL, on the smallest tables."""

import duckdb
import pytest

from tessel.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as db:
        for name in ("documents", "pages", "conversations"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
        yield db


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    place = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted(str([row[i] for i in place]) for row in cursor.fetchall())
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == columns
    assert sorted(str([row[c] for c in columns]) for row in got.collect()) == want
