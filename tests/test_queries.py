"""Every registered query against its comparison SQL at the smallest scale."""

import duckdb
import pytest

from checks.oracles import ORACLES
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("pages", "documents", "events")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_comparison_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def ordered(names, rows):
    places = sorted(range(len(names)), key=lambda place: names[place])
    return sorted(
        (tuple(round(row[p], 9) if isinstance(row[p], float) else row[p] for p in places)
         for row in rows), key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    found = ordered(frame.columns, [tuple(row) for row in frame.collect()])
    assert found
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [column[0] for column in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert found == ordered(names, result.fetchall())
