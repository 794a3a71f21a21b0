from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strawsift.operators import inverted
from strawsift.plans import lake

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(lake.queries()))
def test_lake_queries_match_their_sql(spark, duck, name):
    mine, theirs = lake.queries()[name](spark, DATA), duck.sql(lake.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in mine.select(columns).collect()) == key(theirs.select(*columns).fetchall())


def test_every_value_of_the_lake_is_looked_up(spark):
    root = {}
    for r in lake.root_index(spark, DATA).collect():
        root.setdefault(r["col"], []).append((r["max"], str(r["chunk"])))
    asked = {(r["column"], r["value"]) for r in lake.lake(spark, DATA).select("column", "value").distinct().collect()}
    asked |= {(c, max(v for k, v in asked if k == c) + "~") for c in root}
    truth = {(c, v, min(((m, f) for m, f in root[c] if m >= v), default=("", inverted.END_OF_INDEX))[1]) for c, v in asked}
    assert {c for c, _ in asked} == {c for *_, columns in lake.LAYOUT for c in columns}
    assert sorted(map(tuple, lake.queries()["value_to_index_file"](spark, DATA).select("col", "value", "index_file").collect())) == sorted(truth)


def test_entry(spark):
    assert entry.entry(spark).columns == ["FileName", "HitValues"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
