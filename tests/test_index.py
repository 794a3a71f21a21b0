from __future__ import annotations

import bisect
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strawsift.operators import inverted
from strawsift.plans.models import CardinalityQuery, Condition, FrequencyQuery, InvalidQueryFormat, NeedleInHaystackQuery, parsed
from strawsift.plans.needle import needle
from strawsift.sources.store import IndexStore

ROWS = "column string, value string, file string"


def ask(index, conditions, relation="Or"):
    found = needle(index, NeedleInHaystackQuery(tuple(Condition(*c) for c in conditions), relation)).collect()
    return {r["FileName"]: r["HitValues"] for r in found}


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/index", rows=20, groups=1)


def test_relations(spark):
    index = spark.createDataFrame([("a", "1", "f"), ("b", "2", "f"), ("a", "1", "g"), ("a", "1", "f")], ROWS)
    assert ask(index, [("a", "1"), ("b", "2")]) == {"f": ["1", "2"], "g": ["1"]}
    assert ask(index, [("a", "1"), ("b", "2")], "And") == {"f": ["1", "2"]}
    assert ask(index, [("b", "2"), ("a", "1"), ("b", "2")], "And") == {"f": ["2", "1", "2"]}
    assert ask(index, [("a", "1")], "Xor") == {}
    assert ask(index, [("a", "no"), ("z", "1")]) == {}
    assert ask(index, [("A", "1")]) == {}


def test_every_value_is_found_whatever_its_place(store, spark):
    random.seed(3)
    pool = ["a", "B", "b", "ä", "Z", "-", "_", " ", "0", "10", "9", "\U0001f600", "￼", "zz" * 30]
    rows = sorted({(random.choice("pq"), random.choice(pool) + random.choice(pool), f"f{random.randrange(6)}") for _ in range(300)})
    store.add(spark.createDataFrame(rows, ROWS))
    assert store.root_index().count() > 5
    for column, value in random.sample(sorted({r[:2] for r in rows}), 40):
        truth = {f for c, v, f in rows if (c, v) == (column, value)}
        condition = (Condition(column, value),)
        assert set(ask(store.pruned(condition), [(column, value)])) == truth
    for r in store.root_index().collect():
        for edge in (r["min"], r["max"]):
            assert ask(store.entries(), [(r["column"], edge)])


def test_batches_merge_and_come_once(store, spark):
    a, b = [("a", "1", "f"), ("a", "2", "f")], [("a", "1", "g"), ("b", "1", "g"), ("a", "1", "f")]
    store.add(spark.createDataFrame(a, ROWS), "one")
    store.add(spark.createDataFrame(b, ROWS), "two")
    number = store.add(spark.createDataFrame(b, ROWS), "two").number
    assert number == 2
    assert ask(store.entries(), [("a", "1")]) == {"f": ["1"], "g": ["1"]}
    store.compact()
    assert len(store.current().segments) == 1 and store.current().batches == ("one", "two")
    assert sorted(map(tuple, store.entries().collect())) == sorted(set(a) | set(b))
    assert store.sweep() == 2
    assert store.entries().count() == 4
    store.purge()
    assert store.entries().count() == 0


def test_a_stream_is_covered_by_its_last_batch(store, spark):
    names = [f"{stream}-{i}-{i:016x}" for i in range(4) for stream in ("content", "other")]
    for name in names:
        store.add(spark.createDataFrame([("a", name, "f")], ROWS), name)
        store.add(spark.createDataFrame([("a", "again", "f")], ROWS), name)
    assert store.current().batches == tuple(names[-2:])
    assert sorted(r["value"] for r in store.entries().collect()) == sorted(names)


def test_few_files_are_opened(store, spark):
    """Of the files of an index those whose range may hold the value are read; where they are many, all of them, with the same rows."""
    store.add(spark.createDataFrame([("a", f"{i:04d}", f"f{j}") for i in range(100) for j in range(3)], ROWS))
    asked = (Condition("a", "0051"),)
    assert len(store.entries().inputFiles()) > 10 and len(store.pruned(asked).inputFiles()) <= 2
    assert len(store.pruned(asked, few=0).inputFiles()) > 10
    rows = [sorted(map(tuple, needle(store.pruned(asked, few=few), NeedleInHaystackQuery(asked)).collect())) for few in (0, 1000)]
    assert rows[0] == rows[1] == [(f"f{j}", ["0051"]) for j in range(3)]


def test_the_root_index_is_kept_until_the_next_version(store, spark):
    store.add(spark.createDataFrame([("a", "1", "f")], ROWS))
    first = store.root_index()
    assert store.root_index() is first and first.is_cached
    store.add(spark.createDataFrame([("b", "2", "g")], ROWS))
    assert sorted(r["column"] for r in store.root_index().collect()) == ["a", "b"]


def test_a_stale_writer_is_refused(store, spark):
    before = store.current()
    store.add(spark.createDataFrame([("a", "1", "f")], ROWS))
    with pytest.raises(RuntimeError):
        store.turn_to((), (), before)


def test_the_filter_reaches_the_scan(store, spark, capsys):
    store.add(spark.createDataFrame([("a", f"{i:04d}", "f") for i in range(0, 200, 2)], ROWS))
    needle(store.entries(), NeedleInHaystackQuery((Condition("a", "0051"),))).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(value,0051)" in plan and "EqualTo(column,a)" in plan
    assert store.pruned((Condition("a", "9999"),)).count() == 0


def test_chunks_and_sections(spark):
    values = [("a", f"{i:03d}", "f") for i in range(25)] + [("b", "x", "f")]
    random.shuffle(values)
    df = spark.createDataFrame(values * 2, ROWS)
    found = sorted(map(tuple, inverted.chunks(df, 10).collect()))
    assert found == [("a", 0, "000", "009", 10), ("a", 1, "010", "019", 10), ("a", 2, "020", "024", 5), ("b", 0, "x", "x", 1)]
    assert sorted(r["n_rows"] for r in inverted.zone_map(df, 10).where("column = 'a'").collect()) == [3, 11, 11]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", max_size=3), min_size=1, max_size=12), st.lists(st.text("abcd", max_size=3), min_size=1, max_size=20))
def test_ceiling(spark, marks, asked):
    root = spark.createDataFrame([("a", m, f"file-{m}") for m in sorted(set(marks))], "column string, max string, index_file string")
    values = spark.createDataFrame([("a", v) for v in asked] + [("z", "a")], "column string, value string")
    found = {(r["column"], r["value"]): r["index_file"] for r in inverted.ceiling(values, root).collect()}
    order = sorted(set(marks))
    truth = {("a", v): f"file-{order[i]}" if (i := bisect.bisect_left(order, v)) < len(order) else inverted.END_OF_INDEX for v in asked}
    assert found == truth | {("z", "a"): inverted.END_OF_INDEX}


def test_a_long_column_is_looked_up_in_one_pass(spark, capsys):
    """No window goes on to the end of its rows at each row; so a range takes time by its rows, not by their square."""
    n, step = 60_000, 50
    root = spark.range(step - 1, n, step).select(F.lit("a").alias("column"), F.format_string("%06d", "id").alias("max"), F.format_string("f%06d", "id").alias("index_file"))
    values = spark.range(n + 1).select(F.lit("a").alias("column"), F.format_string("%06d", "id").alias("value"))
    found = inverted.ceiling(values, root)
    found.explain("extended")
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    last = F.expr(f"format_string('f%06d', CAST(value AS INT) div {step} * {step} + {step - 1})")
    right = found.where(F.when(F.col("value") == f"{n:06d}", F.col("index_file") == inverted.END_OF_INDEX).otherwise(F.col("index_file") == last))
    assert found.count() == right.count() == n + 1


def test_of_equal_ranges_the_first_file_is_found_wherever_a_value_stands(spark):
    root = spark.createDataFrame([("a", "m", f) for f in ("2", "1", "3")], "column string, max string, index_file string")
    values = spark.createDataFrame([("a", f"{c}{i:03d}") for c in "bcdl" for i in range(200)] + [("a", "m")], "column string, value string")
    assert {r["index_file"] for r in inverted.ceiling(values, root).collect()} == {"1"}


def test_ranges_upserted_and_ordered(spark):
    kind = "column string, index_file string, min string, max string"
    root = spark.createDataFrame([("a", "1", "a", "c"), ("a", "2", "d", "f"), ("b", "1", "x", "x")], kind)
    update = spark.createDataFrame([("a", "2", "d", "g"), ("c", "9", "q", "q")], kind)
    found = inverted.ranges_upserted(root, update)
    assert sorted(map(tuple, found.collect())) == [("a", "1", "a", "c"), ("a", "2", "d", "g"), ("b", "1", "x", "x"), ("c", "9", "q", "q")]
    double = found.unionByName(spark.createDataFrame([("a", "0", "z", "g")], kind))
    assert [(r["column"], r["max"], r["index_file"]) for r in inverted.ordered_ranges(double).collect()] == [("a", "c", "1"), ("a", "g", "0"), ("b", "x", "1"), ("c", "q", "9")]


def test_merging_groups_is_building_at_once(spark):
    rows = [("a", str(i % 4), f"f{i % 7}") for i in range(40)]
    whole = inverted.grouped(spark.createDataFrame(rows, ROWS))
    parts = [inverted.grouped(spark.createDataFrame(rows[i::2], ROWS)) for i in range(2)]
    assert sorted(map(tuple, inverted.merged_groups(*parts).collect())) == sorted(map(tuple, whole.collect()))
    both = spark.createDataFrame(rows, ROWS)
    assert inverted.merged(both, both).count() == len(set(rows))


def test_queries_are_read_and_checked():
    q = parsed(NeedleInHaystackQuery, '{"Relation":"And","Conditions":[{"ColumnName":"c","Value":"v"}]}')
    assert q == NeedleInHaystackQuery((Condition("c", "v"),), "And")
    assert parsed(NeedleInHaystackQuery, {"Conditions": [{"ColumnName": "c", "Value": "v"}]}).Relation == "Or"
    assert parsed(NeedleInHaystackQuery, {"Relation": 1, "Conditions": [{"ColumnName": "c", "Value": "v"}]}).Relation == "And"
    for kind, body in ((NeedleInHaystackQuery, "{}"), (NeedleInHaystackQuery, "["), (NeedleInHaystackQuery, '{"Conditions":[{"columnname":"c"}]}'), (CardinalityQuery, "{}"), (CardinalityQuery, '{"metadatakey":"x"}'), (FrequencyQuery, '{"MetadataKey":"k"}')):
        with pytest.raises(InvalidQueryFormat):
            parsed(kind, body)
