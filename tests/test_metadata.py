from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strawsift.functions import sketches
from strawsift.functions.text import allowed, blank, extension, file_name, key_values, servers
from strawsift.operators import metadata

ROWS = "file string, key string, value string"


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(5)
    return spark.createDataFrame([(f"f{i}", k, f"{k}{int(random.paretovariate(1)) % n}") for i in range(3000) for k, n in (("a", 4), ("b", 900))], ROWS)


def test_sketches_of_parts_merge_to_that_of_all(spark, rows):
    parts = metadata.sketched(rows.where("hash(file) % 2 = 0")).unionByName(metadata.sketched(rows.where("hash(file) % 2 <> 0")))
    whole = {r["key"]: r for r in metadata.sketched(rows).collect()}
    merged = {r["key"]: r for r in metadata.compacted(parts).collect()}
    for key in ("a", "b"):
        assert bytes(merged[key]["cms"]) == bytes(whole[key]["cms"])
        assert metadata.cardinality(parts, key).first()["Cardinality"] == metadata.cardinality(metadata.sketched(rows), key).first()["Cardinality"]


def test_estimates_are_within_their_bounds(spark, rows):
    stored = metadata.sketched(rows)
    exact = {(r["key"], r["value"]): r["n"] for r in rows.groupBy("key", "value").agg(F.count("*").alias("n")).collect()}
    found = {(r["key"], r["value"]): r["estimate"] for r in sketches.cms_estimates(rows, stored).collect()}
    assert all(found[k] >= n for k, n in exact.items())
    assert sum(found[k] <= n + 0.1 * 3000 for k, n in exact.items()) >= 0.9 * len(exact)
    distinct = sum(k == "b" for k, _ in exact)
    assert abs(metadata.cardinality(stored, "b").first()["Cardinality"] - distinct) <= 0.03 * distinct
    assert metadata.frequency(stored, "a", "a1").first()["Frequency"] >= exact["a", "a1"]


def test_estimates_on_executors_are_those_of_the_class(spark, monkeypatch):
    values = ["", "a", "ab", "abc", "abcd", "abcde", "12345678", "é漢😀", "ÿ\x80", "x" * 301, *map(str, range(60))]
    rows = spark.createDataFrame([("f", k, v) for n, v in enumerate(values) for k in "pq"[: 1 + n % 2] for _ in range(1 + n % 4)], ROWS)
    stored = metadata.sketched(rows)
    held = {r["key"]: bytes(r["cms"]) for r in stored.collect()}
    asked = rows.unionByName(spark.createDataFrame([("f", "p", "never seen"), ("f", "no", "a"), ("f", "p", None)], ROWS))
    wanted = {(k, v) for k in "pq" for n, v in enumerate(values) if k in "pq"[: 1 + n % 2]} | {("p", "never seen")}
    truth = sorted((k, v, sketches.cms_estimate(spark, held[k], v)) for k, v in wanted)
    with monkeypatch.context() as patched:
        patched.setattr(type(rows), "collect", lambda self: pytest.fail("rows are collected"))
        made = sketches.cms_estimates(asked, stored)
    assert sorted(map(tuple, made.collect())) == truth


def test_missing_keys_and_values(spark, rows):
    stored = metadata.sketched(rows)
    assert metadata.cardinality(stored, "no").collect() == []
    assert metadata.frequency(stored, "no", "x").collect() == []
    assert metadata.frequency(stored, "a", "no such").first()["Frequency"] >= 0


def test_unlike_sketches_are_not_merged(spark, rows):
    a = metadata.sketched(rows).first()["cms"]
    b = metadata.sketched(rows, error=0.01).first()["cms"]
    with pytest.raises(ValueError):
        sketches.cms_add([bytes(a), bytes(b)])


def test_pairs_leave_ignored_keys_out(spark):
    maps = spark.createDataFrame([("f", {"X-Parsed-By": "x", "FilePath": "y", "lang": "en", "none": None})], "file string, meta map<string,string>")
    assert [tuple(r) for r in metadata.pairs(maps).collect()] == [("f", "lang", "en")]
    rows = spark.createDataFrame([("f", "k", "v"), ("g", "k", "v"), ("g", "k", "w"), ("g", "FilePath", "w")], ROWS)
    assert [tuple(r) for r in metadata.by_key(metadata.excluded(rows)).collect()] == [("k", 3, 2)]


def test_facts_and_extractors(spark, tmp_path):
    (tmp_path / "x.csv").write_text("abc")

    def fine(path, content):
        return {"size": len(content), "who": "fine"}

    def broken(path, content):
        raise OSError("can't")

    facts = metadata.file_facts(spark, [f"file://{tmp_path}/x.csv"]).first()["meta"]
    assert facts["Content-Length"] == "3" and facts["Content-Type"] == "text/csv" and facts["resourceName"] == "x.csv"
    assert metadata.extracted(spark, [f"file://{tmp_path}/x.csv"], [broken, fine, lambda p, c: {"who": "late"}]).first()["meta"] == {"size": "3", "who": "fine"}
    assert metadata.extracted(spark, [f"file://{tmp_path}/x.csv"], [broken]).first()["meta"] == {}


def test_content_extractors(spark, tmp_path):
    files = {
        "a.csv": b'\xef\xbb\xbfid,"na\nme"\n1,x\n\n2,"two\nlines"\n',
        "empty.csv": b"",  # Spark's scan passes over empty files
        "latin.csv": b"caf\xe9,x\n1,2\n",
        "b.JSON": b'[{"k": 1, "l": 2}, {"m": {"deep": 1}, "k": 3}, 4]',
        "one.json": b'{"k": [1]}',
        "broken.json": b'{"k": ',
        "c.html": b"<html><TITLE lang=en>Two\n words</TITLE></html>",
        "d.htm": b"<p>none</p>",
        "e.txt": b"<title>no</title>",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = {r["file"].rsplit("/", 1)[-1]: r["meta"] for r in metadata.extracted(spark, [f"file://{tmp_path}"], metadata.CONTENT).collect()}
    assert found == {
        "a.csv": {"csv:columns": "id,na\nme", "csv:rows": "2"},
        "latin.csv": {},
        "b.JSON": {"json:keys": "k,l,m", "json:objects": "2"},
        "one.json": {"json:keys": "k", "json:objects": "1"},
        "broken.json": {},
        "c.html": {"title": "Two words"},
        "d.htm": {},
        "e.txt": {},
    }


def test_text_rules(spark):
    df = spark.createDataFrame([("s3://b/d.x/N.CSV",), ("none",), ("a/b.tar.gz",)], "p string")
    assert [tuple(r) for r in df.select(extension(F.col("p")), file_name(F.col("p")), allowed(F.col("p"), (".csv",))).collect()] == [(".csv", "N.CSV", True), ("", "none", False), (".gz", "b.tar.gz", False)]
    assert spark.range(1).select(blank(F.lit("  ")), blank(F.lit(None).cast("string")), blank(F.lit("x"))).first() == (True, True, False)
    assert key_values(["a=1=2", "b", "c="]) == {"a": "1=2", "c": ""}
    assert servers([("h", 1), ("g", 2)]) == "h:1,g:2"
