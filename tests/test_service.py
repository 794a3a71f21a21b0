from __future__ import annotations

import json
import logging

import pytest

from strawsift import __main__ as cli
from strawsift.operators import durations
from strawsift.plans import service
from strawsift.plans.models import InvalidQueryFormat, UnknownQueryType
from strawsift.sources import storage
from strawsift.streaming import ingest


@pytest.fixture
def lake(spark, tmp_path):
    return service.Lake(spark, f"file://{tmp_path}/lake")


def consume(lake):
    for start in (ingest.start_content, ingest.start_metadata):
        start(lake, once=True).awaitTermination()


def needle(lake, *conditions, relation="And"):
    body = json.dumps({"Relation": relation, "Conditions": [{"ColumnName": c, "Value": v} for c, v in conditions]})
    return {r["FileName"]: r["HitValues"] for r in lake.post("NeedleInHaystack", body)}


def test_from_upload_to_answers(lake, tmp_path, spark):
    (tmp_path / "a.csv").write_text("city,n\nBern,1\nParis,2\n")
    (tmp_path / "b.json").write_text('[{"city":"Bern"},{"n":7}]')
    a, b = lake.upload(str(tmp_path / "a.csv")), lake.upload(str(tmp_path / "b.json"))
    consume(lake)
    assert needle(lake, ("city", "Bern")) == {a: ["Bern"], b: ["Bern"]}
    # met by different rows of a file
    assert needle(lake, ("city", "Bern"), ("n", "2")) == {a: ["Bern", "2"]}
    assert lake.post("Cardinality", {"MetadataKey": "extension"}) == [{"Cardinality": 2}]
    assert lake.post("Frequency", {"MetadataKey": "extension", "MetadataValue": ".csv"})[0]["Frequency"] >= 1
    assert lake.post("Cardinality", {"MetadataKey": "no"}) == []

    # later files, one of them unknown and one broken; restart from the checkpoint
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "c.csv").write_text("city\nBern\n")
    (tmp_path / "more" / "d.txt").write_text("city")
    (tmp_path / "more" / "e.json").write_text("[{")
    made = lake.upload_folder(str(tmp_path / "more"))
    consume(lake)
    assert set(needle(lake, ("city", "Bern"))) == {a, b, made[0]}
    lake.index.compact()
    lake.sketches.compact()
    assert set(needle(lake, ("city", "Bern"))) == {a, b, made[0]}
    assert lake.post("Frequency", {"MetadataKey": "extension", "MetadataValue": ".csv"})[0]["Frequency"] >= 2

    lake.purge()
    assert needle(lake, ("city", "Bern")) == {}
    lake.reset()
    assert len(lake.reindex(f"{lake.root}/content")) == 5
    consume(lake)
    assert set(needle(lake, ("city", "Bern"))) == {a, b, made[0]}


def test_a_batch_that_comes_again_counts_once(lake, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    path = f"file://{tmp_path}/a.csv"
    for _ in range(2):
        lake.index_content([path], "batch-0")
        lake.index_metadata([path], "batch-0")
    assert lake.post("Frequency", {"MetadataKey": "extension", "MetadataValue": ".csv"}) == [{"Frequency": 1}]
    assert len(lake.index.current().segments) == 1


def test_refusals(lake, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "a.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        lake.upload(str(tmp_path / "a.txt"))
    with pytest.raises(UnknownQueryType):
        lake.query("needleinhaystack", "{}")
    with pytest.raises(InvalidQueryFormat):
        lake.query("Cardinality", "{}")

    def fail(paths):
        raise OSError("no topic")

    monkeypatch.setattr(lake.notifications, "send", fail)
    with pytest.raises(OSError):
        lake.upload(str(tmp_path / "a.csv"))
    assert storage.names(lake.spark, f"{lake.root}/content") == []


def test_logs_become_durations(lake, spark, tmp_path):
    handler = logging.FileHandler(tmp_path / "log.json")
    handler.setFormatter(service.JsonLines())
    service.log.addHandler(handler)
    service.log.setLevel(logging.INFO)
    (tmp_path / "a.csv").write_text("x\n1\n")
    lake.index_content([f"file://{tmp_path}/a.csv"])
    needle(lake, ("x", "1"))
    needle(lake, ("x", "2"))
    with pytest.raises(UnknownQueryType):
        lake.post("none", "{}")
    service.log.removeHandler(handler)
    handler.close()
    logs = durations.read_logs(spark, [f"file://{tmp_path}/log.json"])
    queries, ingestions = durations.query_durations(logs).collect(), durations.ingestion_durations(logs).collect()
    assert [(r["query_type"], r["num_of_results"]) for r in queries] == [("NeedleInHaystack", 1)]
    assert queries[0]["duration"] > 0
    assert [(r["ingestion_type"], r["num_of_files"], r["total_size"]) for r in ingestions] == [("Content", 1, 4)]
    for _ in range(2):
        durations.append_csv(durations.query_durations(logs), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2


def test_pairing(spark):
    rows = [(1, "start", 0, 1), (1, "start", 5, 1), (1, "end", 7, 3), (2, "end", 9, 1), (3, "start", 1, 1), (4, "start", 1, 1), (4, "end", 2, 0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id int, message string, s int, n int, line int").selectExpr("id", "message", "timestamp_seconds(s) AS at", "n", "line")
    assert [(r["id"], r["duration"]) for r in durations.paired(df, "start", "end").collect()] == [(1, 2.0)]


def test_command_line(lake, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("x\n1\n")
    cli.run(lake, ["upload", f"file={tmp_path}/a.csv"])
    cli.run(lake, ["index"])
    capsys.readouterr()
    cli.run(lake, ["query", "type=NeedleInHaystack", 'body={"Conditions":[{"ColumnName":"x","Value":"1"}]}'])
    assert json.loads(capsys.readouterr().out)[0]["HitValues"] == ["1"]
    cli.run(lake, ["nonsense"])
    assert "actions" in capsys.readouterr().out
