from __future__ import annotations

import pytest

from strawsift.sources import storage, tables


def write(folder, **files):
    out = []
    for name, text in files.items():
        path = folder / name.replace("__", ".")
        path.write_text(text, encoding="utf-8")
        out.append(f"file://{path}")
    return out


def cells(df):
    return sorted((r["column"], r["value"]) for r in df.collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a,b\n1,x\n2,x\n", [("a", "1"), ("a", "2"), ("b", "x")]),
        ("a,b\n1,\n", [("a", "1")]),
        ("a,b\n1\n", [("a", "1")]),
        ("a\n1,2\n", [("a", "1")]),
        ("a,a\n1,2\n", []),
        ("a,b\n", []),
        ("", []),
        ('"a,x",b\n"1,2","say ""hi"""\n', [("a,x", "1,2"), ("b", 'say "hi"')]),
        ("a\n a \n", [("a", " a ")]),
        ("a,b\na,b\n", [("a", "a"), ("b", "b")]),
        ('a,b\n"one\ntwo",x\n"three ""\n,"" four",y\n', [("a", "one\ntwo"), ("a", 'three "\n," four'), ("b", "x"), ("b", "y")]),
        ('"a\nb",c\n1,"2\n\n3"\n', [("a\nb", "1"), ("c", "2\n\n3")]),
    ],
)
def test_csv(spark, tmp_path, text, expected):
    assert cells(tables.entries(spark, write(tmp_path, x__csv=text))) == expected


def test_files_with_and_without_quoted_line_breaks(spark, tmp_path):
    paths = write(tmp_path, x__csv='a,b\n"1\n2",3\n', y__csv="a,b\n4,5\n", z__csv='b,b\n"1\n2",3\n')
    found = tables.csv_entries(spark, paths).collect()
    assert sorted((r["column"], r["value"], r["file"].rsplit("/", 1)[1]) for r in found) == [("a", "1\n2", "x.csv"), ("a", "4", "y.csv"), ("b", "3", "x.csv"), ("b", "5", "y.csv")]
    assert [r["reason"] for r in tables.rejected(spark, paths).collect()] == ["header"]


def test_announcements_are_dealt_to_files(spark, tmp_path):
    from strawsift.sources.notifications import FILE_PATHS, Notifications

    told = Notifications(spark, f"file://{tmp_path}/n")
    told.send([f"p{i}" for i in range(2 * FILE_PATHS + 1)])
    assert len(storage.names(spark, f"file://{tmp_path}/n")) == 3
    assert spark.read.json(f"{tmp_path}/n").count() == 2 * FILE_PATHS + 1


def test_csv_files_of_different_layouts(spark, tmp_path):
    paths = write(tmp_path, x__csv="a,b\n1,2\n", Y__CSV="c,a,d\n3,1,4\n")
    found = tables.entries(spark, paths).collect()
    assert sorted((r["column"], r["value"], r["file"].rsplit("/", 1)[1]) for r in found) == [("a", "1", "Y.CSV"), ("a", "1", "x.csv"), ("b", "2", "x.csv"), ("c", "3", "Y.CSV"), ("d", "4", "Y.CSV")]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('[{"a":"x","b":1},{"a":"y"}]', [("a", "x"), ("a", "y"), ("b", "1")]),
        ('{"a":true}', [("a", "true")]),
        ('{"a":{"e":1},"b":[1],"c":null,"d":"z"}', [("d", "z")]),
        ('{"a":""}', []),
        ('{"a":1.0, "b":1.5, "d":"2020-01-01T00:00:00Z"}', [("a", "1"), ("b", "1.5"), ("d", "2020-01-01T00:00:00Z")]),
        ("[[{\"a\":1}],[[{\"a\":2}]],3]", [("a", "1"), ("a", "2")]),
        ('{"a":1}\n{"a":2}\n\n{"b":"é"}\n', [("a", "1"), ("a", "2"), ("b", "é")]),
        ("[{", []),
        ('{"a":1}\n{"a"\n', []),
        ('\n \n{"a":1}\n[{"a":2}]\r\n3\n', [("a", "1"), ("a", "2")]),
        ('{\n"a":1\n}', [("a", "1")]),
        ('{\n"a":1\n}\n{"a":2}\n', []),
        ("", []),
        ("[]", []),
    ],
)
def test_json(spark, tmp_path, text, expected):
    assert cells(tables.entries(spark, write(tmp_path, x__json=text))) == expected


@pytest.mark.parametrize("depth", [3, 4, 5, 40, 900])
def test_objects_are_found_in_arrays_of_any_depth(spark, tmp_path, depth):
    text = "[" * depth + '{"a":1},null,[{"b":[2]},{"c":"x"}]' + "]" * depth
    assert cells(tables.entries(spark, write(tmp_path, x__json=text))) == [("a", "1"), ("c", "x")]


def test_json_literals_keep_their_quotes(spark, tmp_path):
    paths = write(tmp_path, x__json='{"a":"x","b":"","c":true}')
    assert cells(tables.json_entries(spark, paths, json_literal=True)) == [("a", '"x"'), ("b", '""'), ("c", "true")]


def test_other_kinds_are_passed_over_and_faults_reported(spark, tmp_path):
    paths = write(tmp_path, a__txt="x", b__csv="h,h\n1,2\n", c__json="[{", d__csv="h\n1\n")
    assert cells(tables.entries(spark, paths)) == [("h", "1")]
    found = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in tables.rejected(spark, paths).collect()}
    assert found == {"a.txt": "kind", "b.csv": "header", "c.json": "json"}
    assert tables.entries(spark, []).count() == 0


def test_storage(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert storage.put(spark, f"{root}/a/x.bin", b"one")
    assert not storage.put(spark, f"{root}/a/x.bin", b"two")
    assert storage.get(spark, f"{root}/a/x.bin") == b"one"
    assert [n.rsplit("/", 1)[1] for n in storage.names(spark, f"{root}/a")] == ["x.bin"]
    assert storage.exists(spark, f"{root}/a/x.bin") and storage.delete(spark, f"{root}/a")
    assert storage.names(spark, f"{root}/a") == []
    with pytest.raises(storage.NotThere):
        storage.get(spark, f"{root}/a/x.bin")
    assert storage.content_path("r", "x.CSV").endswith(".CSV")


class _Kafka:
    """A reader or writer that notes what it is asked for, in place of the connector."""

    def __init__(self, rows=None):
        self.rows, self.asked = rows, {}

    def format(self, name):
        self.asked["format"] = name
        return self

    def options(self, **given):
        self.asked |= given
        return self

    def load(self):
        return self.rows

    def save(self):
        self.asked["saved"] = True


def test_kafka_is_asked_for_the_topic(spark):
    """The options and columns only; no broker is here."""
    from types import SimpleNamespace

    from strawsift.sources import notifications

    reader = _Kafka(spark.createDataFrame([(b"p", b"p", 7), (None, b"q", 8)], "key binary, value binary, offset long"))
    rows = notifications.kafka_stream(SimpleNamespace(readStream=reader), "h:1,g:2", "files", offsets=5)
    assert sorted(map(tuple, rows.collect()), key=repr) == [("p", "p"), (None, "q")] and rows.columns == ["key", "value"]
    assert {k: reader.asked[k] for k in ("format", "kafka.bootstrap.servers", "subscribe", "startingOffsets", "maxOffsetsPerTrigger")} == {"format": "kafka", "kafka.bootstrap.servers": "h:1,g:2", "subscribe": "files", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "5"}

    writer, columns = _Kafka(), []
    notifications.kafka_send(SimpleNamespace(select=lambda *c: columns.extend(c) or SimpleNamespace(write=writer)), "h:1", "files")
    assert writer.asked == {"format": "kafka", "kafka.bootstrap.servers": "h:1", "topic": "files", "saved": True}
    assert [tuple(r) for r in spark.createDataFrame([("x",)], "path string").select(*columns).collect()] == [("x", "x")]
