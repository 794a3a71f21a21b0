"""The index and the sketches on disk, in versions.

A version is a list of segments (folders of Parquet files that never change) and the batches that it covers (of a stream, whose batches
come in turn and are named stream-number-hash, the last alone), in a small JSON file with the version's number as its name; the highest
number is current. Readers see whole versions only, a batch that comes again adds nothing, and what it wrote before a crash is in no
version. Two writers can't make the same version on file systems whose rename doesn't replace, as HDFS; on other stores, one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import counted
from ..operators import inverted, metadata
from . import storage

BLOOM_FPP = 0.01
GROUPS = 64  # row groups of an index file, each with ranges and Bloom filters of its own
ROOT_FILE_ROWS = 100_000
FEW_FILES = 1000  # that a query names one by one
_STREAM = re.compile(r"(.+)-\d+-[0-9a-f]{16}")
INDEX_ROWS = "column string, value string, file string"
ROOT_ROWS = "column string, index_file string, min string, max string, n_rows bigint"
SKETCH_ROWS = "key string, hll binary, cms binary, batch string"


@dataclass(frozen=True)
class Version:
    number: int
    segments: tuple[str, ...]
    batches: tuple[str, ...]


def _with(batches: tuple[str, ...], batch: str | None) -> tuple[str, ...]:
    """The batches that a version covers once ``batch`` is in it."""
    if batch is None:
        return batches
    stream = _STREAM.fullmatch(batch)
    return (*(b for b in batches if not (stream and (m := _STREAM.fullmatch(b)) and m[1] == stream[1])), batch)


class Versions:
    """Versions below a folder. There is one writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> Version:
        """The version of the highest number; an empty one where nothing has been written. Failures to read one are raised."""
        numbers = [int(m[1]) for n in storage.names(self.spark, f"{self.root}/versions", recursive=False) if (m := re.search(r"/(\d+)\.json$", n))]
        if not numbers:
            return Version(0, (), ())
        found = json.loads(storage.get(self.spark, f"{self.root}/versions/{max(numbers)}.json"))
        return Version(max(numbers), tuple(found["segments"]), tuple(found["batches"]))

    def new_segment(self) -> str:
        return f"{self.root}/segments/{uuid.uuid4().hex}"

    def turn_to(self, segments: tuple[str, ...], batches: tuple[str, ...], after: Version) -> Version:
        """The next version. It comes into being by one rename; where another writer has made it already, RuntimeError."""
        made = Version(after.number + 1, segments, batches)
        body = json.dumps({"segments": list(segments), "batches": list(batches)}).encode()
        if self.current().number != after.number or not storage.put(self.spark, f"{self.root}/versions/{made.number}.json", body):
            raise RuntimeError("another writer has changed the index meanwhile")
        return made

    def sweep(self) -> int:
        """Delete older versions and the segments that only they have; how many segments. Not while readers hold an older version."""
        live = {s.rsplit("/", 1)[-1] for s in self.current().segments}
        gone = [s for s in storage.folders(self.spark, f"{self.root}/segments") if s not in live]
        number = self.current().number
        for n in storage.names(self.spark, f"{self.root}/versions", recursive=False):
            if not n.endswith(f"/{number}.json"):
                storage.delete(self.spark, n)
        for s in gone:
            storage.delete(self.spark, f"{self.root}/segments/{s}")
        return len(gone)

    def purge(self) -> None:
        storage.delete(self.spark, self.root)


class IndexStore(Versions):
    """An inverted index. Each batch adds a segment; ``compact`` makes one of all."""

    def __init__(self, spark: SparkSession, root: str, rows: int = inverted.MAX_ROWS, groups: int = GROUPS):
        """``rows`` of a row group, ``groups`` of a file."""
        super().__init__(spark, root)
        self.rows, self.groups = rows, groups
        self._root: tuple[int, DataFrame] | None = None

    def _write(self, entries: DataFrame) -> str:
        segment = self.new_segment()
        entries, n = counted(entries)
        options = {"parquet.bloom.filter.enabled#value": "true", "parquet.bloom.filter.expected.ndv#value": str(self.rows), "parquet.bloom.filter.fpp#value": str(BLOOM_FPP), "parquet.block.row.count.limit": str(self.rows)}
        inverted.laid_out(entries, self.rows * self.groups, n).write.options(**options).parquet(f"{segment}/data")
        files = self.spark.read.schema(INDEX_ROWS).parquet(f"{segment}/data").select("column", "value", F.col("_metadata.file_path").alias("index_file"))
        root = inverted.ranges(files).select("column", "index_file", "min", "max", "n_rows")
        parts = 1 + n // (self.rows * self.groups * ROOT_FILE_ROWS)
        (root.coalesce(1) if parts == 1 else root.repartitionByRange(parts, "column", "min")).write.parquet(f"{segment}/root")
        return segment

    def add(self, entries: DataFrame, batch: str | None = None) -> Version:
        """Add the entries of a batch, unless it has been added."""
        now = self.current()
        if batch is not None and batch in now.batches:
            return now
        segment = self._write(entries.distinct())
        return self.turn_to((*now.segments, segment), _with(now.batches, batch), now)

    def compact(self) -> Version:
        now = self.current()
        if len(now.segments) < 2:
            return now
        return self.turn_to((self._write(self.entries().distinct()),), now.batches, now)

    def entries(self) -> DataFrame:
        """All rows (column, value, file). A row may stand in several segments."""
        segments = self.current().segments
        read = self.spark.read.schema(INDEX_ROWS)
        return read.parquet(*[f"{s}/data" for s in segments]) if segments else self.spark.createDataFrame([], INDEX_ROWS)

    def root_index(self) -> DataFrame:
        """The ranges of all index files. Kept by the executors from one query to the next, until there is another version."""
        now = self.current()
        if self._root is None or self._root[0] != now.number:
            if self._root is not None:
                self._root[1].unpersist()
            found = self.spark.read.schema(ROOT_ROWS).parquet(*[f"{s}/root" for s in now.segments]) if now.segments else self.spark.createDataFrame([], ROOT_ROWS)
            self._root = now.number, found.persist()
        return self._root[1]

    def pruned(self, conditions, few: int = FEW_FILES) -> DataFrame:
        """The rows of the index files whose range may hold a condition's value; other files aren't opened. Of more than ``few`` such files no
        list is made: all files are left to the scan, whose filters then pass over row groups by range and Bloom filter."""
        root = self.root_index()
        asked = None
        for c in conditions:
            one = (F.col("column") == c.ColumnName) & (F.col("min") <= c.Value) & (F.col("max") >= c.Value)
            asked = one if asked is None else asked | one
        files = [r[0] for r in root.where(asked).select("index_file").distinct().limit(few + 1).collect()]
        if len(files) > few:
            return self.entries()
        return self.spark.read.schema(INDEX_ROWS).parquet(*files) if files else self.spark.createDataFrame([], INDEX_ROWS)


class SketchStore(Versions):
    """Each metadata key's sketches, a row for each batch until they are compacted."""

    def add(self, rows: DataFrame, batch: str | None = None) -> Version:
        """Add what a batch's rows (key, value) count, unless it has been added: Count-Min would count it twice."""
        now = self.current()
        if batch is not None and batch in now.batches:
            return now
        segment = self.new_segment()
        metadata.sketched(rows).select("key", "hll", "cms", F.lit(batch or "").alias("batch")).write.parquet(segment)
        return self.turn_to((*now.segments, segment), _with(now.batches, batch), now)

    def compact(self) -> Version:
        now = self.current()
        if len(now.segments) < 2:
            return now
        segment = self.new_segment()
        metadata.compacted(self.sketches()).select("key", "hll", "cms", F.lit("").alias("batch")).write.parquet(segment)
        return self.turn_to((segment,), now.batches, now)

    def sketches(self) -> DataFrame:
        segments = self.current().segments
        return self.spark.read.schema(SKETCH_ROWS).parquet(*segments) if segments else self.spark.createDataFrame([], SKETCH_ROWS)
