"""Mergeable sketches: HyperLogLog with built-in functions, Count-Min with its built-in aggregate.

SQL has no function that merges Count-Min sketches or asks them for an estimate. Merging adds tables of equal shape, so it is done
on executors over the serialized form, and so are estimates of many values; one value's asks the class that made the sketch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HLL_LG_K = 14
#: Error, confidence and seed of the Count-Min sketches.
CMS_ERROR, CMS_CONFIDENCE, CMS_SEED = 0.1, 0.9, 0


def hll(value: Column, lg_k: int = HLL_LG_K) -> Column:
    return F.hll_sketch_agg(value, lg_k)


def hll_merge(sketch: Column) -> Column:
    return F.hll_union_agg(sketch, F.lit(False))


def hll_estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def cms(value: Column, error: float = CMS_ERROR, confidence: float = CMS_CONFIDENCE, seed: int = CMS_SEED) -> Column:
    return F.count_min_sketch(value, F.lit(error), F.lit(confidence), F.lit(seed))


_HEAD = struct.Struct(">iqii")  # version, total, depth, width; then depth hash factors and depth * width counts, 64 bits each


def cms_add(sketches: Iterable[bytes]) -> bytes:
    """One sketch of all that some sketches of equal shape have counted."""
    total, head, table = 0, None, None
    for raw in sketches:
        version, count, depth, width = _HEAD.unpack_from(raw)
        factors = raw[_HEAD.size : _HEAD.size + 8 * depth]
        if head is None:
            head, table = (version, depth, width, factors), np.zeros(depth * width, ">i8").astype(np.int64)
        if head != (version, depth, width, factors):
            raise ValueError("sketches of different shapes or seeds can't be merged")
        total += count
        table += np.frombuffer(raw, ">i8", depth * width, _HEAD.size + 8 * depth)
    if head is None:
        raise ValueError("no sketch to merge")
    version, depth, width, factors = head
    return _HEAD.pack(version, total, depth, width) + factors + table.astype(">i8").tobytes()


def cms_merged(sketches: DataFrame, by: str = "key", column: str = "cms") -> DataFrame:
    """(by, column): one Count-Min sketch for each key. A key has a row for each batch since its last compaction."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [rows[by].iloc[0]], column: [cms_add(map(bytes, rows[column]))]})

    kind = sketches.schema[by].dataType.simpleString()
    return sketches.select(by, column).groupBy(by).applyInPandas(add, f"{by} {kind}, {column} binary")


def cms_estimate(spark: SparkSession, sketch: bytes, value: str) -> int:
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(sketch)).estimateCount(value)


def _murmur3(words: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """32-bit hashes of rows of words, as Spark's sketches hash strings."""
    u = np.uint32
    turned = lambda x, by: (x << u(by)) | (x >> u(32 - by))
    h = seed.astype(u)
    for k in words.T:
        h = turned(h ^ (turned(k * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    return h


def _hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes that a value's places in a sketch are made of: the second has the first as its seed."""
    size = np.array([len(b) for b in raw], np.int64)
    out = np.zeros((2, len(raw)), np.uint32)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        text = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)
        whole = n // 4 * 4
        # bytes after the last whole word are words of their own, with their sign
        words = np.concatenate([np.ascontiguousarray(text[:, :whole]).view("<u4").reshape(len(at), whole // 4), text[:, whole:].astype(np.int8).astype(np.int32).view(np.uint32)], axis=1)
        seed = np.zeros(len(at), np.uint32)
        for half in out:
            h = _murmur3(words, seed) ^ np.uint32(n)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            half[at] = seed = h ^ (h >> np.uint32(16))
    return out[0], out[1]


def cms_estimate_many(sketch: bytes, values: list[str]) -> np.ndarray:
    """Estimates of some values from one sketch, without the JVM: what ``cms_estimate`` gives."""
    _, _, depth, width = _HEAD.unpack_from(sketch)
    table = np.frombuffer(sketch, ">i8", depth * width, _HEAD.size + 8 * depth).reshape(depth, width)
    first, second = (h.view(np.int32) for h in _hashes([v.encode() for v in values]))
    places = (np.abs(np.fmod(first + np.int32(i) * second, np.int32(width))) for i in range(depth))
    return np.min([table[i, at] for i, at in enumerate(places)], axis=0).astype(np.int64)


def cms_estimates(rows: DataFrame, sketches: DataFrame, by: str = "key", value: str = "value") -> DataFrame:
    """``rows`` (by, value) with ``estimate``, from the sketch of each row's key, on executors; nothing is collected. One sketch a key,
    a kilobyte each at the defaults."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, values = batch.column(2).dictionary_encode(), batch.column(1).to_pylist()
            which, out = raw.indices.to_numpy(), np.zeros(len(values), np.int64)
            for i, sketch in enumerate(raw.dictionary.to_pylist()):
                at = np.flatnonzero(which == i)
                out[at] = cms_estimate_many(sketch, [values[j] for j in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=[by, value, "estimate"])

    asked = rows.select(by, value).where(F.col(value).isNotNull()).distinct()
    return asked.join(sketches.select(by, "cms"), by).select(by, value, "cms").mapInArrow(run, f"{by} string, {value} string, estimate bigint")
