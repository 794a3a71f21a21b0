"""Metadata of files: maps of strings, and what their keys' sketches tell."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sketches
from ..functions.text import extension, file_name, present

#: Keys that say nothing about a file.
IGNORED = ("X-Parsed-By", "X-TIKA:Parsed-By", "FilePath")
TYPES = {".csv": "text/csv", ".json": "application/json", ".txt": "text/plain", ".parquet": "application/vnd.apache.parquet"}

#: A file's content (or none) and name to its metadata; a failure counts as no metadata.
Extractor = Callable[[str, bytes], dict[str, str]]


def file_facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, meta) from what the file system knows of each file. No content is read."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    facts = {
        "resourceName": file_name(F.col("path")),
        "extension": extension(F.col("path")),
        "Content-Type": F.coalesce(kinds[extension(F.col("path"))], F.lit("application/octet-stream")),
        "Content-Length": F.col("length").cast("string"),
        "Last-Modified": F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    return files.select(F.col("path").alias("file"), F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]).alias("meta"))


def extracted(spark: SparkSession, paths: list[str], extractors: Sequence[Extractor]) -> DataFrame:
    """(file, meta) by Python extractors over each file's content; of a key that two give, the first one's value stays. Empty files
    have no row: the scan passes over them."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                meta: dict[str, str] = {}
                for extract in extractors:
                    try:
                        meta = {str(k): str(v) for k, v in extract(path, content).items()} | meta
                    except Exception:  # noqa: BLE001  a file that an extractor can't read has no metadata from it
                        continue
                made.append(meta)
            yield pd.DataFrame({"file": batch["path"], "meta": made})

    return files.mapInPandas(run, "file string, meta map<string,string>")


def csv_shape(path: str, content: bytes) -> dict[str, str]:
    """Of a .csv file: the names of its columns and how many rows follow them; blank lines are none."""
    if not path.lower().endswith(".csv"):
        return {}
    rows = (r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), strict=True) if r)
    head = next(rows, [])
    return {"csv:columns": ",".join(head), "csv:rows": str(sum(1 for _ in rows))} if head else {}


def json_keys(path: str, content: bytes) -> dict[str, str]:
    """Of a .json file: the keys of its object, or of all objects of its array, in the order of their first use, and how many objects."""
    if not path.lower().endswith(".json"):
        return {}
    value = json.loads(content)
    objects = [o for o in (value if isinstance(value, list) else [value]) if isinstance(o, dict)]
    return {"json:keys": ",".join(dict.fromkeys(k for o in objects for k in o)), "json:objects": str(len(objects))}


def html_title(path: str, content: bytes) -> dict[str, str]:
    """Of a .html or .htm file: its title, white space made single spaces."""
    found = re.search(rb"<title[^>]*>(.*?)</title", content, re.I | re.S) if path.lower().endswith((".html", ".htm")) else None
    return {"title": " ".join(found[1].decode().split())} if found else {}


#: Extractors for ``extracted`` that read contents; each gives nothing of files that aren't its kind.
CONTENT = (csv_shape, json_keys, html_title)


def pairs(maps: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(file, key, value) of each file's metadata, without the ignored keys."""
    fine = F.map_filter("meta", lambda k, v: ~k.isin(*ignored) & v.isNotNull())
    return maps.select("file", F.explode(fine).alias("key", "value"))


def excluded(rows: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    return rows.where(~F.col("key").isin(*ignored) & present(F.col("value")))


def by_key(rows: DataFrame) -> DataFrame:
    """(key, n_values, n_distinct): repeats count in the first."""
    return rows.groupBy("key").agg(F.count("value").alias("n_values"), F.count_distinct("value").alias("n_distinct"))


def sketched(rows: DataFrame, lg_k: int = sketches.HLL_LG_K, error: float = sketches.CMS_ERROR, confidence: float = sketches.CMS_CONFIDENCE, seed: int = sketches.CMS_SEED) -> DataFrame:
    """(key, hll, cms): each key's sketches, aggregated map-side first. Values of one file count once a key in the map form."""
    return rows.groupBy("key").agg(sketches.hll(F.col("value"), lg_k).alias("hll"), sketches.cms(F.col("value"), error, confidence, seed).alias("cms"))


def compacted(stored: DataFrame) -> DataFrame:
    """(key, hll, cms): the sketches of all batches as one for each key."""
    hll = stored.groupBy("key").agg(sketches.hll_merge(F.col("hll")).alias("hll"))
    return hll.join(sketches.cms_merged(stored), "key")


def cardinality(stored: DataFrame, key: str) -> DataFrame:
    """(Cardinality): about how many values a key has; no row for a key that there isn't."""
    found = stored.where(F.col("key") == key).groupBy("key").agg(sketches.hll_merge(F.col("hll")).alias("hll"))
    return found.select(sketches.hll_estimate(F.col("hll")).alias("Cardinality"))


def frequency(stored: DataFrame, key: str, value: str) -> DataFrame:
    """(Frequency): about how often a key has a value, never too few; no row for a key that there isn't."""
    spark = stored.sparkSession
    found = sketches.cms_merged(stored.where(F.col("key") == key)).collect()  # one row at most
    made = [(sketches.cms_estimate(spark, bytes(r["cms"]), value),) for r in found]
    return spark.createDataFrame(made, "Frequency bigint")


def batch_metrics(files: DataFrame, length: str = "length") -> DataFrame:
    """(n_files, total): how many files a batch has, and their size."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(length), F.lit(0)).alias("total"))
