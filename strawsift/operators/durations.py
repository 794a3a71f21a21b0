"""How long queries and ingestions took, from start and end events in logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_ROWS = "date string, level string, logger string, message string, exception string, properties map<string,string>"


def read_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Log lines with ``at``, the date as a timestamp, and ``line``, their order."""
    rows = spark.read.schema(LOG_ROWS).json(paths)
    return rows.withColumn("at", F.to_timestamp(F.translate("date", ",", "."), "yyyy-MM-dd HH:mm:ss.SSS")).withColumn("line", F.monotonically_increasing_id())


def paired(events: DataFrame, start: str, end: str) -> DataFrame:
    """From (id, message, at, line, n, ...): each end with n other than 0 and, as ``duration`` in seconds, its time since the latest start of its id
    before it. Starts without an end and ends without a start are left out; a start counts for one end only as long as no later
    start comes. An id's few events meet in one task, no more."""
    rows = events.where(F.col("message").isin(start, end))
    before = Window.partitionBy("id").orderBy("at", "line").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("message") == start, F.col("at")), ignorenulls=True).over(before)
    rows = rows.withColumn("_begun", begun).where((F.col("message") == end) & F.col("_begun").isNotNull() & (F.col("n") != 0))
    return rows.withColumn("duration", seconds(F.col("_begun"), F.col("at"))).drop("_begun")


def seconds(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1_000_000


def _events(logs: DataFrame, key: str, kind: str, n: str) -> DataFrame:
    p = lambda name: F.col("properties").getItem(name)
    return logs.select(p(key).alias("id"), p(kind).alias("type"), "message", "at", "line", F.coalesce(p(n).cast("long"), F.lit(0)).alias("n"), p("TotalSize").cast("long").alias("total_size"))


def query_durations(logs: DataFrame) -> DataFrame:
    """(id, query_type, duration, num_of_results)."""
    found = paired(_events(logs, "SessionId", "QueryType", "ResultCount"), "query-start", "query-end")
    return found.select("id", F.col("type").alias("query_type"), "duration", F.col("n").alias("num_of_results"))


def ingestion_durations(logs: DataFrame) -> DataFrame:
    """(id, ingestion_type, duration, num_of_files, total_size)."""
    found = paired(_events(logs, "IngestionId", "IngestionType", "FilesCount"), "ingestion-start", "ingestion-end")
    return found.select("id", F.col("type").alias("ingestion_type"), "duration", F.col("n").alias("num_of_files"), "total_size")


def append_csv(durations: DataFrame, path: str) -> None:
    """Append to a folder of CSV files with headers."""
    durations.write.mode("append").option("header", True).csv(path)
