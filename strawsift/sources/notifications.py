"""Announcements of files: a topic of (key, value), both the file's path.

Kafka is used where its connector is on the class path; else a folder of JSON lines, which the file source reads as a stream.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

ROWS = "key string, value string"
FILE_PATHS = 1000  # announced in one file


class Notifications:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def send(self, paths: list[str]) -> None:
        for at in range(0, len(paths), FILE_PATHS):
            body = "".join(json.dumps({"key": p, "value": p}) + "\n" for p in paths[at : at + FILE_PATHS])
            storage.put(self.spark, f"{self.folder}/{time.time_ns():020d}-{uuid.uuid4().hex}.jsonl", body.encode())

    def stream(self, files: int = 100) -> DataFrame:
        """From the earliest on, at most ``files`` announcements' files a micro-batch, each of at most FILE_PATHS paths."""
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder))
        return self.spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.jsonl").json(self.folder)

    def delete(self) -> None:
        storage.delete(self.spark, self.folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, offsets: int = 10_000) -> DataFrame:
    """The same from a Kafka topic, from the earliest on."""
    rows = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(offsets), "kafka.max.poll.interval.ms": "3600000"}).load()
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def kafka_send(paths: DataFrame, servers: str, topic: str) -> None:
    """Announce rows (path)."""
    paths.select(F.col("path").alias("key"), F.col("path").alias("value")).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def topics_except(topics: DataFrame, ignored: list[str]) -> DataFrame:
    """(topic): the topics but for the ignored ones, once each."""
    return topics.select("topic").distinct().where(~F.col("topic").isin(*ignored))
