"""Objects of a lake, by any path that Hadoop's file systems open."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import SparkSession


class NotThere(Exception):
    """No object at the path."""


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Hadoop spells it, which is how scans name the files they read."""
    fs, p = _open(spark, path)
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return bool(fs.exists(p))


def get(spark: SparkSession, path: str) -> bytes:
    """A whole small object; NotThere if there is none. Other failures are raised as they are."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        raise NotThere(path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def put(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a new object whole: under another name first, then renamed, so that no reader meets a part of it. False, and nothing
    written, if there is an object at the path."""
    fs, p = _open(spark, path)
    if fs.exists(p):
        return False
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    done = not fs.exists(p) and bool(fs.rename(part, p))
    if not done:
        fs.delete(part, False)
    return done


def copy_in(spark: SparkSession, local: str, path: str) -> None:
    """Copy a file of any size from the driver's machine."""
    fs, p = _open(spark, path)
    fs.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return bool(fs.delete(p, True))


def names(spark: SparkSession, prefix: str, recursive: bool = True) -> list[str]:
    """The paths of all objects below a prefix, sorted; none if there is no such place."""
    fs, p = _open(spark, prefix)
    if not fs.exists(p):
        return []
    found, each = [], fs.listFiles(p, recursive)
    while each.hasNext():
        found.append(each.next().getPath().toString())
    return sorted(found)


def folders(spark: SparkSession, prefix: str) -> list[str]:
    fs, p = _open(spark, prefix)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def content_path(root: str, name: str, today: datetime | None = None) -> str:
    """Where a new object goes: ``root/year/month/day/guid.extension``."""
    d = today or datetime.now(UTC)
    dot = name.rfind(".")
    return f"{root}/{d.year}/{d.month}/{d.day}/{uuid.uuid4()}{name[dot:] if dot >= 0 else ''}"
