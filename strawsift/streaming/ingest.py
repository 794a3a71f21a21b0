"""Micro-batch maintenance of a lake's indexes: two independent consumers of one stream of announcements."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.metadata import Extractor
from ..plans.service import Lake

INTERVAL = "5 seconds"


def _consume(stream: DataFrame, name: str, checkpoint: str, handle: Callable[[list[str], str], None], once: bool) -> StreamingQuery:
    def batch(rows: DataFrame, number: int) -> None:
        paths = sorted(r[0] for r in rows.select("value").where("value <> ''").distinct().collect())  # as many as a trigger takes: notifications bound both files and their paths
        if paths:
            handle(paths, f"{name}-{number}-{hashlib.sha256(chr(10).join(paths).encode()).hexdigest()[:16]}")

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def start_content(lake: Lake, once: bool = False, stream: DataFrame | None = None) -> StreamingQuery:
    """Keep the inverted index up to date. A batch that is run again after a failure is in the index at most once: its name is
    part of the version that holds its rows. ``once``: all announcements that are there, then stop."""
    return _consume(stream or lake.notifications.stream(), "content", f"{lake.root}/checkpoints/content", lake.index_content, once)


def start_metadata(lake: Lake, once: bool = False, extractors: list[Extractor] | None = None, stream: DataFrame | None = None) -> StreamingQuery:
    """Keep the metadata sketches up to date."""
    handle = lambda paths, batch: lake.index_metadata(paths, batch, extractors)
    return _consume(stream or lake.notifications.stream(), "metadata", f"{lake.root}/checkpoints/metadata", handle, once)
