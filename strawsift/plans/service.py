"""A lake with its indexes: what callers use to add files and to ask."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import metadata
from ..sources import storage, tables
from ..sources.notifications import Notifications
from ..sources.store import IndexStore, SketchStore
from .models import CardinalityQuery, FrequencyQuery, NeedleInHaystackQuery, UnknownQueryType, parsed
from .needle import needle

log = logging.getLogger("strawsift")


def event(message: str, **properties: Any) -> None:
    """A structured log line; the handler writes its properties as JSON (logs.JsonLines)."""
    log.info(message, extra={"properties": properties})


class Lake:
    """Content below ``root/content``, indexes below ``root/index``, notifications below ``root/notifications``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, storage.qualified(spark, root)
        self.index = IndexStore(spark, f"{self.root}/index/content")
        self.sketches = SketchStore(spark, f"{self.root}/index/metadata")
        self.notifications = Notifications(spark, f"{self.root}/notifications")
        self.executors: dict[str, tuple[type, Callable[[Any], DataFrame]]] = {
            "NeedleInHaystack": (NeedleInHaystackQuery, self.needle),
            "Cardinality": (CardinalityQuery, self.cardinality),
            "Frequency": (FrequencyQuery, self.frequency),
        }

    # asking

    def needle(self, query: NeedleInHaystackQuery) -> DataFrame:
        return needle(self.index.pruned(query.Conditions), query)

    def cardinality(self, query: CardinalityQuery) -> DataFrame:
        return metadata.cardinality(self.sketches.sketches(), query.MetadataKey)

    def frequency(self, query: FrequencyQuery) -> DataFrame:
        return metadata.frequency(self.sketches.sketches(), query.MetadataKey, query.MetadataValue)

    def query(self, kind: str, body: str | dict) -> DataFrame:
        """The result of a query by the exact name of its type; UnknownQueryType or InvalidQueryFormat where it can't be run."""
        if kind not in self.executors:
            raise UnknownQueryType(kind)
        form, execute = self.executors[kind]
        return execute(parsed(form, body))

    def post(self, kind: str, body: str | dict) -> list[dict]:
        """As ``query``, collected, with a query-start and a query-end event."""
        session = str(uuid.uuid4())
        event("query-start", SessionId=session, QueryType=kind)
        rows = [r.asDict() for r in self.query(kind, body).collect()]
        event("query-end", SessionId=session, QueryType=kind, ResultCount=len(rows))
        return rows

    # adding

    def upload(self, local: str, extensions: Iterable[str] = tuple(tables.READERS)) -> str:
        """Copy a local file in, then announce it. ValueError if its extension isn't allowed; the copy goes if it can't be announced."""
        if os.path.splitext(local)[1].lower() not in set(extensions):
            raise ValueError(f"{local}: this kind of file isn't allowed")
        path = storage.content_path(f"{self.root}/content", os.path.basename(local))
        storage.copy_in(self.spark, os.path.abspath(local), path)
        try:
            self.notifications.send([path])
        except Exception:
            storage.delete(self.spark, path)
            raise
        return path

    def register(self, path: str) -> None:
        """Announce an object that is in a store already, of whatever kind."""
        self.notifications.send([storage.qualified(self.spark, path)])

    def upload_folder(self, local: str) -> list[str]:
        """Upload all files below a local folder, of whatever kind."""
        made = []
        for folder, _, names in sorted(os.walk(local)):
            for name in sorted(names):
                made.append(storage.content_path(f"{self.root}/content", name))
                storage.copy_in(self.spark, os.path.abspath(os.path.join(folder, name)), made[-1])
        if made:
            self.notifications.send(made)
        return made

    def reindex(self, prefix: str) -> list[str]:
        """Announce all objects below a prefix."""
        found = storage.names(self.spark, prefix)
        if found:
            self.notifications.send(found)
        return found

    # maintaining

    def index_content(self, paths: list[str], batch: str | None = None) -> None:
        """Add files to the inverted index."""
        known = [p for p in paths if tables.supported(p)]
        ingestion = str(uuid.uuid4())
        event("ingestion-start", IngestionId=ingestion, IngestionType="Content", FilesCount=len(known), TotalSize=self._size(known), Files=known)
        if known:
            self.index.add(tables.entries(self.spark, known), batch)
        event("ingestion-end", IngestionId=ingestion, IngestionType="Content", FilesCount=len(known), TotalSize=self._size(known))

    def index_metadata(self, paths: list[str], batch: str | None = None, extractors: Sequence[metadata.Extractor] | None = None) -> None:
        """Add files' metadata to the sketches; ``extractors`` (such as metadata.CONTENT) read contents, else the file system's facts count."""
        ingestion = str(uuid.uuid4())
        event("ingestion-start", IngestionId=ingestion, IngestionType="Metadata", FilesCount=len(paths), TotalSize=self._size(paths))
        if paths:
            maps = metadata.extracted(self.spark, paths, extractors) if extractors else metadata.file_facts(self.spark, paths)
            self.sketches.add(metadata.pairs(maps), batch)
        event("ingestion-end", IngestionId=ingestion, IngestionType="Metadata", FilesCount=len(paths), TotalSize=self._size(paths))

    def _size(self, paths: list[str]) -> int:
        if not paths:
            return 0
        return int(metadata.batch_metrics(self.spark.read.format("binaryFile").load(paths).select("length")).first()["total"])

    def purge(self) -> None:
        """Delete all indexes; content stays."""
        storage.delete(self.spark, f"{self.root}/index")

    def reset(self) -> None:
        """Delete all notifications and how far they have been read."""
        self.notifications.delete()
        storage.delete(self.spark, f"{self.root}/checkpoints")


class JsonLines(logging.Formatter):
    """Log records as JSON lines: date, level, logger, message, exception, properties."""

    def format(self, record: logging.LogRecord) -> str:
        date = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(record.created)) + f",{int(record.msecs):03d}"
        exception = self.formatException(record.exc_info) if record.exc_info else ""
        return json.dumps({"date": date, "level": record.levelname, "logger": record.name, "message": record.getMessage(), "exception": exception, "properties": getattr(record, "properties", {})})
