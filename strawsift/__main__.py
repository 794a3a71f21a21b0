"""python -m strawsift ROOT ACTION [key=value ...]; without an action: one from each line of input, until exit.

upload file=, upload-folder folder=, register path=, reindex prefix=, index (all announcements), query type= body=, compact, purge, reset, list prefix=
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .functions.text import key_values
from .plans.service import Lake
from .sources import storage
from .streaming import ingest


def _index(lake: Lake) -> None:
    for start in (ingest.start_content, ingest.start_metadata):
        start(lake, once=True).awaitTermination()


ACTIONS: dict[str, Callable[[Lake, dict[str, str]], object]] = {
    "upload": lambda lake, a: lake.upload(a["file"]),
    "upload-folder": lambda lake, a: lake.upload_folder(a["folder"]),
    "register": lambda lake, a: lake.register(a["path"]),
    "reindex": lambda lake, a: lake.reindex(a["prefix"]) if a.get("prefix", "").strip() else None,
    "index": lambda lake, a: _index(lake),
    "query": lambda lake, a: lake.post(a["type"], a["body"]),
    "compact": lambda lake, a: (lake.index.compact(), lake.sketches.compact()),
    "purge": lambda lake, a: lake.purge(),
    "reset": lambda lake, a: lake.reset(),
    "list": lambda lake, a: storage.names(lake.spark, a["prefix"]),
}


def run(lake: Lake, line: list[str]) -> None:
    if not line or line[0] not in ACTIONS:
        print("actions:", ", ".join(ACTIONS))
        return
    out = ACTIONS[line[0]](lake, key_values(line[1:]))
    if out is not None:
        print(json.dumps(out, default=str))


def main(arguments: list[str]) -> int:
    if not arguments:
        print(__doc__)
        return 2
    lake = Lake(SparkSession.builder.appName("strawsift").getOrCreate(), arguments[0])
    if arguments[1:]:
        run(lake, arguments[1:])
        return 0
    for line in sys.stdin:
        if line.strip() == "exit":
            break
        run(lake, line.split())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
