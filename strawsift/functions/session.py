"""Intermediate results in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once, its rows and their partitions fixed from then on. It is written to the folder that the session names
    in spark.checkpoint.dir; where a session on one machine names none (tests), to a temporary one."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if need be. ValueError on a cluster whose session names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not shared:
            shared = tempfile.mkdtemp(prefix="strawsift-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialised``, and the number of rows, counted as they are written; a task that is run again counts again."""
    seen = Observation()
    df = materialised(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return df, seen.get.get("rows", 0)
