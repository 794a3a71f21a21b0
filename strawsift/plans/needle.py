"""Which files hold a value in a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Condition, NeedleInHaystackQuery


def _matches(index: DataFrame, conditions: tuple[Condition, ...]) -> DataFrame:
    """(file, value, idx) for each row that a condition holds for. One equality filter on the index, which reaches the Parquet scan
    (row-group ranges, dictionaries, Bloom filters); the conditions, as many as the query has, are a literal in the plan. A condition that
    is listed twice matches twice."""
    asked = [(F.col("column") == c.ColumnName) & (F.col("value") == c.Value) for c in dict.fromkeys(conditions)]
    listed = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c.ColumnName).alias("column"), F.lit(c.Value).alias("value")) for i, c in enumerate(conditions)])
    mine = F.filter(listed, lambda c: (c["column"] == F.col("column")) & (c["value"] == F.col("value")))
    return index.where(reduce(lambda a, b: a | b, asked)).select("file", F.explode(mine).alias("c")).select("file", "c.value", "c.idx")


def hits(index: DataFrame, conditions: tuple[Condition, ...]) -> DataFrame:
    """(file, value, idx): for each condition the files that hold its value, once each."""
    return _matches(index, conditions).distinct()


def needle(index: DataFrame, query: NeedleInHaystackQuery) -> DataFrame:
    """(FileName, HitValues): files that meet the query, with the values that were hit, in the order of the conditions.

    ``index``: rows (column, value, file). Conditions are met by a file, not by a row of it. A relation other than And and Or
    gives nothing, as do columns and values that the lake doesn't have.
    """
    query.validated()
    # a file's set is as large as the query; repeats fall away map-side, in the one shuffle there is
    by_file = _matches(index, query.Conditions).groupBy("file").agg(F.collect_set(F.struct("idx", "value")).alias("found"))
    if query.Relation == "And":
        by_file = by_file.where(F.size("found") == len(query.Conditions))
    elif query.Relation != "Or":
        by_file = by_file.limit(0)
    values = F.transform(F.array_sort("found"), lambda x: x["value"])
    return by_file.select(F.col("file").alias("FileName"), values.alias("HitValues"))
