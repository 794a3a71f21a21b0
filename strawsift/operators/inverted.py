"""The inverted index of a lake: which files hold a value in a column.

Its physical form is one row for each (column, value, file), sorted, so that a value which every file holds is many rows in
several partitions rather than one array that outgrows a task; ``grouped`` gives the logical form, a set of files for each value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import materialised

MAX_ROWS = 50_000  # of an index file
SECTION_ROWS = 1000
END_OF_INDEX = "__END_OF_INDEX__"


def grouped(entries: DataFrame) -> DataFrame:
    """(column, value, files): the sorted set of files of each value."""
    return entries.groupBy("column", "value").agg(F.array_sort(F.collect_set("file")).alias("files"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two indexes in physical form."""
    return old.unionByName(new).distinct()


def merged_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two indexes in logical form: sets of files of equal values are united."""
    both = old.unionByName(new).groupBy("column", "value")
    return both.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))


def laid_out(entries: DataFrame, rows: int = MAX_ROWS, count: int | None = None) -> DataFrame:
    """Sorted ranges of about ``rows`` rows, as an index is written."""
    n = entries.count() if count is None else count
    parts = max(1, -(-n // rows))
    return entries.repartitionByRange(parts, "column", "value", "file").sortWithinPartitions("column", "value", "file")


def chunks(values: DataFrame, rows: int = MAX_ROWS) -> DataFrame:
    """(column, chunk, min, max, n_rows): the ranges of ``rows`` sorted values that a column's logical index files hold.

    Ranks are exact without sorting a column in one task: values are dealt in ranges, each range is counted, and a value's rank is its
    place in its range after all values of the ranges before.
    """
    return _numbered(values).groupBy("column", F.floor((F.col("_rank") - 1) / rows).cast("long").alias("chunk")).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n_rows"))


def zone_map(values: DataFrame, rows: int = SECTION_ROWS) -> DataFrame:
    """(column, section, min, max, n_rows): sections of one row more than the setting, as the format has them."""
    return chunks(values, rows + 1).withColumnRenamed("chunk", "section")


def _numbered(values: DataFrame) -> DataFrame:
    """(column, value, _rank): the rank of each distinct value in its column, from 1."""
    ranged = values.select("column", "value").distinct().repartitionByRange("column", "value")
    ranged = materialised(ranged.withColumn("_part", F.spark_partition_id()))  # another sample would give other ranges
    place = Window.partitionBy("_part", "column").orderBy("value")
    local = ranged.withColumn("_place", F.row_number().over(place))
    sizes = local.groupBy("column", "_part").agg(F.max("_place").alias("_n"))
    ahead = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("column").alias("_c"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    out = local.join(before, (F.col("column") == F.col("_c")) & (F.col("_part") == F.col("_p")))
    return out.select("column", "value", (F.col("_before") + F.col("_place")).alias("_rank"))


def ranges(files: DataFrame) -> DataFrame:
    """(column, index_file, min, max, n_rows): the root index over rows (column, value, index_file)."""
    return files.groupBy("column", "index_file").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n_rows"))


def ordered_ranges(root: DataFrame) -> DataFrame:
    """A root index by (column, max), of equal ones the first file."""
    least = root.groupBy("column", "max").agg(F.min_by(F.struct(*[c for c in root.columns if c not in ("column", "max")]), "index_file").alias("r"))
    return least.select("column", "max", "r.*").select(*root.columns).orderBy("column", "max")


def ranges_upserted(root: DataFrame, update: DataFrame) -> DataFrame:
    """A root index with the rows of each (column, index_file) in ``update`` put in place of its own."""
    kept = root.join(update.select("column", "index_file").distinct(), ["column", "index_file"], "left_anti")
    return kept.unionByName(update)


def ceiling(values: DataFrame, root: DataFrame, file: str = "index_file") -> DataFrame:
    """``values`` (column, value) with the index file that a value belongs to: that of the least max no less than it, or
    END_OF_INDEX where a value is past all of its column.

    A running minimum over both sides' rows in descending order, range by range, rather than a join on an inequality; so neither
    side has to be small, and a column of any size is dealt over many tasks.
    """
    marks = root.select("column", F.col("max").alias("value"), F.lit(0).alias("_asked"), F.col(file).cast("string").alias("_file"))
    asked = values.select("column", "value").distinct().select("column", "value", F.lit(1).alias("_asked"), F.lit(None).cast("string").alias("_file"))
    both = materialised(marks.unionByName(asked).repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id()))
    # of equal values the marks come first, the least file last of them. Both windows run downwards and look back: Spark adds up such a
    # frame as it goes on, but starts anew at every row for one that ends at the last row, which takes the square of a range's rows
    inside = Window.partitionBy("_part", "column").orderBy(F.col("value").desc(), "_asked", F.col("_file").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_here", F.last("_file", ignorenulls=True).over(inside))
    heads = both.where("_asked = 0").groupBy("column", "_part").agg(F.min(F.struct("value", "_file")).alias("_h"))
    # what lies in later ranges of the column: one row a range and column
    parts = both.select("column", "_part").distinct().join(heads, ["column", "_part"], "left")
    later = Window.partitionBy("column").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    next_ = parts.select(F.col("column").alias("_c"), F.col("_part").alias("_p"), F.last("_h._file", ignorenulls=True).over(later).alias("_next"))
    found = both.where("_asked = 1").join(next_, (F.col("column") == F.col("_c")) & (F.col("_part") == F.col("_p")))
    return found.select("column", "value", F.coalesce("_here", "_next", F.lit(END_OF_INDEX)).alias(file))
