"""CSV and JSON files as entries: (column, value, file), every value a string.

Schemas are read from the files, so files of any layouts may be mixed; columns of one name are one column. Null and empty values
give no entry, nor do nested JSON objects and arrays. A CSV file with a repeated header name gives none (``rejected`` lists
it), neither does a JSON file that can't be parsed. Surplus CSV fields are passed over. Files of other kinds are passed over.

CSV files without quoted line breaks and files of a JSON value a line are read in splits; a CSV file that has a line with an odd number of
quotes, and a JSON file whose first line isn't a whole value, by one task each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import materialised
from ..functions.text import present

ENTRIES = "column string, value string, file string"
#: Headers of at most so many files are broadcast to the rows; beyond it the join shuffles.
BROADCAST_FILES = 100_000
NESTED_ARRAYS = 3  # arrays within arrays that are opened row by row; deeper ones are opened within a row
PARSER_DEPTH = 1000


def _file():
    return F.col("_metadata.file_path")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTRIES)


_RECORD = r'^((?:[^"\r\n]++|"(?:[^"]++|"")*+")*+)'  # the first one of a CSV text


def csv_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, header, names, broken): the first record of each file, its fields, and whether records may go over lines. One scan of the lines,
    of which one row a file and task is shuffled; only files with an odd number of quotes in a line are read whole."""
    lines = spark.read.text(paths).select(_file().alias("file"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2
    files = lines.groupBy("file").agg(F.min_by(F.when(F.col("block") == 0, F.col("value")), F.when(F.col("block") == 0, F.col("at"))).alias("header"), (F.max(odd) > 0).alias("broken"))
    files = materialised(files)
    texts = _whole(spark, paths, files.where("broken"))
    if texts is not None:
        first = texts.select(F.col("file").alias("_of"), F.regexp_extract("value", _RECORD, 1).alias("_record"))
        files = files.join(first, F.col("file") == F.col("_of"), "left").select("file", F.coalesce("_record", "header").alias("header"), "broken")
    first = files.withColumn("header", F.regexp_replace("header", "^\ufeff", ""))
    width = first.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    fields = F.from_csv("header", F.lit(", ".join(f"c{i} string" for i in range(width))), {"mode": "PERMISSIVE", "multiLine": "true", "escape": '"'})
    return first.withColumn("f", fields).select("file", "header", F.filter(F.array(*[F.col(f"f.c{i}") for i in range(width)]), lambda x: x.isNotNull()).alias("names"), "broken")


def _whole(spark: SparkSession, paths: list[str], files: DataFrame) -> DataFrame | None:
    """(file, value): the whole texts of some of the files; None if they are none. The others aren't opened."""
    names = [r[0] for r in files.select("file").collect()]  # of the paths that the caller has listed
    return spark.read.text(paths, wholetext=True).where(_file().isin(names)).select(_file().alias("file"), "value") if names else None


def _doubled(names):
    return F.size(F.array_distinct(names)) < F.size(names)


def csv_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One positional scan of all files, whatever their headers, whose names come by file; one more, a task a file, of those in which records
    may go over lines."""
    headers = materialised(csv_headers(spark, paths))
    count, width = headers.agg(F.count("*"), F.max(F.size("names"))).first()
    if not width:
        return _empty(spark)
    schema = ", ".join(f"c{i} string" for i in range(width))
    broken = [r[0] for r in headers.where("broken").select("file").collect()]
    out = None
    for multiline in (False, True) if broken else (False,):
        named = headers.where(~_doubled(F.col("names")) & (F.col("broken") == multiline)).select(F.col("file").alias("_of"), "names")
        named = F.broadcast(named) if count <= BROADCAST_FILES else named
        rows = spark.read.schema(schema).options(header=True, enforceSchema=True, multiLine=multiline, mode="PERMISSIVE", escape='"').csv(paths)
        if broken:
            rows = rows.where(_file().isin(broken) if multiline else ~_file().isin(broken))
        rows = rows.select(_file().alias("file"), F.array(*[f"c{i}" for i in range(width)]).alias("values"))
        pairs = rows.join(named, F.col("file") == F.col("_of")).select("file", F.explode(F.arrays_zip(F.col("names").alias("column"), F.col("values").alias("value"))).alias("p"))
        found = pairs.select("p.column", "p.value", "file").where(F.col("column").isNotNull() & present(F.col("value")))
        out = found if out is None else out.unionByName(found)
    return out


def _is_array(item) -> Column:
    return F.schema_of_variant(item).startswith("ARRAY")


def _flat(items: Column) -> Column:
    """An array of variants with the items of arrays within it in their place, however deep: the parser takes no deeper nesting."""
    opened = lambda x: F.when(_is_array(x), x.cast("array<variant>")).otherwise(F.array(x))
    step = lambda held, _: F.when(F.exists(held, _is_array), F.flatten(F.transform(held, opened))).otherwise(held)
    return F.aggregate(F.sequence(F.lit(1), F.lit(PARSER_DEPTH)), items, step)


def json_entries(spark: SparkSession, paths: list[str], json_literal: bool = False) -> DataFrame:
    """The scalars of all objects: of one object, an array of them, arrays within arrays, or an object a line. ``json_literal``: values as
    JSON spells them (strings in quotes, so that an empty one counts); else as text."""
    items = _json_items(spark, paths).where("item IS NOT NULL")
    for _ in range(NESTED_ARRAYS):
        flat = F.when(F.schema_of_variant("item").startswith("ARRAY"), F.expr("CAST(item AS ARRAY<VARIANT>)")).otherwise(F.array("item"))
        items = items.select("file", F.explode(flat).alias("item")).where("item IS NOT NULL")
    items = items.select("file", F.explode(F.when(_is_array("item"), _flat(F.array("item"))).otherwise(F.array("item"))).alias("item"))
    objects = items.where(F.schema_of_variant("item").startswith("OBJECT"))
    cells = objects.select("file", F.explode(F.col("item").cast("map<string,variant>")).alias("column", "v")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    scalar = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | kind.startswith("VOID"))
    value = F.to_json("v") if json_literal else F.col("v").cast("string")
    return cells.where(scalar).select("column", value.alias("value"), "file").where(present(F.col("value")))


def _one(text):
    """The only JSON value of a text, as a variant; null if it has none, several or anything else. The parser passes over what follows
    a value, so it is given an array of what should be one."""
    values = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def _json_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, item): the value of each line where the file's first line is a whole value (more can't follow in one document), else the file's
    only value; null where there is none."""
    lines = spark.read.text(paths).select(_file().alias("file"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where(F.trim(F.translate("value", "\t\r", "  ")) != "")
    heads = lines.groupBy("file").agg(F.min_by(F.when(F.col("block") == 0, F.col("value")), F.when(F.col("block") == 0, F.col("at"))).alias("first"))
    heads = materialised(heads.select("file", F.coalesce(_one(F.col("first")).isNotNull(), F.lit(False)).alias("by_line")))
    by_line = heads.where("by_line").select(F.col("file").alias("_of"))
    items = lines.join(by_line, F.col("file") == F.col("_of")).select("file", _one(F.col("value")).alias("item"))
    bad = items.where("item IS NULL").select(F.col("file").alias("_bad")).distinct()
    items = items.join(bad, F.col("file") == F.col("_bad"), "left").select("file", F.when(F.col("_bad").isNull(), F.col("item")).alias("item"))
    texts = _whole(spark, paths, heads.where("NOT by_line"))
    return items if texts is None else items.unionByName(texts.select("file", _one(F.col("value")).alias("item")))


Reader = Callable[[SparkSession, list[str]], DataFrame]
#: The kinds of files that give entries; others may be added.
READERS: dict[str, Reader] = {".csv": csv_entries, ".json": json_entries}


def _kind(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[name.rfind(".") :].lower() if "." in name else ""


def supported(path: str) -> bool:
    return _kind(path) in READERS


def entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The distinct entries of all files of known kinds."""
    out = None
    for kind, reader in READERS.items():
        mine = [p for p in paths if _kind(p) == kind]
        if mine:
            found = reader(spark, mine)
            out = found if out is None else out.unionByName(found)
    return distinct_entries(_empty(spark) if out is None else out)


def distinct_entries(rows: DataFrame) -> DataFrame:
    """Entries that hold something, once each; the partial aggregation drops repeats before the shuffle."""
    return rows.where(present(F.col("value"))).select("column", "value", "file").distinct()


def unpivoted(rows: DataFrame, file, columns: list[str]) -> DataFrame:
    """The cells of a wide table as entries; ``file``: the file of a row, as a column."""
    long = rows.select(F.expr("*"), file.alias("_file")).select("_file", *[F.col(c).cast("string").alias(c) for c in columns])
    return long.unpivot("_file", columns, "column", "value").select("column", "value", F.col("_file").alias("file")).where(present(F.col("value")))


def rejected(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, reason): files that give no entries for a fault of theirs, or are of no known kind."""
    out = spark.createDataFrame([(p, "kind") for p in paths if not supported(p)], "file string, reason string")
    if csv := [p for p in paths if _kind(p) == ".csv"]:
        out = out.unionByName(csv_headers(spark, csv).where(_doubled(F.col("names"))).select("file", F.lit("header").alias("reason")))
    if json := [p for p in paths if _kind(p) == ".json"]:
        out = out.unionByName(_json_items(spark, json).where("item IS NULL").select("file", F.lit("json").alias("reason")).distinct())
    return out
