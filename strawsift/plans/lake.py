"""The driver's queries: a deterministic logical lake over its tables, and the operators on it.

Each lake file is a group of rows of a table; its columns are long form already. Values are strings made from strings and whole
numbers only, so they are spelled alike everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sketches
from ..functions.session import materialised, shared_folder
from ..functions.text import joined
from ..operators import durations, inverted, metadata
from ..sources import notifications, tables
from ..sources.store import IndexStore, SketchStore
from .models import Condition, NeedleInHaystackQuery
from .needle import needle

Query = Callable[[SparkSession, str], DataFrame]

#: table, key of its rows, number of files, suffix, columns
LAYOUT = (
    ("events", "event_id", 32, ".json", ("event_type", "user_id")),
    ("orders", "o_orderkey", 32, ".csv", ("o_orderpriority", "o_orderstatus", "o_custkey")),
    ("customer", "c_custkey", 16, ".csv", ("c_mktsegment",)),
    ("documents", "doc_id", 16, ".json", ("lang", "source")),
)
CHUNK_ROWS = 50
ERROR, USER = Condition("event_type", "error"), Condition("user_id", "7")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column, value, file), repeats and all."""
    parts = []
    for name, key, files, suffix, columns in LAYOUT:
        file = F.concat(F.lit(f"{name}/"), (F.col(key) % files).cast("string"), F.lit(suffix))
        parts.append(tables.unpivoted(_table(spark, sf_dir, name), file, list(columns)))
    return reduce(DataFrame.unionByName, parts)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, key, value): metadata of the documents, each a file."""
    docs = _table(spark, sf_dir, "documents")
    meta = F.map_filter(F.create_map(*[x for k in ("lang", "source", "n_chars") for x in (F.lit(k), F.col(k).cast("string"))], F.lit("FilePath"), F.col("doc_id").cast("string")), lambda k, v: v.isNotNull())
    return metadata.pairs(docs.select(F.col("doc_id").cast("string").alias("file"), meta.alias("meta")))


def _col(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("column", "col")


def _hits(df: DataFrame) -> DataFrame:
    return df.select("FileName", joined(F.col("HitValues")).alias("HitValues"))


def _ask(conditions: tuple[Condition, ...], relation: str = "Or") -> Query:
    return lambda s, d: _hits(needle(lake(s, d), NeedleInHaystackQuery(conditions, relation)))


def lake_entries_distinct(s: SparkSession, d: str) -> DataFrame:
    return _col(tables.distinct_entries(lake(s, d)))


def _files(groups: DataFrame) -> DataFrame:
    return _col(groups.select("column", "value", joined(F.col("files")).alias("files"), F.size("files").cast("long").alias("n_files")))


def index_build(s: SparkSession, d: str) -> DataFrame:
    return _files(inverted.grouped(tables.distinct_entries(lake(s, d))))


def index_merge_incremental(s: SparkSession, d: str) -> DataFrame:
    """The index of the files with an even name, merged with that of the others."""
    rows = tables.distinct_entries(lake(s, d))
    half = F.pmod(F.xxhash64("file"), F.lit(2))
    return _files(inverted.merged_groups(inverted.grouped(rows.where(half == 0)), inverted.grouped(rows.where(half == 1))))


def root_index(s: SparkSession, d: str) -> DataFrame:
    return _col(inverted.chunks(lake(s, d), CHUNK_ROWS))


def section_zone_map(s: SparkSession, d: str) -> DataFrame:
    return _col(inverted.zone_map(lake(s, d), CHUNK_ROWS))


def _root(s: SparkSession, d: str) -> DataFrame:
    chunks = inverted.chunks(lake(s, d), CHUNK_ROWS)
    return chunks.select("column", F.col("chunk").cast("string").alias("index_file"), "min", "max", "n_rows")


def value_to_index_file(s: SparkSession, d: str) -> DataFrame:
    """The file of every value of every column, and that of a value past the end of each."""
    asked = lake(s, d).select("column", "value").distinct()
    past = asked.groupBy("column").agg(F.concat(F.max("value"), F.lit("~")).alias("value"))
    return _col(inverted.ceiling(asked.unionByName(past), _root(s, d)))


def root_upsert(s: SparkSession, d: str) -> DataFrame:
    """New ranges for the first file of each column."""
    root = _root(s, d).select("column", "index_file", "min", "max")
    update = root.where("index_file = '0'").select("column", "index_file", F.lit("").alias("min"), F.concat("max", F.lit("~")).alias("max"))
    return _col(inverted.ranges_upserted(root, update))


def needle_and_cross_row(s: SparkSession, d: str) -> DataFrame:
    """Files that meet both conditions though no row of them does."""
    both = needle(lake(s, d), NeedleInHaystackQuery((ERROR, USER), "And"))
    rows = _table(s, d, "events").where("event_type = 'error' AND user_id = 7")
    rows = rows.select(F.concat(F.lit("events/"), (F.col("event_id") % 32).cast("string"), F.lit(".json")).alias("FileName"))
    return both.join(rows, "FileName", "left_anti").select("FileName")


def needle_absent(s: SparkSession, d: str) -> DataFrame:
    found = needle(lake(s, d), NeedleInHaystackQuery((Condition("event_type", "no such"), Condition("no_such", "error"))))
    return found.agg(F.count("*").alias("n"))


def metadata_grouping(s: SparkSession, d: str) -> DataFrame:
    return metadata.by_key(facts(s, d))


def cardinality_hll(s: SparkSession, d: str) -> DataFrame:
    """From sketches of two halves, merged."""
    rows = facts(s, d)
    half = F.pmod(F.xxhash64("file"), F.lit(2))
    parts = metadata.sketched(rows.where(half == 0)).unionByName(metadata.sketched(rows.where(half == 1)))
    made = parts.groupBy("key").agg(sketches.hll_estimate(sketches.hll_merge(F.col("hll"))).alias("estimate"))
    exact = rows.groupBy("key").agg(F.count_distinct("value").alias("exact"))
    within = F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")
    return exact.join(made, "key").select("key", "exact", within.alias("within_3pct"))


def _estimated(rows: DataFrame) -> DataFrame:
    """Estimates from sketches of two halves, merged, against exact counts."""
    rows = materialised(rows)
    half = F.pmod(F.xxhash64("file"), F.lit(2))
    parts = metadata.sketched(rows.where(half == 0)).unionByName(metadata.sketched(rows.where(half == 1)))
    made = sketches.cms_estimates(rows, sketches.cms_merged(parts))
    exact = rows.groupBy("key", "value").agg(F.count("*").alias("exact"))
    return exact.join(made, ["key", "value"]).select("key", "value", "exact", (F.col("estimate") >= F.col("exact")).alias("est_ge_exact"))


def frequency_cms(s: SparkSession, d: str) -> DataFrame:
    """Of every key."""
    return _estimated(facts(s, d))


def frequency_exact(s: SparkSession, d: str) -> DataFrame:
    return facts(s, d).groupBy("key", "value").agg(F.count("*").alias("n"))


def batch_metrics(s: SparkSession, d: str) -> DataFrame:
    """A micro-batch of all documents' files: how many, and their characters."""
    files = _table(s, d, "documents").groupBy((F.col("doc_id") % 16).alias("file")).agg(F.sum("n_chars").alias("length"))
    return metadata.batch_metrics(files)


def log_pairing(s: SparkSession, d: str) -> DataFrame:
    """Events as a log: even rows start what the odd one after them ends."""
    rows = _table(s, d, "events").select(
        F.expr("event_id div 2").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("message"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("line"),
        F.col("event_type").alias("type"),
        (F.col("user_id") % 5).alias("n"),
    )
    return durations.paired(rows, "start", "end").select("id", "type", F.col("duration").alias("duration_s"), "n")


def topic_except(s: SparkSession, d: str) -> DataFrame:
    return notifications.topics_except(_table(s, d, "events").select(F.col("event_type").alias("topic")), ["error"])


def hit_union(s: SparkSession, d: str) -> DataFrame:
    """How often each condition of a wide query is hit: rows before they are grouped by file."""
    from .needle import hits

    asked = tuple(Condition("lang", x) for x in ("en", "de", "fr", "es")) + (ERROR, Condition("o_orderstatus", "F"))
    return hits(lake(s, d), asked).groupBy("idx", "value").agg(F.count("*").alias("n"))


def _folder(s: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(s)}/lake-{uuid.uuid4().hex}"


def index_store_needle(s: SparkSession, d: str) -> DataFrame:
    """The flagship query over an index on disk, of which only the files that may hold a value are read."""
    store = IndexStore(s, _folder(s), rows=500, groups=1)
    store.add(lake(s, d))
    return _hits(needle(store.pruned((ERROR, USER)), NeedleInHaystackQuery((ERROR, USER), "And")))


def index_store_incremental(s: SparkSession, d: str) -> DataFrame:
    """An index on disk of two batches, one of which comes again, and its compaction."""
    store, rows = IndexStore(s, _folder(s)), lake(s, d)
    half = F.pmod(F.xxhash64("file"), F.lit(2))
    for i, name in ((0, "even"), (1, "odd"), (0, "even")):
        store.add(rows.where(half == i), name)
    store.compact()
    return _col(store.entries())


def _written(s: SparkSession, d: str, kind: str) -> DataFrame:
    """Orders in a file for each residue of their key, written as ``kind`` and read by its reader; a note holds quotes and line breaks."""
    folder = _folder(s)
    note = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"\n,'), F.col("o_orderkey") % 3)
    rows = _table(s, d, "orders").select((F.col("o_orderkey") % 8).alias("f"), "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string").alias("o_custkey"), note.alias("note"))
    rows.repartition("f").write.partitionBy("f").format(kind).options(header=True, escape='"').save(folder)
    found = tables.READERS[f".{kind}"](s, [folder])
    return _col(tables.distinct_entries(found.withColumn("file", F.regexp_extract("file", "f=([0-9]+)", 1))))


def csv_files_entries(s: SparkSession, d: str) -> DataFrame:
    return _written(s, d, "csv")


def json_files_entries(s: SparkSession, d: str) -> DataFrame:
    return _written(s, d, "json")


def sketch_store_frequency(s: SparkSession, d: str) -> DataFrame:
    """Estimates from sketches on disk, of two batches, against exact counts."""
    rows, store = materialised(facts(s, d)), SketchStore(s, _folder(s))
    half = F.pmod(F.xxhash64("file"), F.lit(2))
    for i, name in ((0, "even"), (1, "odd"), (1, "odd")):
        store.add(rows.where(half == i), name)
    store.compact()
    made = sketches.cms_estimates(rows, sketches.cms_merged(store.sketches()))
    exact = rows.groupBy("key", "value").agg(F.count("*").alias("exact"))
    return exact.join(made, ["key", "value"]).select("key", "value", "exact", F.col("estimate").between(F.col("exact"), 1.1 * F.col("exact") + 0.1 * F.sum("exact").over(Window.partitionBy("key"))).alias("within_bound"))


def queries() -> dict[str, Query]:
    return {
        "index_store_needle": index_store_needle,
        "index_store_incremental": index_store_incremental,
        "csv_files_entries": csv_files_entries,
        "json_files_entries": json_files_entries,
        "sketch_store_frequency": sketch_store_frequency,
        "lake_entries_distinct": lake_entries_distinct,
        "index_build": index_build,
        "index_merge_incremental": index_merge_incremental,
        "root_index": root_index,
        "section_zone_map": section_zone_map,
        "value_to_index_file": value_to_index_file,
        "root_upsert": root_upsert,
        "needle_or": _ask((ERROR, USER)),
        "needle_and": _ask((ERROR, USER), "And"),
        "needle_and_cross_row": needle_and_cross_row,
        "needle_duplicate_condition": _ask((ERROR, USER, ERROR)),
        "needle_unknown_relation": lambda s, d: _ask((ERROR,), "Xor")(s, d).agg(F.count("*").alias("n")),
        "needle_absent": needle_absent,
        "hit_union": hit_union,
        "metadata_grouping": metadata_grouping,
        "cardinality_hll": cardinality_hll,
        "frequency_cms": frequency_cms,
        "frequency_exact": frequency_exact,
        "batch_metrics": batch_metrics,
        "log_pairing": log_pairing,
        "topic_except": topic_except,
    }


def oracle_sql() -> dict[str, str]:
    entries = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, '{t}/' || ({k} % {n}) || '{x}' AS file FROM {t}" for t, k, n, x, cs in LAYOUT for c in cs)
    e = f"e AS (SELECT DISTINCT * FROM ({entries}) WHERE value IS NOT NULL AND value <> '')"
    m = "m AS (SELECT doc_id AS file, key, value FROM (SELECT doc_id, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents) WHERE value IS NOT NULL)"
    ranked = "v AS (SELECT DISTINCT col, value FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS k FROM v)"
    root = f"root AS (SELECT col, k // {CHUNK_ROWS} AS chunk, min(value) AS min, max(value) AS max FROM r GROUP BY ALL)"

    def ask(conditions: tuple[Condition, ...], having: str = "") -> str:
        rows = ", ".join(f"({i}, '{c.ColumnName}', '{c.Value}')" for i, c in enumerate(conditions))
        return f"WITH {e}, c(idx, col, value) AS (VALUES {rows}) SELECT file AS FileName, string_agg(value, ';' ORDER BY idx) AS HitValues FROM e JOIN c USING (col, value) GROUP BY file {having}"

    index = f"WITH {e} SELECT col, value, string_agg(file, ';' ORDER BY file) AS files, count(*) AS n_files FROM e GROUP BY ALL"
    wide = tuple(Condition("lang", x) for x in ("en", "de", "fr", "es")) + (ERROR, Condition("o_orderstatus", "F"))
    written = "SELECT DISTINCT col, value, file FROM (SELECT CAST(o_orderkey % 8 AS VARCHAR) AS file, unnest([{'col': 'o_orderpriority', 'value': o_orderpriority}, {'col': 'o_orderstatus', 'value': o_orderstatus}, {'col': 'o_custkey', 'value': CAST(o_custkey AS VARCHAR)}, {'col': 'note', 'value': '\"' || o_orderstatus || '\"' || chr(10) || ',' || (o_orderkey % 3)}], recursive := true) FROM orders) WHERE value <> ''"
    return {
        "index_store_needle": ask((ERROR, USER), "HAVING count(*) = 2"),
        "index_store_incremental": f"WITH {e} SELECT * FROM e",
        "csv_files_entries": written,
        "json_files_entries": written,
        "sketch_store_frequency": f"WITH {m} SELECT key, value, count(*) AS exact, TRUE AS within_bound FROM m GROUP BY ALL",
        "lake_entries_distinct": f"WITH {e} SELECT * FROM e",
        "index_build": index,
        "index_merge_incremental": index,
        "root_index": f"WITH {e}, {ranked} SELECT col, k // {CHUNK_ROWS} AS chunk, min(value) AS min, max(value) AS max, count(*) AS n_rows FROM r GROUP BY ALL",
        "section_zone_map": f"WITH {e}, {ranked} SELECT col, k // {CHUNK_ROWS + 1} AS section, min(value) AS min, max(value) AS max, count(*) AS n_rows FROM r GROUP BY ALL",
        "value_to_index_file": f"WITH {e}, {ranked}, {root}, a AS (SELECT col, value FROM v UNION ALL SELECT col, max(value) || '~' FROM v GROUP BY col) SELECT a.col, a.value, coalesce((SELECT CAST(arg_min(chunk, max) AS VARCHAR) FROM root WHERE root.col = a.col AND root.max >= a.value), '{inverted.END_OF_INDEX}') AS index_file FROM a",
        "root_upsert": f"WITH {e}, {ranked}, {root} SELECT col, CAST(chunk AS VARCHAR) AS index_file, CASE WHEN chunk = 0 THEN '' ELSE min END AS min, CASE WHEN chunk = 0 THEN max || '~' ELSE max END AS max FROM root",
        "needle_or": ask((ERROR, USER)),
        "needle_and": ask((ERROR, USER), "HAVING count(*) = 2"),
        "needle_and_cross_row": f"SELECT FileName FROM ({ask((ERROR, USER), 'HAVING count(*) = 2')}) EXCEPT SELECT 'events/' || (event_id % 32) || '.json' FROM events WHERE event_type = 'error' AND user_id = 7",
        "needle_duplicate_condition": ask((ERROR, USER, ERROR)),
        "needle_unknown_relation": "SELECT CAST(0 AS BIGINT) AS n",
        "needle_absent": f"SELECT count(*) AS n FROM ({ask((Condition('event_type', 'no such'), Condition('no_such', 'error')))})",
        "hit_union": f"WITH {e}, c(idx, col, value) AS (VALUES {', '.join(f"({i}, '{c.ColumnName}', '{c.Value}')" for i, c in enumerate(wide))}) SELECT idx, value, count(*) AS n FROM e JOIN c USING (col, value) GROUP BY ALL",
        "metadata_grouping": f"WITH {m} SELECT key, count(*) AS n_values, count(DISTINCT value) AS n_distinct FROM m GROUP BY key",
        "cardinality_hll": f"WITH {m} SELECT key, count(DISTINCT value) AS exact, TRUE AS within_3pct FROM m GROUP BY key",
        "frequency_cms": f"WITH {m} SELECT key, value, count(*) AS exact, TRUE AS est_ge_exact FROM m GROUP BY ALL",
        "frequency_exact": f"WITH {m} SELECT key, value, count(*) AS n FROM m GROUP BY ALL",
        "batch_metrics": "SELECT count(DISTINCT doc_id % 16) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total FROM documents",
        "log_pairing": "SELECT b.event_id // 2 AS id, b.event_type AS type, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000 AS duration_s, b.user_id % 5 AS n FROM events a JOIN events b ON a.event_id % 2 = 0 AND b.event_id = a.event_id + 1 AND (a.ts, a.event_id) < (b.ts, b.event_id) WHERE b.user_id % 5 <> 0",
        "topic_except": "SELECT event_type AS topic FROM events EXCEPT SELECT 'error'",
    }
