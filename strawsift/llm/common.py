"""What the corpus operators share: checkpoints, checked broadcasts, table reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import counted
from ..functions.session import materialised as cut

__all__ = ["BROADCAST_ROWS", "WORD", "counted", "cut", "same", "sieved", "small_side", "table"]

#: Largest number of rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bits of a sieve: 4 MB, whatever goes into it. _PAGE of them are one row, the size of the built-in bitmaps.
SIEVE_BITS, _PAGE = 1 << 25, 1 << 15

#: White space of all word rules here: space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, computed, with a broadcast hint if it has at most ``rows`` rows; else left to a shuffled join."""
    df, n = counted(df)
    return F.broadcast(df) if n <= rows else df


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def sieved(rows: DataFrame, key: list[str], wanted: DataFrame, bits: int | None = None) -> DataFrame:
    """``rows`` with ``_maybe``: may the columns ``key`` be a row of ``wanted``? True for all that are, nulls included, and false for nearly
    all others while ``wanted`` has far fewer rows than the sieve has bits; a full sieve says true of everything. So a join need
    not shuffle the wide rows that it has no use for, and what is broadcast has one bound at every size."""
    bits = bits or SIEVE_BITS
    slot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))
    page, bit = F.expr(f"_slot div {_PAGE}"), F.expr(f"_slot % {_PAGE}")
    pages = wanted.select(slot(wanted.columns).alias("_slot")).select(page.alias("_page"), bit.alias("_bit")).repartition("_page").distinct()
    pages = pages.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_sieve"))
    byte = F.conv(F.hex(F.substring("_sieve", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_slot", slot(key)).join(F.broadcast(pages), page == F.col("_page"), "left")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias("_maybe"))
