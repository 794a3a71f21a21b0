"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. Sources, by code point and with null last, get the weights in turn; their targets share all words by
weight, held to ``cap`` times the source's own words, the excess going to the others by weight (water-filling, solved over
one row a source). Documents have weights too, whole numbers from 1 to ``HEAVIEST`` (by default 1 under 64 words, 2 under 256, else 3:
short texts are less often wanted). A document's expected copies are its weight times a level of its source, ``cap`` at most; the
level is such that the source's expected words are its target (solved over a row a source and weight). The whole part is certain,
the fraction p is sampled. Pareto order sampling ranks the documents of a source by ``odds(u) / odds(p)``, u being a hash of the
document's id, its text and a seed, and takes them in this order until the source's words come nearest to its target.

A source's order is cut without sorting the source: a histogram of the rank (``BINS`` bins) finds the bin in which the cut
falls, and only that bin is ranked, rows of one id and text together; the cut then is a number for each source, so every row decides
for itself. Where it falls among rows of one id and text, as many of those are taken as come nearest to the target, by their
places in their partitions. DataFrame functions only. A null text or one without words has size 0 and adds nothing; a null id
counts as the empty string; a null weight as 1; an empty table gives an empty one. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, same, small_side

WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 1024
SEED = "mix-1"
HEAVIEST = 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_size(size: Column) -> Column:
    """The weight that a document has unless it is given one."""
    return F.when(size < 64, 1).when(size < 256, 2).otherwise(3)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (_source, _size): a row for each source with source_size and target. The windows run over one row a source."""
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    row = totals.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long"))
    row = row.withColumn("_most", F.lit(cap) * F.col("source_size"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("_most") / F.col("_w"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    row = row.withColumn("_level", (F.sum("source_size").over(every) - past("_most")) / (F.sum("_w").over(every) - past("_w")))
    row = row.withColumn("_full", F.col("_most") <= F.col("_w") * F.col("_level"))
    row = row.withColumn("_level", F.max(F.when(~F.col("_full"), F.col("_level"))).over(every))
    target = F.when(F.col("_full"), F.col("_most").cast("double")).otherwise(F.col("_w") * F.col("_level"))
    return row.select("_source", "source_size", target.alias("target"))


def levels(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_source, _weight, source_size, target, _copies): the expected copies of the documents of each source and weight."""
    goal = targets(sizes, weights, cap).withColumnRenamed("_source", "_of")
    each = sizes.groupBy("_source", "_weight").agg(F.sum("_size").alias("_words"))
    each = each.join(goal, same(F.col("_source"), F.col("_of"))).drop("_of")
    order = Window.partitionBy("_source").orderBy(F.col("_weight").desc())
    heavier, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - F.lit(cap) * F.coalesce(F.sum("_words").over(heavier), F.lit(0))
    share = F.sum(F.col("_weight") * F.col("_words")).over(rest)
    each = each.withColumn("_left", left).withColumn("_share", share)
    each = each.withColumn("_level", F.when(F.col("_share") > 0, F.col("_left") / F.col("_share")).otherwise(0.0))
    each = each.withColumn("_full", F.col("_level") * F.col("_weight") >= cap)
    each = each.withColumn("_level", F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy("_source")))
    copies = F.when(F.col("_full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.col("_level") * F.col("_weight"))))
    return each.select("_source", "_weight", "source_size", "target", copies.alias("_copies"))


def odds(p: Column) -> Column:
    return p / (1 - p)


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1): 52 bits of the MD5 of seed, id and text."""
    own = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, text)]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *own)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds the certain copies, and for documents with a fraction left their rank, its bin and what they are ordered by."""
    part = F.col("_copies") - F.floor("_copies")
    rows = rows.withColumn("_whole", F.floor("_copies").cast("long")).withColumn("_rank", F.when(part > 0, odds(F.col("_u")) / odds(part)))
    tie = F.struct(F.col("_rank").alias("rank"), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("id"), F.col("_size").alias("size"))
    return rows.withColumn("_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BINS)).withColumn("_tie", tie)


def cuts(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (_source, _id, _size, _u, _weight): the levels with ``_at``, the last rows that each source takes, their bin, their number
    _of and how many of them it takes."""
    goal = small_side(levels(sizes, weights, cap))
    own = sizes.withColumnRenamed("_source", "_key").withColumnRenamed("_weight", "_kw")
    rows = _ranked(own.join(goal, same(F.col("_key"), F.col("_source")) & (F.col("_kw") == F.col("_weight"))).drop("_key", "_kw"))
    certain = rows.groupBy(F.col("_source").alias("_s")).agg(F.sum(F.col("_whole") * F.col("_size")).alias("_certain"), F.first("target").alias("_t"))
    rests = small_side(certain.select("_s", (F.col("_t") - F.col("_certain")).alias("_rest")))
    rows = rows.where("_rank IS NOT NULL")
    bins = rows.groupBy("_source", "_bin").agg(F.sum("_size").alias("_size"))
    upto = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_through", F.sum("_size").over(upto))
    bins = bins.join(rests, same(F.col("_source"), F.col("_s"))).drop("_s")
    crossing = bins.where("_through > _rest").groupBy("_source", "_rest").agg(F.min(F.struct("_bin", (F.col("_through") - F.col("_size")).alias("_past"))).alias("_c"))
    crossing = small_side(crossing.select(F.col("_source").alias("_s"), "_rest", F.col("_c._bin").alias("_b"), F.col("_c._past").alias("_past")))
    inside = rows.join(crossing, same(F.col("_source"), F.col("_s")) & (F.col("_bin") == F.col("_b"))).groupBy("_source", "_rest", "_past", F.col("_tie").alias("_at")).agg(F.sum("_size").alias("_n"), F.count("*").alias("_of"))
    ahead = Window.partitionBy("_source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    space = F.col("_rest") - F.col("_past") - F.coalesce(F.sum("_n").over(ahead), F.lit(0))
    some = F.when(F.col("_n") > 0, F.floor(space / F.col("_at.size") + 0.5)).when(space >= 0, F.col("_of")).otherwise(0)
    inside = inside.withColumn("_takes", F.least(F.col("_of"), some).cast("long"))
    last = inside.where("_takes > 0").groupBy("_source").agg(F.max(F.struct("_at", "_of", "_takes")).alias("_l"))
    last = last.select(F.col("_source").alias("_s"), "_l._at", "_l._of", "_l._takes")
    out = goal.join(crossing.select(F.col("_s").alias("_s2"), "_b"), same(F.col("_source"), F.col("_s2")), "left").drop("_s2")
    return out.join(last, same(F.col("_source"), F.col("_s")), "left").drop("_s")


def _needed(seed: str, weight: Column | None) -> list[Column]:
    """What a mix needs of each document."""
    size = words(F.col("text"))
    own = by_size(size) if weight is None else F.greatest(F.lit(1), F.least(F.lit(HEAVIEST), F.coalesce(weight, F.lit(1))))
    return [F.col("source").alias("_source"), F.col("doc_id").alias("_id"), size.alias("_size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("_u"), own.cast("long").alias("_weight")]


def sized(docs: DataFrame, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """Source, id, size, random number and weight of each document. Computed once, without the texts."""
    return cut(docs.select(*_needed(seed, weight)))


def copies(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` (_source, _id, _size, _u, _weight and others) with source_size, target and ``_times``, the copies the mix takes."""
    own = rows.withColumnRenamed("_source", "_key").withColumnRenamed("_weight", "_kw")
    rows = _ranked(own.join(goal, same(F.col("_key"), F.col("_source")) & (F.col("_kw") == F.col("_weight"))))
    at = (F.col("_bin") == F.col("_b")) & (F.col("_tie") == F.col("_at"))
    ahead = F.col("_b").isNull() | (F.col("_bin") < F.col("_b")) | ((F.col("_bin") == F.col("_b")) & (F.col("_tie") < F.col("_at")))
    fine = lambda c: F.coalesce(F.col("_rank").isNotNull() & c, F.lit(False))
    more = lambda df, c: df.withColumn("_times", F.col("_whole") + F.when(c, 1).otherwise(0))
    if not goal.where("_takes < _of").limit(1).count():
        return more(rows, fine(ahead | at))
    # some of the rows of one id and text: by their numbers in their partitions, which the checkpoint keeps
    mid = F.monotonically_increasing_id()
    tied = cut(rows.where(fine(at)).withColumn("_mid", mid).withColumn("_part", F.shiftright("_mid", 33)))
    parts = tied.groupBy(F.col("_source").alias("_ps"), F.col("_part").alias("_pp")).agg(F.count("*").alias("_pn"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_pn").over(Window.partitionBy("_ps").orderBy("_pp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = small_side(parts)
    tied = tied.join(parts, same(F.col("_source"), F.col("_ps")) & (F.col("_part") == F.col("_pp")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_mid"))
    tied = more(tied, place <= F.col("_takes"))
    rest = more(rows.where(~fine(at)), fine(ahead))
    return rest.unionByName(tied.select(*rest.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` (its own columns), each as often as the mix takes it. ``weight``: of each document, a whole
    number from 1 to HEAVIEST (others are brought there)."""
    goal = small_side(cuts(sized(docs, seed, weight), weights, cap))
    kept = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = copies(docs.select(kept, *_needed(seed, weight)), goal).where("_times > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target and taken (its words in the mix)."""
    rows = sized(docs, seed, weight)
    out = copies(rows, small_side(cuts(rows, weights, cap)))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_times") * F.col("_size")).alias("taken"))
