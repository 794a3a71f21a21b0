"""Quality rules whose cutoffs adapt to each language and source.

Measures of every document (below) are put into logarithmic bins; the counts of the bins are a mergeable quantile sketch
with a bounded relative error: sketches of parts add up, so they are aggregated map-side, and no group meets in one task. For
each (lang, source) the sketch gives the quartiles of a measure, and a document is rejected where a measure lies further beyond a
quartile than ``reach`` times their distance, all in bins: thresholds that move with the group, so clean text of an unusual source
stays. Rates count one event more than there were, so a group in which most documents have none still has quartiles, and its
threshold allows few events in a short text. The distance of the quartiles counts as ``least`` bins at least: for rates a doubling,
which is what one event more makes of none. Groups of fewer than ``LEAST`` documents use the sketch of their language, and that of
all documents if it is small too. Repeated words are judged by the base rule alone.

Nulls: a null text counts as empty; null languages and sources are groups of their own. Texts without words always fail the
base rule (under 20 words). Repeated rows are judged each; an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, same, small_side
from .textkernel import Block, blocks, grams, mix, resting, sums_by, text_bytes

LEAST = 50
BINS_A_DOUBLING = 32


class Measure(NamedTuple):
    name: str
    value: str  # SQL over the counts, above 0
    reach: float
    least: int  # bins
    below: bool  # are too small values rejected as well


MEASURES = (
    Measure("word_length", "greatest(word_chars, 1) / greatest(n_words, 1)", 5.0, 2, True),
    Measure("symbol_rate", "(n_symbols + 1) / (n_words + 1)", 2.0, BINS_A_DOUBLING, False),
    Measure("dup_line_rate", "(n_dup_lines + 1) / (n_lines + 1)", 1.5, BINS_A_DOUBLING, False),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8


def _repeated(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each item: has an equal one of the same text come before; and does any equal one exist."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = mix(hashes ^ (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    before = np.empty(len(key), bool)
    before[order] = again
    both = np.empty(len(key), bool)
    both[order] = again | np.concatenate([again[1:], [False]])
    return before, both


def counts(b: Block) -> list[np.ndarray]:
    """COUNTS of each text of a block."""
    starts, ends, docs = b.lines()
    words_to = np.concatenate([[0], np.cumsum(b.in_word)])
    held = words_to[ends] > words_to[starts]
    starts, ends, docs = starts[held], ends[held], docs[held]
    dup, _ = _repeated(docs, b.spans(starts, ends) ^ mix((ends - starts).astype(np.uint64)))
    gram, at = grams(b.word_hashes(), b.first, WINDOW)
    owner = b.word_docs()
    _, twice = _repeated(owner[at], gram)
    cover = np.zeros(len(b.starts) + WINDOW + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = (np.cumsum(cover)[: len(b.starts)] > 0).astype(np.int64)
    return [
        b.n_words,
        b.per_doc(b.in_word & ((b.buf & 0xC0) != 0x80)),
        b.per_doc(_SYMBOL[b.buf]),
        sums_by(docs, dup, b.n),
        sums_by(owner, covered, b.n),
        sums_by(docs, np.ones(len(docs)), b.n),
    ]


def measured(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` as (_row struct, lang, source, COUNTS...). ``keep``: the columns of the struct (all)."""
    keep = tuple(docs.columns) if keep is None else keep
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), docs["lang"].alias("_lang"), docs["source"].alias("_source"), docs["text"].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(3))
            for start, stop, b in blocks(texts):
                part = batch.slice(start, stop - start)
                made = [pa.array(np.asarray(x).astype(np.int64)) for x in counts(b)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made], names=["_row", "_lang", "_source", *COUNTS])

    row = rows.schema["_row"].dataType.simpleString()
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(resting(run), f"_row {row}, _lang string, _source string, {kinds}")


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _bin(m: Measure) -> str:
    """A measure's bin. Powers of two lie on an edge and belong to the bin above it, however the logarithm is rounded."""
    return f"cast(floor(log2({m.value}) * {BINS_A_DOUBLING} + 1e-6) AS int)"


def sketches(rows: DataFrame) -> DataFrame:
    """(_lang, _source, measure, bin, n): the sketches of documents that pass the base rule. They merge by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("measure"), F.expr(_bin(m)).alias("bin")) for i, m in enumerate(MEASURES)]))
    return rows.where(f"NOT ({BASE_FAILED})").select("_lang", "_source", pairs.alias("m")).groupBy("_lang", "_source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def _fences(merged: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: n, and for each measure the lowest and the highest bin that stay. The windows run over the bins of a group's sketch."""
    w = Window.partitionBy(*by, "measure")
    edge = merged.select(*by, "measure", "bin", "n", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bin")))
    both = edge.groupBy(*by, "measure").agg(F.max("all").alias("n"), quartile(1).alias("low"), quartile(3).alias("high"))
    of = lambda name: F.element_at(F.array(*[F.lit(getattr(m, name)) for m in MEASURES]), F.col("measure") + 1)
    way = of("reach") * F.greatest(of("least"), F.col("high") - F.col("low"))
    both = both.withColumn("most", F.col("high") + way).withColumn("fewest", F.when(of("below"), F.col("low") - way))
    ends = [F.max(F.when(F.col("measure") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(MEASURES)) for c in ("fewest", "most")]
    return both.groupBy(*by).agg(F.max("n").alias("n"), *ends)


ENDS = tuple(f"{c}{i}" for i in range(len(MEASURES)) for c in ("fewest", "most"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """A row for each language and source that the sketch has: fewest0, most0, fewest1, ..., from the smallest group that is large enough."""
    sketch = cut(sketch)
    fine = _fences(sketch, ["_lang", "_source"])
    lang = _fences(sketch.groupBy("_lang", "measure", "bin").agg(F.sum("n").alias("n")), ["_lang"])
    whole = _fences(sketch.groupBy("measure", "bin").agg(F.sum("n").alias("n")).withColumn("_all", F.lit(1)), ["_all"])
    lang = lang.select(F.col("_lang").alias("_l"), F.col("n").alias("_ln"), *[F.col(t).alias(f"l{t}") for t in ENDS])
    all_ = whole.first() or dict.fromkeys(ENDS)  # one row, or none for an empty table
    both = fine.join(lang, same(F.col("_lang"), F.col("_l")))
    pick = lambda t: F.when(F.col("n") >= LEAST, F.col(t)).when(F.col("_ln") >= LEAST, F.col(f"l{t}")).otherwise(F.lit(all_[t]))
    return both.select(F.col("_lang").alias("_tl"), F.col("_source").alias("_ts"), *[pick(t).cast("double").alias(t) for t in ENDS])


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` rows with base_failed and kept."""
    limits = small_side(limits)
    rows = rows.join(limits, same(F.col("_lang"), F.col("_tl")) & same(F.col("_source"), F.col("_ts")), "left").drop("_tl", "_ts")
    within = " AND ".join(f"coalesce({_bin(m)} BETWEEN coalesce(fewest{i}, -1e9) AND most{i}, true)" for i, m in enumerate(MEASURES))
    return rows.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", F.expr(f"NOT ({BASE_FAILED}) AND {within}"))


def verdicts(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed and kept. Texts are read once."""
    rows = cut(measured(docs, ("doc_id",)))
    return judged(rows, thresholds(sketches(rows))).select("_row.doc_id", *COUNTS[:-1], "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Texts are measured twice rather than shuffled once."""
    limits = thresholds(sketches(measured(docs, ())))
    return judged(measured(docs), limits).where("kept").select("_row.*")
