"""Line dedup over overlapping windows of three lines.

Lines come from a newline split; lines without a word are passed over, and white space at a line's ends doesn't count. Every three
consecutive lines that are left make a window. Of all windows with the same hash, over all documents, the first stays, by
(doc_id, hash of the text, line); each later one covers its three lines, and all covered lines of a document are removed
together. So whatever is removed still stands where it came first. Documents of fewer than three such lines stay as they are.

Only windows are shuffled for the search: equal ones are counted map-side first, and a window that very many documents hold is
split by the adaptive join. Nulls: a null text has no lines and stays null; null ids come first. Rows equal in id and text
are one document to the search (all keep what one of them keeps). An empty table gives an empty one; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, same, sieved
from .textkernel import Block, blocks, grams, resting, text_bytes

LINES = 3


def _windows(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and the numbers (in its text) of the lines, for each window of a block."""
    starts, ends, docs = b.lines()
    number = np.arange(len(starts)) - np.searchsorted(docs, docs)
    word = np.searchsorted(b.starts, starts)  # the line's first word
    last = np.searchsorted(b.starts, ends) - 1
    held = last >= word
    docs, number, word, last = docs[held], number[held], word[held], last[held]
    hashes = b.spans(b.starts[word], b.ends[last])
    gram, at = grams(hashes, np.searchsorted(docs, np.arange(b.n + 1)), LINES)
    return gram, docs[at], number[at[:, None] + np.arange(LINES)]


def windows(docs: DataFrame) -> DataFrame:
    """(_id, _text_hash, _window, _lines): one row for each window of each document."""
    rows = docs.select(docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_text_hash"), docs["text"].alias("_text")).where("_text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for start, stop, b in blocks(texts):
                gram, owner, numbers = _windows(b)
                part = batch.slice(start, stop - start)
                take = pa.array(owner)
                lines = pa.ListArray.from_arrays(pa.array(np.arange(len(gram) + 1, dtype=np.int32) * LINES), pa.array(numbers.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(gram.view(np.int64)), lines], names=["_id", "_text_hash", "_window", "_lines"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(resting(run), f"_id {kind}, _text_hash long, _window long, _lines array<int>")


def covered(docs: DataFrame) -> DataFrame:
    """(_i, _h, _covered): the line numbers to remove, for each document that has any."""
    found = cut(windows(docs))
    place = F.struct("_id", "_text_hash", F.element_at("_lines", 1).alias("_line"))
    firsts = found.groupBy("_window").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_window").alias("_w"), "_first")
    later = found.join(firsts, F.col("_window") == F.col("_w")).where(place > F.col("_first"))
    numbers = later.select(F.col("_id").alias("_i"), F.col("_text_hash").alias("_h"), F.explode("_lines").alias("_line")).distinct()
    return numbers.groupBy("_i", "_h").agg(F.collect_list("_line").alias("_covered"))  # at most the lines of one text


def _without(text: str, covered: list[int]) -> str:
    gone = set(covered)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def marked(docs: DataFrame) -> DataFrame:
    """(_row, _text, _covered): every document, with the numbers of its lines to remove (null: none)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("_text"), docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_text_hash"))
    gone = cut(covered(docs))
    rows = sieved(rows, ["_id", "_text_hash"], gone.select("_i", "_h"))
    met = rows.where("_maybe")
    met = met.join(gone, same(met["_id"], gone["_i"]) & (met["_text_hash"] == gone["_h"]), "left").select("_row", "_text", "_covered")
    return rows.where("NOT _maybe").select("_row", "_text", F.lit(None).cast("array<int>").alias("_covered")).unionByName(met)


def _rewritten(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                gone = part.column(2).to_pylist()
                texts = part.column(1).to_pylist()
                new = [_without(t, g) if g else t for t, g in zip(texts, gone, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), pa.array([len(g or ()) for g in gone], pa.int64())], names=["_row", "_new", "_removed"])

    row = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(resting(run), f"_row {row}, _new string, _removed long")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text`` (and ``n_chars``, where there is such a column, counted anew)."""
    rows = _rewritten(marked(docs))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_removed") > 0, F.length("_new")).otherwise(F.col("_row.n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (lines) and text_sha256 (of what stays; null for a null text) of each document."""
    rows = _rewritten(marked(docs.select("doc_id", "text")))
    return rows.select("_row.doc_id", F.col("_removed").alias("n_removed"), F.sha2(F.col("_new").cast("binary"), 256).alias("text_sha256"))
