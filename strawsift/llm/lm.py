"""Language-model scores of whole documents.

1. All words (A-Z lower-cased, and an end for each document) of all training documents are counted; words are 64-bit hashes.
2. The most frequent words are the model's head; all others belong to one of ``TAILS`` classes by their last letters. The class-factored
   softmax gives a head word's probability, and a tail word that of its class times its add-one share of the class's words.
3. The recurrent model (recurrent.py) learns from all training documents, dealt to the rounds: shards of a round's documents train side
   by side from common weights, which are then averaged by the symbols that each has seen.
4. Texts are turned into symbols once and written; training and scoring read those. A document's shard, and its place there, follow from a
   hash of its id and text. Every document is scored whole, its state carried over all windows. Counts of the frequent words go to the tasks (at most
   ``KNOWN`` words); the others' are joined to the documents that have them, so the vocabulary may outgrow any task.

The base score is that of the add-one unigram model. A null text counts as empty: it has its end alone. A null id counts as the empty string
in the split. Rows that repeat are each scored (and counted); an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .recurrent import Model
from .textkernel import Block, blocks, mix, text_bytes

HEAD = 1024  # words of the model
TAILS = 32
KNOWN = 1_000_000  # the most words whose counts go to every task
ROUNDS = 2
SHARE = ROUNDS  # each round learns from one training document in so many; no document is left to none
SHARD = 1500  # documents of a training shard
PIECE = 2048  # weights of a shard's model that travel together
TOGETHER = 1 << 20  # symbols of a shard that are held at once, and those of one more batch
FOLDS, HELD_OUT = 7, 2
END = int(mix(np.array([0x656E64], np.uint64))[0])
_LOG10 = float(np.log(10))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _tail_class(b: Block) -> np.ndarray:
    """Of each word of a block, by its last two bytes."""
    last = b.buf[b.ends - 1].astype(np.int64)
    other = np.where(b.ends - b.starts > 1, b.buf[np.maximum(b.ends - 2, 0)], 0)
    return (last * 37 + other * 11) % TAILS


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all tokens of a block, ends included, and where each text's begin (n + 1 places)."""
    first = b.first + np.arange(b.n + 1)
    hashes = np.empty(len(b.starts) + b.n, np.uint64)
    tails = np.zeros(len(hashes), np.int64)
    end = np.zeros(len(hashes), bool)
    end[first[1:] - 1] = True
    hashes[end] = np.uint64(END)
    hashes[~end], tails[~end] = b.word_hashes(), _tail_class(b)
    return hashes, tails, first


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, tail, n) of each token of the training documents."""
    given = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, b in blocks(text_bytes(batch.column(0)), lower=True):
                h, t, _ = _tokens(b)
                h, at, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((h, t[at], n))
            if parts:
                h, t, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                h, at, to = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(to, weights=n)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "tail", "n"])

    rows = given.mapInArrow(run, "h long, tail int, n long")
    return rows.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


class Vocabulary:
    """What scoring needs of the counts: totals, the known words' counts, the head, and the tail classes' totals."""

    def __init__(self, counts: DataFrame):
        self.total, self.distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        # the least count with at most KNOWN words from it on, by the counts' sixteenths of a doubling (about a thousand rows at most)
        self.least, held = 1, 0
        if self.distinct > KNOWN:
            step = F.floor(F.log2("n") * 16).alias("step")
            sizes = counts.groupBy(step).agg(F.count("*").alias("words"), F.min("n").alias("least"), F.max("n").alias("most")).orderBy(F.col("step").desc()).collect()
            self.least = sizes[0]["most"] + 1
            for r in sizes:
                held += r["words"]
                if held > KNOWN:
                    break
                self.least = r["least"]
        known = counts.where((F.col("n") >= self.least) | (F.col("h") == F.lit(int(np.uint64(END).astype(np.int64))))).toArrow() if self.total else None
        h, tail, n = (known[c].to_numpy() for c in ("h", "tail", "n")) if known else (np.zeros(0, np.int64),) * 3
        order = np.argsort(h.view(np.uint64))
        self.h, self.n, tail = h.view(np.uint64)[order].copy(), n[order].copy(), tail[order]
        self.shift = np.uint64(64 - max(1, len(self.h).bit_length()))  # the hashes' first bits: about one known word for each of their values
        self.first = np.concatenate([[0], np.cumsum(np.bincount((self.h >> self.shift).astype(np.int64), minlength=1 << 64 - int(self.shift)))]).astype(np.int32)
        rank = np.lexsort((self.h, -self.n, self.h != np.uint64(END)))[:HEAD]  # the end first, then by count
        rank = rank[np.lexsort((self.h[rank], -self.n[rank]))]
        self.symbol = np.full(len(self.h), -1, np.int32)
        self.symbol[rank] = np.arange(len(rank))
        self.head = self.n[rank].astype(float)
        self.tail_n, self.tail_words = np.zeros(TAILS), np.zeros(TAILS)
        if self.total:
            for t, words, count in counts.groupBy("tail").agg(F.count("*"), F.sum("n")).collect():  # TAILS rows
                self.tail_words[t], self.tail_n[t] = words, count
            np.subtract.at(self.tail_words, tail[rank], 1)
            np.subtract.at(self.tail_n, tail[rank], self.n[rank])

    def look_up(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of some tokens (0: not among the known) and their symbols."""
        if not len(self.h):
            return np.zeros(len(hashes), np.int64), (len(self.head) + tails).astype(np.int64)
        last = len(self.h) - 1
        at = np.minimum(self.first[(hashes >> self.shift).astype(np.int64)], last)
        low = np.flatnonzero((self.h[at] < hashes) & (at < last))
        while len(low):  # on to the next of those that begin alike
            at[low] += 1
            low = low[(self.h[at[low]] < hashes[low]) & (at[low] < last)]
        hit = self.h[at] == hashes
        symbol = np.where(hit, self.symbol[at], -1)
        return np.where(hit, self.n[at], 0), np.where(symbol >= 0, symbol, len(self.head) + tails).astype(np.int64)


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row for each document, in place of its text: doc_id, held_out, _h (hash of id and text), symbols (16-bit integers), n_tokens,
    n_known, base_score, left (what the model leaves to the counts: the shares of tail words in their classes) and rare, the
    hashes of words that aren't among the known."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    every = vocabulary.total + vocabulary.distinct + 1
    whole = vocabulary.least <= 1
    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("doc_id", "text").alias("_h"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        spread = np.concatenate([np.zeros(len(v.head)), np.log10(v.tail_n + v.tail_words + 1)])
        for batch in batches:
            for start, stop, b in blocks(text_bytes(batch.column(3)), lower=True):
                hashes, tails, first = _tokens(b)
                n, symbols = v.look_up(hashes, tails)
                owner = np.repeat(np.arange(b.n), np.diff(first))
                add = lambda x, owner=owner, b=b: np.bincount(owner, weights=x, minlength=b.n)
                share = np.log10(n + 1)
                left = np.where(symbols >= len(v.head), share - spread[symbols], 0.0)
                unknown = np.flatnonzero(n == 0) if not whole else np.zeros(0, np.int64)
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[unknown], np.arange(b.n + 1)).astype(np.int32)), pa.array(hashes[unknown].view(np.int64)))
                coded = symbols.astype("<u2").tobytes()
                at = (2 * first).tolist()
                part = batch.slice(start, stop - start)
                made = [
                    pa.array([coded[i:j] for i, j in zip(at, at[1:], strict=False)], pa.binary()),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(add(n > 0).astype(np.int64)),
                    pa.array(add(share) - np.diff(first) * np.log10(every)),
                    pa.array(add(left)),
                    rare,
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made], names=["doc_id", "held_out", "_h", *CODED])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, _h long, symbols binary, n_tokens long, n_known long, base_score double, left double, rare array<long>")


CODED = ("symbols", "n_tokens", "n_known", "base_score", "left", "rare")


def _texts(symbols: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a column's texts, one after the other, and where each text's begin."""
    given = symbols.to_pylist()
    return np.frombuffer(b"".join(given), "<u2").astype(np.int32), np.concatenate([[0], np.cumsum(np.fromiter(map(len, given), np.int64, len(given)) // 2)])


def lesson(rows: DataFrame, turn: int) -> DataFrame:
    """The ``encoded`` training documents that a round learns from."""
    return rows.where(~F.col("held_out") & (F.pmod("_h", F.lit(SHARE)) == turn))


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces of weights (at, seen, values) the mean at each place, by the symbols that each shard has seen. A piece is added as it
    comes, so a task holds no more than the sums of its places."""
    sums: dict[int, list] = {}
    for batch in batches:
        for at, seen, values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            held = sums.setdefault(at, [0.0, 0.0])
            held[0] += seen
            held[1] = held[1] + seen * np.frombuffer(values, np.float32).astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([(total / seen).tobytes() for seen, total in sums.values()], pa.binary())], names=["at", "values"])


def trained(rows: DataFrame, vocabulary: Vocabulary) -> Model:
    """The model after ROUNDS rounds of training on shards of ``encoded`` documents, averaged after each. A document's shard and place in it
    follow from its hash, so the files' layout makes no difference."""
    model = Model(vocabulary.head, vocabulary.tail_n)
    if not vocabulary.total:
        return model
    sc = rows.sparkSession.sparkContext
    words = sc.broadcast((vocabulary.head, vocabulary.tail_n))
    sizes = {r["turn"]: r["count"] for r in rows.where(~F.col("held_out")).groupBy(F.pmod("_h", F.lit(SHARE)).alias("turn")).count().collect()}
    for turn in range(ROUNDS):
        weights = sc.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            own, seen, past, held, waiting = Model(*words.value), 0, {}, [], 0
            own.take(weights.value)

            def learn() -> int:
                symbols = np.concatenate([s for s, _ in held])
                lengths = np.concatenate([np.diff(f) for _, f in held])
                return own.train(symbols, np.concatenate([[0], np.cumsum(lengths)]), past=past)[0]

            for batch in batches:
                held.append(_texts(batch.column(0)))
                waiting += len(held[-1][0])
                if waiting >= TOGETHER:
                    seen, held, waiting = seen + learn(), [], 0
            if waiting:
                seen += learn()
            flat = own.flat()
            for at in range(0, len(flat) if seen else 0, PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([float(seen)]), pa.array([flat[at : at + PIECE].tobytes()], pa.binary())], names=["at", "seen", "values"])

        shards = max(1, -(-sizes.get(turn, 0) // SHARD))
        dealt = lesson(rows, turn).select("_h", "doc_id", "symbols").repartition(shards, "_h").sortWithinPartitions("_h", "doc_id")
        each = dealt.select("symbols").mapInArrow(run, "at long, seen double, values binary")
        flat = model.flat()
        for r in each.repartition("at").mapInArrow(_averaged, "at long, values binary").toArrow().to_pylist():  # the weights of one model
            values = np.frombuffer(r["values"], np.float64)
            flat[r["at"] : r["at"] + len(values)] = values
        model.take(flat)
    return model


def scored(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    counts = cut(word_counts(docs))
    vocabulary = Vocabulary(counts)
    rows = cut(encoded(docs, vocabulary))
    model = rows.sparkSession.sparkContext.broadcast(trained(rows, vocabulary))
    given = rows.select("doc_id", "held_out", *CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.value.score(*_texts(batch.column("symbols"))) / _LOG10 + batch.column("left").to_numpy()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(score), batch.column("rare")], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    kind = given.schema["doc_id"].dataType.simpleString()
    rows = given.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    if vocabulary.least > 1:
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
        less = counts.where(F.col("n") < vocabulary.least).select(F.col("h").alias("_h"), "n")
        found = rows.select("_row", F.explode("rare").alias("_r")).join(less, F.col("_r") == F.col("_h"))
        found = found.groupBy(F.col("_row").alias("_of")).agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 1)).alias("_more"))
        rows = rows.join(found, F.col("_row") == F.col("_of"), "left")
        rows = rows.withColumn("n_known", F.col("n_known") + F.coalesce("_known", F.lit(0)))
        for c in ("base_score", "score"):
            rows = rows.withColumn(c, F.col(c) + F.coalesce("_more", F.lit(0.0)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
