"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is that of its distinct k-word shingles (64-bit hashes of the words with A-Z lower-cased; fewer than k words
make one shingle). One permutation of the 32-bit universe scatters the set, a second one, shifted circularly by one step for
each coordinate, gives the signature: ``minimum of pi(sigma(x) + j * STEP)``. With 32 bands of 4 rows a pair at similarity
0.80 shares no band with a probability of 5e-8, at 0.85 of 6e-11.

Equal sets are one class, and only its representative (least doc_id) goes on. Candidates are verified on full sets:

1. each member of a bucket against the bucket's least member; the links that hold are joined into components;
2. where a bucket still holds more than one component, all its rows across components that share a shingle of their prefixes, by an
   inverted index over their full sets in tasks of bounded size; so no link inside a bucket is lost, and pairs are counted there
   but never made into rows.

All joins are splittable where a key is hot, and nothing of a bucket's size stands in one task or on the driver.

Nulls: rows with a null doc_id take no part (component null, kept); a null text, or one without words, has an empty set and
links with nothing. Rows that share an id count as one document, linked by any of its texts. An empty table gives an empty
one; other columns, under any names, are kept.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, same, sieved, small_side
from .components import components
from .textkernel import Block, blocks, grams, mix, resting, text_bytes

BANDS, ROWS = 32, 4
CHUNK = 1 << 15  # shingles on either side of a task of step 2
SLOT_BITS = 17  # of the sketch that orders shingles in step 2: a megabyte on the driver and in each task
STEP = np.uint32(0x9E3779B1)
_SIGMA = np.uint64(0xA0761D6478BD642F)


def shingles(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a block, sorted in it, and where each text's begin (n + 1 places)."""
    words = b.word_hashes()
    gram, at = grams(words, b.first, k)
    owner = b.word_docs()[at]
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < k))
    whole = [mix(np.add.reduce(words[b.first[i] : b.first[i + 1]] * (np.arange(1, b.n_words[i] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)), keepdims=True)) for i in short]
    gram, owner = np.concatenate([gram, *whole]), np.concatenate([owner, short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[first], owner[first]
    return gram, np.searchsorted(owner, np.arange(b.n + 1))


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, at: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """(sets that aren't empty) x n: the coordinates, one circular shift of the second permutation each."""
    held = np.flatnonzero(np.diff(at))
    out = np.empty((len(held), n), np.uint32)
    if len(held):
        sigma = (mix(sets ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
        starts = at[held]
        for j in range(n):
            out[:, j] = np.minimum.reduceat(_pi(sigma + np.uint32(j * int(STEP) & 0xFFFFFFFF)), starts)
    return out


def _bands(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out ^ parts[:, :, r])
    return out


def hashed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(_id, n_shingles, _sa, _sb, _bands): 128 bits of each document's set, and its band keys (null for an empty set)."""
    given = docs.select(docs["doc_id"].alias("_id"), docs["text"].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, b in blocks(text_bytes(batch.column(1)), lower=True):
                sets, at = shingles(b, k)
                held = np.flatnonzero(np.diff(at))
                keys = _bands(signatures(sets, at, bands * rows), bands).view(np.int64)
                ends = np.zeros(b.n + 1, np.int32)
                ends[held + 1] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel()))
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(s)))]) for s in (0x51ED270B, 0x2545F491)]
                sums = [pa.array((t[at[1:]] - t[at[:-1]]).view(np.int64)) for t in total]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(np.diff(at).astype(np.int64)), *sums, lists], names=["_id", "n_shingles", "_sa", "_sb", "_bands"])

    kind = given.schema["_id"].dataType.simpleString()
    return given.mapInArrow(resting(run), f"_id {kind}, n_shingles long, _sa long, _sb long, _bands array<long>")


class _Sets:
    """The sets of the last few thousand texts that a task has met."""

    def __init__(self, k: int, most: int = 64 << 20):
        self.k, self.most, self.size, self.held = k, most, 0, OrderedDict()

    def add(self, texts: dict[tuple, bytes]) -> None:
        new = [(key, t) for key, t in texts.items() if key not in self.held]
        for start, stop, b in blocks([t for _, t in new], lower=True):
            sets, at = shingles(b, self.k)
            for i, (key, _) in enumerate(new[start:stop]):
                self.held[key] = sets[at[i] : at[i + 1]].copy()
                self.size += self.held[key].nbytes

    def trim(self) -> None:
        while self.size > self.most and self.held:
            self.size -= self.held.popitem(last=False)[1].nbytes


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(_id, _text): the texts of the documents ``ids`` (a column, repeats allowed), and of a few others that the sieve can't tell from them."""
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].cast("string").alias("_text"))
    return sieved(texts, ["_id"], ids).where("_maybe").drop("_maybe")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with ``100 * intersection >= percent * union`` over their full sets."""
    pairs = cut(pairs)
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b"))))
    left = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta"))
    right = texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Sets(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                a, b, ta, tb = (part.column(i).to_pylist() for i in range(4))
                ka = [(i, hash(t)) for i, t in zip(a, ta, strict=True)]
                kb = [(i, hash(t)) for i, t in zip(b, tb, strict=True)]
                known.add({key: (t or "").encode() for key, t in zip(ka + kb, ta + tb, strict=True)})
                linked = []
                for x, y in zip(ka, kb, strict=True):
                    x, y = known.held[x], known.held[y]
                    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or not len(x):
                        linked.append(False)
                        continue
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    linked.append(100 * shared >= percent * (len(both) - shared))
                known.trim()
                keep = pa.array(linked)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def linked(nodes: DataFrame, docs: DataFrame, k: int, percent: int, ties: DataFrame | None = None) -> DataFrame:
    """(node, component) of the representatives ``nodes`` (_id, n_shingles, _bands). ``ties``: links (a, b) that are known."""
    member = nodes.select(F.col("_id").alias("a"), F.explode("_bands").alias("_key"))
    heads = cut(member.groupBy("_key").agg(F.min("a").alias("b"), F.count("*").alias("_n")).where("_n > 1"))
    heads = heads.withColumnRenamed("_key", "_hk")
    shared = member.join(heads, F.col("_key") == F.col("_hk")).drop("_hk")
    links = verified(shared.where("a <> b").select("a", "b").distinct(), docs, k, percent)
    joined = cut(components(links if ties is None else links.unionByName(ties)))

    labelled = shared.where("_n > 2").join(joined, F.col("a") == F.col("node"), "left").select("_key", "a", F.coalesce("component", "a").alias("_c"))
    labelled = cut(labelled)
    split = labelled.groupBy(F.col("_key").alias("_sk")).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo < _hi")
    inside, left = counted(labelled.join(split, F.col("_key") == F.col("_sk")).select("a", "_c", "_lo").distinct())
    first = nodes.select(F.col("_id").alias("_node")).distinct().join(joined, F.col("_node") == F.col("node"), "left").select("_node", F.coalesce("component", "_node").alias("_first"))
    if not left:
        return first.toDF("node", "component")
    more = components(crossing(inside, docs, k, percent))  # of the components
    return first.join(more, F.col("_first") == F.col("node"), "left").select(F.col("_node").alias("node"), F.coalesce("component", "_first").alias("component"))


def crossing(inside: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of components that link, of those that meet in a bucket: all pairs of their rows are covered. ``inside``: rows a of such buckets with their component _c and the least component _lo of the bucket.

    Components that meet, directly or over others, are a family. Rows that link share a shingle of their prefixes (``prefixes``); so a
    family falls into those of its components that share one, and rows that share none with another component link with none and
    go. What is left of a family outside its largest component is held against all of it by an inverted index over full sets,
    in tasks of about CHUNK shingles on either side.
    """
    family = components(inside.where("_c <> _lo").select(F.col("_c").alias("a"), F.col("_lo").alias("b")))
    people = inside.select("a", "_c").distinct().join(family, F.col("_c") == F.col("node")).select("a", "_c", F.col("component").alias("_f"))
    texts = texts_of(docs, inside.select("a"))
    met = cut(with_sets(people.join(texts, F.col("a") == F.col("_id")).select("a", "_c", "_f", "_text"), k))
    near = prefixes(met, percent, slot_counts(met))
    shared = near.groupBy(F.col("_f").alias("_ff"), F.col("_t").alias("_tt")).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo < _hi")
    near = cut(near.join(shared, (F.col("_f") == F.col("_ff")) & (F.col("_t") == F.col("_tt"))).select(F.col("a").alias("_n"), F.col("_c").alias("_nc"), "_lo").distinct())
    part = components(near.where("_nc <> _lo").select(F.col("_nc").alias("a"), F.col("_lo").alias("b")))
    near = cut(near.select("_n", "_nc").distinct().join(part, F.col("_nc") == F.col("node")).select("_n", F.col("component").alias("_p")))
    rows = met.join(near, F.col("a") == F.col("_n")).select("a", "_c", F.col("_p").alias("_f"), "_set")
    parts = rows.groupBy("_f", "_c").agg(F.count("*").alias("_m"), F.sum(F.size("_set")).alias("_s"))
    sizes = parts.groupBy(F.col("_f").alias("_ff")).agg(F.max(F.struct("_m", "_c", "_s")).alias("_main"), F.sum("_s").alias("_s"))
    chunks = lambda s: F.greatest(F.lit(1), F.ceil(s / CHUNK)).cast("int")
    sizes = sizes.select("_ff", F.col("_main._c").alias("_mc"), chunks(F.col("_s")).alias("_ny"), chunks(F.col("_s") - F.col("_main._s")).alias("_nx"))
    mine = lambda n: F.pmod(F.xxhash64("a"), n).cast("int")
    cell = lambda x, y, side: F.struct(x.alias("_x"), y.alias("_y"), F.lit(side).alias("_side"))
    across = F.transform(F.sequence(F.lit(0), F.when(F.col("_c") != F.col("_mc"), F.col("_ny") - 1)), lambda y: cell(mine(F.col("_nx")), y, 0))
    down = F.transform(F.sequence(F.lit(0), F.col("_nx") - 1), lambda x: cell(x, mine(F.col("_ny")), 1))
    cells = rows.join(sizes, F.col("_f") == F.col("_ff")).select("_f", "_c", "_set", F.explode(F.when(F.col("_c") != F.col("_mc"), F.concat(across, down)).otherwise(down)).alias("_at"))
    dealt = cells.select("_f", "_at._x", "_at._y", "_at._side", "_c", "_set").repartition("_f", "_x", "_y").sortWithinPartitions("_f", "_x", "_y", "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(4).type) for c in _links(*held, percent)], names=["a", "b"])

        for batch in batches:
            f, i, j, side, c = (x.to_pylist() for x in batch.columns[:5])
            flat, to = _flat(batch.column(5))
            for n, (key, s) in enumerate(zip(zip(f, i, j, strict=True), side, strict=True)):
                if key != at:
                    if at is not None:
                        yield done()
                    at, held = key, ([], [])
                held[s].append((c[n], flat[to[n] : to[n + 1]].copy()))
        if at is not None:
            yield done()

    kind = people.schema["_c"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and where each list begins (n + 1 places)."""
    to = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[to[0] : to[-1]].view(np.uint64), to - to[0]


def with_sets(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with the set (_set) of their last column, _text, in its place."""
    given = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, b in blocks(text_bytes(batch.column(len(given))), lower=True):
                sets, at = shingles(b, k)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns[:-1]), lists], names=[*(f.name for f in given), "_set"])

    return rows.mapInArrow(resting(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given) + ", _set array<long>")


def _slot(sets: np.ndarray) -> np.ndarray:
    return (mix(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(met: DataFrame) -> np.ndarray:
    """How many shingles of all rows fall into each of 2**SLOT_BITS slots: a sketch of fixed size, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_slot(_flat(batch.column(0))[0]), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["_slot", "_n"])

    found = met.select("_set").mapInArrow(run, "_slot int, _n long").groupBy("_slot").agg(F.sum("_n").alias("_n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[found["_slot"].to_numpy()] = found["_n"].to_numpy()
    return out


def prefixes(met: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """(_f, _t, a, _c): the prefix of each row's set, of n shingles the first n - ceil(percent * n / 100) + 1 in an order that all rows share.

    Sets that link have at least percent * n / 100 shingles in common, of the n of either, so their prefixes can't be disjoint. The
    order only decides on the work: shingles of emptier slots come first, which leaves the ones that very many rows have to the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, to = _flat(batch.column(3))
            n = np.diff(to)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, counts[_slot(flat)], owner))
            place = np.arange(len(flat)) - np.repeat(to[:-1], n)
            first = order[place < np.repeat(n - (percent * n + 99) // 100 + 1, n)]
            rows = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays([batch.column(2).take(rows), pa.array(flat[first].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["_f", "_t", "a", "_c"])

    kind = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    return met.select("a", "_c", "_f", "_set").mapInArrow(run, f"_f {kind['_f']}, _t long, a {kind['a']}, _c {kind['_c']}")


def _links(xs: list[tuple], ys: list[tuple], percent: int) -> tuple[list, list]:
    """Of rows (component, set): the component of each x, and each other one that it links with."""
    if not xs or not ys:
        return [], []
    (mine, at), (theirs, to) = ((np.concatenate([r[1] for r in t]), np.cumsum([0] + [len(r[1]) for r in t])) for t in (xs, ys))
    owner = np.repeat(np.arange(len(ys)), np.diff(to))
    order = np.argsort(theirs, kind="stable")
    theirs, owner, size = theirs[order], owner[order], np.diff(to)
    names = {c: i for i, c in enumerate(dict.fromkeys(r[0] for r in ys))}
    group = np.array([names[r[0]] for r in ys])
    low, high = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, "right")
    a, b = [], []
    for i, row in enumerate(xs):
        lo, n = low[at[i] : at[i + 1]], high[at[i] : at[i + 1]] - low[at[i] : at[i + 1]]
        places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        shared = np.bincount(owner[places], minlength=len(ys))
        union = at[i + 1] - at[i] + size - shared
        hit = np.flatnonzero((shared > 0) & (100 * shared >= percent * union) & (group != names.get(row[0], -1)))
        for j in hit[np.unique(group[hit], return_index=True)[1]]:
            a.append(row[0])
            b.append(ys[j][0])
    return a, b


def classed(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(_id, n_shingles, component): a row for each row of ``docs``; component is the least doc_id of its class. Also the ids (_id) that several
    rows have, and how many."""
    base = cut(hashed(docs, k, bands, rows))
    full = base.where("n_shingles > 0 AND _id IS NOT NULL")
    reps = full.groupBy("_sa", "_sb").agg(F.min("_id").alias("_rep"))
    at = reps.select(F.col("_sa").alias("_ra"), F.col("_sb").alias("_rb"), "_rep")
    mine = (F.col("_sa") == F.col("_ra")) & (F.col("_sb") == F.col("_rb"))
    nodes = cut(full.join(at, mine & (F.col("_id") == F.col("_rep"))).select("_id", "n_shingles", "_bands").dropDuplicates(["_id", "_bands"]))
    own = F.when(F.col("n_shingles") > 0, F.struct("_sa", "_sb"))
    again, repeated = counted(base.where("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("_n"), F.min(own).alias("_lo"), F.max(own).alias("_hi")).where("_n > 1"))
    ties = None
    if repeated:  # an id that has several sets ties them together
        several = again.where("_lo <> _hi").select(F.col("_id").alias("b"))
        ties = full.join(at, mine).select(F.col("_rep").alias("a"), F.col("_id").alias("b")).join(several, "b").select("a", "b").distinct()
    by_id = linked(nodes, docs, k, percent, ties)
    named = cut(at.join(by_id, F.col("_rep") == F.col("node")).select("_ra", "_rb", "component"))
    found = base.join(named, mine & (F.col("n_shingles") > 0) & F.col("_id").isNotNull(), "left").select("_id", "n_shingles", F.coalesce("component", "_id").alias("component"))
    return found, again.select("_id"), repeated


def classes(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(_id, n_shingles, component): a row for each row of ``docs``; component is the least doc_id of its class."""
    return classed(docs, k, percent, bands, rows)[0]


def report(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    found = classes(docs, k, percent)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least doc_id; of rows that repeat an id, one."""
    found, again, repeated = classed(docs, k, percent, BANDS, ROWS)
    gone = small_side(found.where("component <> _id").select(F.col("_id").alias("_gone")).distinct())
    kept = docs.join(gone, same(docs["doc_id"], gone["_gone"]), "left_anti")
    if not repeated:
        return kept
    many = again.withColumnRenamed("_id", "_many")
    once = kept.join(many, kept["doc_id"] == many["_many"], "left_anti")
    rows = kept.join(many, kept["doc_id"] == many["_many"], "left_semi").select(F.struct(*[kept[c] for c in docs.columns]).alias("_row"))
    rows = rows.groupBy("_row.doc_id").agg(F.min_by("_row", F.sha2(F.coalesce(F.col("_row.text").cast("binary"), F.lit(b"")), 256)).alias("_row"))
    return once.unionByName(rows.select("_row.*"))
