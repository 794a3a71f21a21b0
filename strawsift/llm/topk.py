"""Exact top-k inner product search over an impact-ordered index, score at a time.

Vectors are whole numbers. The rows are dealt by hash into blocks; each block's index holds, for each level of quantised impact
(the magnitude of a component), the posting segments of all dimensions: one matrix of the components of that level, 0 elsewhere. Levels hold
about equally many postings. For a group of queries the levels are processed from the highest down. What a row can still add is bounded by
Cauchy-Schwarz over the dimensions in which it has not been seen: the norm of its remaining components times that of the query in those
dimensions alone, which is counted along. The k-th of the rows that lead so far, scored exactly, says what a member must reach. A row is left
out on this proof only; processing stops when few possible members are left, and these are scored exactly, ties and all. Blocks give
their k best, and a last step ranks those.

Blocks and groups are of bounded size; each pair of them is a task's work, so nothing grows with the data but their number.
Vectors that are null or hold a null or non-finite component take no part, nor do null ids; shorter vectors count as padded
with zeros. Rows that repeat an id and its vector count once, as queries and as candidates; an id with several vectors is a query
with each of them, ranked apart. Rows equal in id to the query are its own. Equal scores rank by id. An empty table gives an empty one.
Scores must fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK = 4096  # rows of a block
GROUP = 4096  # queries of a group
LEVELS = 16
TOGETHER = 64  # queries that share a pass
FEW = 0.1  # possible members, as a share of a block, at which they are scored exactly


class Index:
    """The posting segments of a block: rows by id, vectors of whole numbers. ``read`` and ``held`` count the postings that searches have
    processed and those that there were, for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        size = np.abs(self.vectors)
        top = int(size.max(initial=0))
        # 32-bit sums of products are exact below 2**24
        self.kind = np.float32 if top * top * max(1, vectors.shape[1]) < 1 << 24 else np.float64
        some = size[size > 0]
        edges = np.unique(np.quantile(some, np.arange(1, levels) / levels, method="higher")).tolist() if len(some) else []
        edges = [top + 1, *sorted({int(e) for e in edges} - {1, top + 1}, reverse=True), 1]
        self.segments: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []
        square = self.vectors.astype(np.float64) ** 2
        for high, low in zip(edges, edges[1:], strict=False):
            self.segments.append(np.where((size >= low) & (size < high), self.vectors, 0).astype(self.kind))
            self.rest.append(np.sqrt(np.where(size < low, square, 0.0).sum(axis=1)))
        self.postings = [int(np.count_nonzero(x)) for x in self.segments]
        self.norms = np.sqrt(square.sum(axis=1))
        self.read = self.held = 0

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, row id, score) of at least the k best rows of the block for each query. ``own``: ids of the queries."""
        found = [self._together(queries[i : i + TOGETHER], k, own[i : i + TOGETHER], i) for i in range(0, len(queries), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _exact(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return np.einsum("nd,nd->n", self.vectors[rows], queries)

    def _together(self, queries: np.ndarray, k: int, ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m = len(self.ids), len(queries)
        kind = self.kind if np.abs(queries).max(initial=0) <= np.abs(self.vectors).max(initial=0) else np.float64
        weights = np.ascontiguousarray(queries.T.astype(kind))  # dimension, query
        squares = weights * weights
        total = (queries.astype(np.float64) ** 2).sum(axis=1)
        # rounding: of sums beyond 53 (24) bits, and of the squares seen, relative to all of them
        slack = 1e-6 * (1 + np.sqrt(total) * self.norms.max(initial=0.0))
        got, seen = np.zeros((n, m), kind), np.zeros((n, m), kind)
        first, after = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, "right")
        own = np.zeros((n, m), bool)
        for q in np.flatnonzero(after > first):
            own[first[q] : after[q], q] = True
        possible = ~own
        least = min(k, n)
        self.held += m * sum(self.postings)
        read = 0
        for level, (segments, rest) in enumerate(zip(self.segments, self.rest, strict=True)):
            got += segments.astype(kind, copy=False) @ weights
            read += self.postings[level]
            if level + 1 == len(self.segments):
                break  # all is known
            seen += (segments != 0).astype(kind) @ squares
            if 4 * read < sum(self.postings):
                continue  # a few postings prove nothing
            # any rows that lead so far will do to say what a member must reach
            ranked = np.ascontiguousarray(np.where(own, -np.inf, got).T.astype(kind, copy=False))
            lead = np.argpartition(ranked, n - least, axis=1)[:, n - least :]
            exact = self._exact(lead.ravel(), np.repeat(queries, least, axis=0)).reshape(m, least).astype(np.float64)
            exact[own[lead, np.arange(m)[:, None]]] = -np.inf
            reach = exact.min(axis=1)
            unseen = np.sqrt(np.maximum(total - seen, 0) + 1e-5 * total)
            unseen *= rest[:, None]
            unseen += got
            possible = ~own & (unseen >= reach - slack)
            if possible.sum() <= FEW * n * m:
                break
        self.read += m * read
        rows, q = np.nonzero(possible)
        if level + 1 == len(self.segments) and np.abs(self.vectors).max(initial=0) * float(np.abs(queries).max(initial=0)) * queries.shape[1] < (1 << 24 if kind is np.float32 else 1 << 53):
            scores = got[rows, q].astype(np.int64)  # exact sums of all postings
            most = np.zeros(m) - np.inf
            if n > least:
                most = np.partition(np.where(own, -np.inf, got), n - least, axis=0)[n - least]
            keep = scores >= most[q]
            rows, q, scores = rows[keep], q[keep], scores[keep]
        else:
            scores = self._exact(rows, queries[q])
        order = np.lexsort((self.ids[rows], -scores, q))
        rows, q, scores = rows[order], q[order], scores[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[best] + start, self.ids[rows[best]], scores[best]


def whole(vectors: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(_id, _v): the vectors that take part, as whole numbers."""
    fine = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    return fine.select(F.col(vec_id).cast("long").alias("_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("_v"))


def _matrix(lists: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query (_id, _v) the k rows (_id, _v) of the highest inner product. Repeated rows must have
    been brought to one."""
    n, m = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // group))
    deal = lambda n, seed: F.pmod(F.xxhash64("_id", "_v", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("*", deal(blocks, 1).cast("long").alias("_block"), every(groups).alias("_group"))
    right = queries.select("*", F.xxhash64("_v").alias("_which"), deal(groups, 2).cast("long").alias("_group"), every(blocks).alias("_block"))

    def run(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asked):
            return pd.DataFrame({"query_id": [], "_which": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(mine["_v"].map(len).max(), asked["_v"].map(len).max())
        index = Index(mine["_id"].to_numpy(), _matrix(mine["_v"], width))
        ids = asked["_id"].to_numpy()
        q, v, s = index.search(_matrix(asked["_v"], width), k, ids)
        return pd.DataFrame({"query_id": ids[q], "_which": asked["_which"].to_numpy()[q], "vec_id": v, "score": s})

    best = left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInPandas(run, "query_id long, _which long, vec_id long, score long")
    order = Window.partitionBy("query_id", "_which").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by ``every``."""
    rows = cut(whole(vectors).dropDuplicates(["_id", "_v"]))
    return search(rows, rows.where(F.col("_id") % every == 0), k)
