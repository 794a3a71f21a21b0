"""Connected components of links, as DataFrames throughout.

Labels contract: every label hooks to its least smaller neighbour, a chain of hooks is shortened by one pointer jump, and the links are
written anew between the labels that are left. A round is two checkpoints and no other action; how many links it left is counted as
they are written. Once at most ``LAST`` links are left, a bounded number, one task finishes them. The hooks of the rounds are then
followed back to all nodes. Links and labels are never brought to the driver; only counts are. What a round makes is checkpointed,
so a lost executor costs no earlier round.

A link with a null end is none; a node that links with itself alone is its own component; links may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut

LAST = 1 << 20  # links that one task finishes, some 100 MB there


def _relabel(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by the label that it hooks to, if any."""
    h = hooks.select(F.col("_v").alias("_hv"), F.col("_p").alias("_hp"))
    return rows.join(h, rows[column] == h["_hv"], "left").withColumn(column, F.coalesce("_hp", column)).drop("_hv", "_hp")


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least one that the links (u, v) connect it with."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _finished(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of a bounded number of links, by one task."""
    kind = edges.schema["_u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in held]).combine_chunks()
            names = ends.unique()
            names = names.take(pc.sort_indices(names))
            place = pc.index_in(ends, names).to_numpy()
            half = len(place) // 2
            label = least_labels(place[:half], place[half:], len(names))
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b", last: int = LAST) -> DataFrame:
    """(node, component): for each node of a link, the least node that it is connected with."""
    pair = [F.least(a, b).alias("_u"), F.greatest(a, b).alias("_v")]
    given, left = counted(links.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").select(*pair).distinct())
    if left <= last:
        return _finished(given)
    edges, trail = given.where("_u < _v"), []
    while left > last:
        hooks = cut(edges.groupBy("_v").agg(F.min("_u").alias("_p")))
        trail.append(_relabel(hooks, "_p", hooks))
        again = _relabel(_relabel(edges, "_u", trail[-1]), "_v", trail[-1])
        edges, left = counted(again.where("_u <> _v").select(F.least("_u", "_v").alias("_u"), F.greatest("_u", "_v").alias("_v")).distinct())
    labels = cut(_finished(edges))
    for hooks in reversed(trail):
        hooked = hooks.join(labels, hooks["_p"] == labels["node"], "left").select(F.col("_v").alias("node"), F.coalesce("component", "_p").alias("component"))
        labels = cut(labels.unionByName(hooked).distinct())
    nodes = given.select(F.explode(F.array("_u", "_v")).alias("_node")).distinct()
    return nodes.join(labels, F.col("_node") == F.col("node"), "left").select(F.col("_node").alias("node"), F.coalesce("component", "_node").alias("component"))
