"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import written


#: Nodes that a task joins at most before it hands them on and begins anew (some 100 MB).
JOINED_NODES = 500_000


def _stars(batches) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars: every node with the smallest one it is joined with here."""
    up: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while up[top] != top:
            top = up[top]
        while up[node] != top:
            up[node], node = top, up[node]
        return top

    def stars() -> pa.RecordBatch:
        tops = [(root(node), node) for node in up]
        tops = [pair for pair in tops if pair[0] != pair[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in tops], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a), up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        if len(up) >= JOINED_NODES:
            yield stars()
            up.clear()
    if up:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the component's smallest node.

    Each round takes the smallest label around a node, then the label of that label, which halves
    the way to the root. Minima are combined before the shuffle, so a hub is no hot group. Every
    round is written to the shared folder. Edges are first drawn together inside the tasks, by one of
    their nodes: members of a dense group come out with one edge each, however many they had.
    """
    edges = edges.select("a", "b").repartition("b").mapInArrow(_stars, "a long, b long").distinct()
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    both = written(both.where("node != other").distinct(), "edges")
    first = both.groupBy("node").agg(F.min("other").alias("other"))
    labels = written(first.select("node", F.least("node", "other").alias("label")), "labels")
    while True:
        around = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        nearer = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.toDF("at", "further")
        moved = nearer.join(jump, nearer["label"] == jump["at"]).select(
            "node", F.least("label", "further").alias("label"), "was"
        )
        moved = written(moved, "labels")
        changed = moved.where("label != was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
