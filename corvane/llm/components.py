"""Connected components of an edge table, by the smallest id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from corvane.session import cut_lineage


def _forest(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``other``: what the edges of a task link, as one edge from every node to the smallest node that it reaches there.

    Stars around hubs, which make up most edges, and chains inside a task are gone before the first exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x is not None and y is not None and x != y:
                    x, y = root(parent.setdefault(x, x) if x not in parent else x), root(parent.setdefault(y, y) if y not in parent else y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        for at in range(0, len(nodes), 100_000):
            part = [(n, root(n)) for n in nodes[at:at + 100_000]]
            part = [(n, r) for n, r in part if n != r]
            yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in part], pa.int64()), "other": pa.array([r for _, r in part], pa.int64())})

    return edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).mapInArrow(run, "node long, other long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` for every node that an edge links to another one; ``component`` is the smallest node that it reaches.

    Each round takes the smallest label among a node and its neighbours, added up before the shuffle so that a hub is no hot key,
    and then jumps to the label's own label. Rounds end when no label changes, after about the logarithm of the longest path.
    """
    forest = _forest(edges, a, b)
    both = cut_lineage(forest.select(F.inline(F.array(
        F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other"))))).distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("at"))
        # the label's own label, as it was before this round
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        moved = stepped.join(jump, "at", "left").select("node", "was", F.coalesce("further", "at").alias("component"))
        changed = Observation()
        labels = cut_lineage(moved.observe(changed, F.count_if(F.col("component") != F.col("was")).alias("n"))).select("node", "component")
        if not changed.get["n"]:
            return labels


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (as of ``components``) after more edges ``a``, ``b``: only edges between different components are followed."""
    def named(x: str) -> DataFrame:
        return labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))

    across = found.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b")
    count = Observation()
    across = cut_lineage(across.distinct().observe(count, F.count(F.lit(1)).alias("n")))
    if not count.get["n"]:
        return labels
    merged = components(across)
    moved = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select(
        "node", F.coalesce("further", "component").alias("component"))
    return cut_lineage(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti")))
