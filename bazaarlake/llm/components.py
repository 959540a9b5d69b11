"""Connected components of an edge table, in rounds that each end in a stored table."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

# Labels of at most this many nodes (16 bytes each, 4 MB) are broadcast; larger tables are joined by shuffle.
BROADCAST_NODES = 250_000


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(``node``, ``label``) for each node of ``edges`` (``a``, ``b``); the label is the smallest node of its component.

    Labels are parents in a forest. In each round a node takes the smallest
    grandparent among its neighbours and itself, and hands it to its parent as
    well, so that whole trees are joined and not single nodes: rounds grow with
    the logarithm of a component's size, also on long paths. All proposals are
    reduced with ``min`` before they are shuffled, so a node with very many
    edges or children is no bottleneck; joins spread such nodes over tasks.
    Self-loops and repeated edges do no harm; null ends are ignored. Rounds go
    on until nothing changes; ``max_rounds`` raises an error beyond it.
    """
    both = edges.where("a is not null and b is not null")
    both = stored(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "cc-labels")
    small = labels.count() <= BROADCAST_NODES
    degrees = None if small else stored(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "cc-degrees")
    for rounds in itertools.count(1):
        parents = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        known = labels.join(F.broadcast(parents), "label") if small else stored(spread_join(labels, parents, "label"), "cc-known")
        above = known.select(F.col("node").alias("b"), "above")
        near = (both.join(F.broadcast(above), "b") if small else spread_join(both, above, "b", degrees)).groupBy("a").agg(F.min("above").alias("near"))
        found = known.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("above", "near").alias("best"))
        proposed = found.select(F.explode(F.array(F.struct("node", F.col("label").alias("before"), "best"), F.struct(F.col("label").alias("node"), F.lit(None).cast("long").alias("before"), "best"))).alias("p"))
        step = stored(proposed.select("p.*").groupBy("node").agg(F.min("best").alias("label"), F.max("before").alias("before")), "cc-labels")
        labels = step.select("node", "label")
        if step.where("label <> before").limit(1).count() == 0:
            return labels
        if max_rounds and rounds >= max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
