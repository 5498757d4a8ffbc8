"""Connected components of a graph given as an edge table, by repeated contraction.

In each round every node hooks onto its smallest neighbour if that is smaller; a node smaller than all
its neighbours that nobody hooks onto hooks onto the smallest node that a neighbour has hooked onto. So
every tree has two nodes at least, and what is left of a component at least halves. Parents are then
replaced by their parents until none changes: a path of length l takes log2 l such steps. Edges are
rewritten to the roots; loops and repeats vanish. Rounds and steps both grow with the logarithm of the
number of nodes. Each reads tables written before it, so joins on a much-used parent can be split at
run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import materialise


def _hooked(edges: DataFrame) -> DataFrame:
    """(node, root, moved): the parent that each node hooks onto, smaller than itself or itself."""
    low = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), "hooks")
    near = edges.join(low.select(F.col("node").alias("b"), F.col("up").alias("up_b")), "b")
    seen = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.min("up_b").alias("next"), F.max(F.col("up_b") == F.col("a")).alias("chosen"))
    root = F.when(F.col("low") < F.col("node"), F.col("low")).when(F.col("chosen"), F.col("node")).otherwise(F.col("next"))
    return seen.select("node", root.alias("root"), F.lit(True).alias("moved"))


def _jumped(up: DataFrame) -> DataFrame:
    """Each node's parent's parent; ``moved`` tells whether that is another one."""
    above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return up.drop("moved").join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))


def connected_components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b: long); root is one node of its component.

    Loops, repeated edges and rows with a null end are allowed and change nothing; a node that has
    only loops is not returned. No edges: an empty result. ``rounds`` is given the number of jumps of
    each round.
    """
    left = edges.where("a <> b").select("a", "b")
    left = materialise(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    while left.limit(1).count():
        up, jumps = materialise(_hooked(left), "parents"), 0
        while up.where("moved").limit(1).count():
            up, jumps = materialise(_jumped(up), "parents"), jumps + 1
        up = up.select("node", "root")
        maps.append(up)
        if rounds is not None:
            rounds.append(jumps)
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialise(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = maps[0]
    for later in maps[1:]:
        label = materialise(label.join(later.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
    return label
