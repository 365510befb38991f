"""Connected components by contraction, with written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.support import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) for every id in ``edges`` (``a``, ``b``).

    In a round every node that is left points to the smallest of itself and its neighbours,
    pointers are followed twice, and the edges are drawn anew between the nodes pointed at,
    together with those of pointers that lead further on. A path shrinks to a fraction
    each round. Neighbours meet in a minimum, which is combined before the shuffle, so a
    node with very many of them is no hot group.
    """
    edges = edges.select("a", "b").distinct()
    left = materialize(edges.unionAll(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(left.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct(), "labels")
    left = left.filter("a <> b")
    while not left.isEmpty():
        hooks = left.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        hooks = materialize(hooks, "hooks")
        for _ in range(2):
            onward = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(onward, "to").select("a", F.col("next").alias("to"))
        hooks = materialize(hooks, "hooks")
        onward = hooks.select(F.col("a").alias("component"), "to")
        labels = materialize(
            labels.join(onward, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels"
        )
        ends = hooks.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        drawn = left.join(hooks, "a").join(ends, "b").select(F.col("to").alias("a"), F.col("to_b").alias("b"))
        further = hooks.select(F.col("to").alias("b")).distinct().join(ends, "b").select(F.col("b").alias("a"), F.col("to_b").alias("b"))
        further = further.unionAll(further.select("b", "a"))
        left = materialize(drawn.unionAll(further).filter("a <> b").distinct(), "edges")
    return labels
