"""Connected components by contraction: every step is a join or an aggregation that Spark spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is some node of its component, the same for all of it.

    In each round a node hooks to its smallest neighbour if that is smaller, hooks are followed twice, and the graph shrinks
    to what its edges still join. Rows are distinct edges between what is left, so no neighbourhood is gathered in one place.
    """
    e = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = written(e, "components-edges")
    roots = None
    while not e.isEmpty():
        # only the larger end of an edge has a smaller neighbour; ends that are nobody's larger end stay
        hook = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        hook = written(hook, "components-hooks")
        for _ in range(2):
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = hook.join(up, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        hook = written(hook, "components-hooks")
        left = e.join(hook.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
        left = left.join(hook.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
        if roots is None:
            ends = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
            roots = ends.join(hook, "node", "left").select("node", F.coalesce("to", "node").alias("root"))
        else:
            moved = hook.select(F.col("node").alias("root"), "to")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(roots, "components-roots")
        e = written(left.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    return roots if roots is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
