"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmafold.runtime import materialise, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 200) -> DataFrame:
    """(vertex, component) of every vertex of an undirected edge table; component is the least vertex.

    Every round takes the least label over the neighbours, then the label of that label, so the number
    of rounds follows the logarithm of the diameter in practice.  Each round is written to the shared
    folder.  Null ends are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = materialise(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.col("vertex")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("vertex").alias("b"), "component"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("near"))
        step = labels.select("vertex", "component").join(near, "vertex").select("vertex", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("vertex").alias("component"), F.col("component").alias("root"))
        nxt = materialise(step.join(jump, "component").select("vertex", "was", F.least("component", "root").alias("component")), "labels")
        release(labels)
        labels, stable = nxt, nxt.where("component <> was").isEmpty()
        if stable:
            release(both)
            return labels.select("vertex", "component")
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")
