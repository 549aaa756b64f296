"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(``node``, ``comp``): the smallest node reachable, for every node of ``edges`` (``a``, ``b``).

    Each round a node takes the smallest label among its own and its neighbours', then the
    label of its label, which halves the way to the root; rounds end when nothing changes.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = scratch.write(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("c").alias("c"))
        )
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        root = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = step.join(root, "comp", "left").select("node", "was", F.coalesce(F.least("up", "comp"), "comp").alias("comp"))
        step = scratch.write(step, "labels")
        changed = step.where("was <> comp").limit(1).count()
        old, labels = labels, step
        scratch.drop(old)
        if not changed:
            scratch.drop(both)
            return labels.select("node", "comp")
