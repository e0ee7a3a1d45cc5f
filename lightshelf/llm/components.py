"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import stored

#: Rows (of two ids) up to which the smaller side of a join is sent to all tasks, and the parts that a label is cut into beyond.
FEW, PARTS = 200_000, 16


def _relabelled(labels: DataFrame, changes: DataFrame, n: int) -> DataFrame:
    """`labels` with the column `new` of `changes` (n rows of `old`, `new`) where the label is `old`.

    Most nodes may have one label: its join is no single task's.
    """
    if n <= FEW:
        return labels.join(F.broadcast(changes), labels.label == changes.old, "left")  # of a measured size
    salted = labels.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    spread = changes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return salted.join(spread, (salted.label == spread.old) & (salted.part == spread.part), "left").drop("part")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`node` and `component` (smallest node reachable) of all nodes of edges `a`-`b`; nodes without edges are not listed.

    Each round gives every node the smallest label among its own, its
    neighbours' and its label's; labels jump, so that the rounds grow with the
    logarithm of the longest path.  Hot nodes only meet in aggregates, which
    Spark combines before the shuffle.  Labels are written out after each round.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(both)
    # first labels: the smallest neighbour
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        seen = links.join(la, "a").join(lb, "b").where("la <> lb").select("la", "lb")
        # where two labels meet, the larger one and its nodes take the smaller
        hooks = stored(seen.select(F.greatest("la", "lb").alias("old"), F.least("la", "lb").alias("new")).groupBy("old").agg(F.min("new").alias("new")))
        n = hooks.count()
        if not n:
            return labels.withColumnRenamed("label", "component")
        held = stored(_relabelled(labels, hooks, n).select("node", F.least(F.coalesce("new", "label"), "label").alias("label")))
        up = held.where("node <> label").select(F.col("node").alias("old"), F.col("label").alias("new"))
        # only nodes that are labels can be jumped over
        up = stored(up.join(held.select(F.col("label").alias("old")).distinct(), "old", "left_semi"))
        labels = stored(_relabelled(held, up, up.count()).select("node", F.coalesce("new", "label").alias("label")))
    raise RuntimeError("components: labels still change; raise most_rounds")
