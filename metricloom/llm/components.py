"""Connected components of links, without bringing them to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, component (the smallest node that links reach) for the ends of ``edges`` (columns a, b, both bigint).

    Each round every node takes the smallest label among its own and its neighbours', then the label
    of its label. Labels are pre-aggregated before they are shuffled, so a node with many links is no
    hot key; the joins' other sides have one row for each node. Rounds are cut at written tables, which
    go when the next round is written. The number of rounds grows with the logarithm of the longest
    chain of links; more than ``rounds`` is an error. No edges give no rows.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").toDF("src", "dst"), "links")
    labels = stash(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("label").alias("seen"))
        step = stash(labels.join(near, F.col("node") == F.col("dst"), "left").select("node", F.least("label", F.coalesce("seen", "label")).alias("next"), F.col("label").alias("was")), "step")
        jump = step.select(F.col("node").alias("n2"), F.col("next").alias("far"))
        new = stash(step.join(jump, F.col("next") == F.col("n2")).select("node", F.col("far").alias("label"), (F.col("far") != F.col("was")).alias("moved")), "labels")
        discard(labels, step)
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"labels still move after {rounds} rounds")
