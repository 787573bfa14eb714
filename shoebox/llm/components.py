"""Connected components of an undirected graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.tables import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b long); component is the smallest node reachable.

    Least labels spread along edges and every label is then replaced by its own label, so long paths take few rounds.
    Each round is a partial-aggregated minimum and a join of two written tables, which Spark can split at hot keys:
    neither a node with very many edges nor a label held by very many nodes meets in one task. Loops and repeated
    edges do no harm; without edges the result is empty.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    total = _total(labels)
    while total is not None:
        spread = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label").unionByName(labels)
        least = materialize(spread.groupBy("node").agg(F.min("label").alias("label")), "labels")
        own = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        done, labels = labels, materialize(least.join(own, "label").select("node", F.col("next").alias("label")), "labels")
        discard(done, least)  # the next round reads `both` and `labels` only
        before, total = total, _total(labels)
        if total == before:
            break
    discard(both)
    return labels.withColumnRenamed("label", "component")


def _total(labels: DataFrame):
    """Labels only ever fall, so an unchanged sum means that none has changed. None without rows."""
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
