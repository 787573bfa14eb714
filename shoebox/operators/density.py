"""Density clusters (HDBSCAN with leaf selection) of a graph of nearest neighbours, by joins and aggregates over its edges.

An edge weighs the mutual reachability of its ends: the largest of their distance and of both core distances. At a
threshold t the edges of at most t make components; one of `least` rows or more is live. A leaf is a live component that
holds no two live ones at any lower threshold, as large as it gets before it meets another live one; what lies in no
leaf is noise. No dendrogram is needed for that:

* A row's birth is the least threshold at which its component is live. It is found by adding the nearest outside row
  `least` - 1 times, for which each row's `least` - 1 lightest edges are enough.
* An edge is lifted to the later birth of its ends. Births then say how far each row is from a leaf, and rows flow down:
  a plateau (rows of one birth joined by edges lifted no higher) with a lighter neighbour passes to it, one without is
  the seed of a leaf. Pointers are doubled each round, so the rounds grow with the logarithm of the longest descent.
* A leaf ends at its lightest lifted edge into another leaf's rows; its cluster is the rows of its basin born before.

Every step's work is proportional to the edges. The result is that of the graph that is handed in: with all pairs it is
the whole clustering; with each row's k nearest it differs only where an edge between two rows that both have k nearer
ones would have joined two leaves before the graph's edges do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.operators.groups import components
from shoebox.session import ensure_checkpoint_dir


def reachability(neighbours: DataFrame, samples: int = 3) -> DataFrame:
    """(a, b, w), both ways, of (query_id, id, distance): an edge's mutual reachability.

    A row counts among its own `samples`, as does the reference's: its core distance is that of its neighbour of rank
    `samples` - 1. A row with fewer neighbours has none, and no edges. A pair that is named twice has its least distance.
    """
    rows = neighbours.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("distance").cast("double").alias("d")).where("a <> b and d is not null and not isnan(d)")
    pairs = rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    if samples > 1:
        one = rows.groupBy("a", "b").agg(F.min("d").alias("d"))
        core = one.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("turn") == samples - 1).select("a", F.col("d").alias("core"))
        pairs = pairs.join(core.withColumnRenamed("core", "core_a"), "a").join(core.select(F.col("a").alias("b"), F.col("core").alias("core_b")), "b")
        pairs = pairs.select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))
    else:
        pairs = pairs.withColumnRenamed("d", "w")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def births(edges: DataFrame, least: int = 4) -> DataFrame:
    """(id, birth): the least threshold at which a row's component has `least` rows; rows that never have it are left out."""
    light = edges.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy("w", "b"))).where(F.col("turn") < least)
    light = light.groupBy("a").agg(F.collect_list(F.struct("w", "b")).alias("light"))  # least - 1 of them
    grown = light.select(F.col("a").alias("id"), F.array("a").alias("part"), F.lit(float("-inf")).alias("birth"))
    for _ in range(least - 1):
        ends = grown.select("id", "part", "birth", F.explode("part").alias("a")).join(light, "a")
        outside = F.array_min(F.filter("light", lambda e: ~F.array_contains("part", e["b"])))
        step = ends.select("id", "part", "birth", outside.alias("e")).groupBy("id").agg(F.first("part").alias("part"), F.first("birth").alias("birth"), F.min("e").alias("e"))
        grown = step.where("e is not null").select("id", F.array_append("part", F.col("e")["b"]).alias("part"), F.greatest("birth", F.col("e")["w"]).alias("birth"))
    return grown.select("id", "birth")


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of a forest (id, parent) in which a root is its own parent, by pointer doubling; each round is a
    checkpoint."""
    found, changed = parents.select("id", F.col("parent").alias("root")).checkpoint(), True
    while changed:
        above = found.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = found.join(above, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")).checkpoint()
        changed, found = not moved.where("moved").isEmpty(), moved.select("id", "root")
    return found


def density_clusters(neighbours: DataFrame, least: int = 4, samples: int = 3, single: bool = False) -> DataFrame:
    """(id, birth, cluster) of every row named in (query_id, id, distance).

    `cluster` is the least id of its leaf's seed, null for noise; `birth` the least threshold at which the row is in a
    component of `least` rows, null if it never is. Edges of equal weight join at once. A graph that never splits in two
    has no cluster, unless `single` says that it is one. No rows give no rows; ids may be of any type.
    """
    ensure_checkpoint_dir(neighbours.sparkSession)
    edges = reachability(neighbours, samples).checkpoint()
    born = births(edges, least).checkpoint()
    ends = edges.join(born.select(F.col("id").alias("a"), F.col("birth").alias("birth_a")), "a").join(born.select(F.col("id").alias("b"), F.col("birth").alias("birth_b")), "b")
    lifted = ends.select("a", "b", "birth_a", "birth_b", F.greatest("w", "birth_a", "birth_b").alias("w")).checkpoint()
    level = components(lifted.where("a < b and birth_a = birth_b and w = birth_a").select("a", "b"))
    plateaus = born.join(level.withColumnRenamed("node", "id"), "id", "left").select("id", "birth", F.coalesce("component", "id").alias("plateau")).checkpoint()
    place = plateaus.select("id", "plateau")
    down = lifted.where("birth_b < birth_a and w = birth_a")
    down = down.join(place.withColumnRenamed("id", "a"), "a").join(place.select(F.col("id").alias("b"), F.col("plateau").alias("lower")), "b")
    parent = down.groupBy("plateau").agg(F.min(F.struct("birth_b", "lower")).alias("to")).select("plateau", F.col("to")["lower"].alias("parent"))
    tops = place.select("plateau").distinct().join(parent, "plateau", "left")
    basin = roots(tops.select(F.col("plateau").alias("id"), F.coalesce("parent", "plateau").alias("parent"))).withColumnRenamed("id", "plateau")
    held = plateaus.join(basin, "plateau").select("id", "birth", "root").checkpoint()
    own = held.select("id", "root")
    met = lifted.where("a < b").join(own.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a").join(own.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b")
    met = met.where("root_a <> root_b").select("w", F.explode(F.array("root_a", "root_b")).alias("root"))
    end = met.groupBy("root").agg(F.min("w").alias("end"))
    split = single or held.select("root").distinct().limit(2).count() > 1
    inside = F.lit(split) & (F.col("birth") < F.coalesce("end", F.lit(float("inf"))))
    found = held.join(end, "root", "left").select("id", "birth", F.when(inside, F.col("root")).alias("cluster"))
    everyone = neighbours.select(F.explode(F.array("query_id", "id")).alias("id")).where("id is not null").distinct()
    return everyone.join(found, "id", "left")
