"""Density clusters against the definition: components at every threshold, over all pairs."""

import numpy as np
import pytest

from shoebox.operators.density import density_clusters
from shoebox.operators.groups import nearest_to_queries
from pyspark.sql import functions as F


def brute(n, weights, least, single=False):
    """Leaf of each row by walking all thresholds; `weights` are (a, b, w)."""
    part = {i: frozenset([i]) for i in range(n)}
    leaves = {}  # a live component that has not met another one: its seed
    dead, noise = set(), [None] * n
    final = {}
    for t in sorted({w for _, _, w in weights}):
        before = dict(part)
        for a, b, w in weights:
            if w == t and part[a] is not part[b]:
                both = part[a] | part[b]
                for i in both:
                    part[i] = both
        for whole in set(part.values()):
            if len(whole) < least:
                continue
            olds = {before[i] for i in whole if len(before[i]) >= least}
            if whole in olds:
                continue
            if not olds:
                leaves[whole] = min(whole)
            elif len(olds) == 1:
                (old,) = olds
                if old in leaves:
                    leaves[whole] = leaves.pop(old)
                else:
                    dead.add(whole)
            else:
                for old in olds & set(leaves):
                    final[old] = leaves.pop(old)
                dead.add(whole)
    final |= leaves if (len(final) + len(leaves) > 1 or single) else {}
    for members, seed in final.items():
        for i in members:
            noise[i] = seed
    return noise


def reach(x, samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, samples - 1]
    return d, [(i, j, max(d[i, j], core[i], core[j])) for i in range(len(x)) for j in range(i)]


def all_pairs(spark, d):
    n = len(d)
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(n) if i != j], "query_id long, id long, distance double")


def planted(seed, dims=8):
    """Dense, loose and nested groups on the sphere, and rows that belong nowhere."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = [c + s * rng.normal(size=(m, dims)) for c, s, m in zip(centres, (0.02, 0.05, 0.1, 0.15, 0.2), (30, 25, 20, 15, 12))]
    rows.append(centres[0] + 0.3 + 0.02 * rng.normal(size=(10, dims)))
    rows.append(rng.normal(size=(12, dims)))
    x = np.concatenate(rows)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("seed, least, samples", [(0, 4, 3), (1, 5, 1), (2, 2, 2)])
def test_all_pairs_give_the_whole_clustering(spark, seed, least, samples):
    x = np.random.default_rng(seed).normal(size=(45, 2)).round(1)  # with ties and rows that repeat
    d, weights = reach(x, samples)
    got = {r.id: r.cluster for r in density_clusters(all_pairs(spark, d), least, samples).collect()}
    assert got == dict(enumerate(brute(len(x), weights, least)))
    assert len(set(got.values())) > 2


def test_nearest_neighbours_are_enough_for_planted_densities(spark):
    x = planted(3)
    _, weights = reach(x, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    near = nearest_to_queries(rows, rows, "id", "v", 15).withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))))
    got = {r.id: r.cluster for r in density_clusters(near).collect()}
    want = brute(len(x), weights, 4)
    assert got == dict(enumerate(want))
    assert None in want and len(set(want)) > 5


def test_defined_cases(spark):
    schema = "query_id string, id string, distance double"
    assert density_clusters(spark.createDataFrame([], schema)).count() == 0
    # too few rows to be live, a row of its own, a null and a pair with no distance: all are noise
    rows = [("a", "b", 1.0), ("b", "a", 1.0), ("c", "c", 0.0), ("d", None, 1.0), ("e", "f", None), ("g", "h", float("nan"))]
    got = density_clusters(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.id for r in got) == list("abcdefgh") and all(r.cluster is None and r.birth is None for r in got)
    # one dense group never splits: no cluster, unless asked for; equal rows are at distance 0; repeated pairs count once
    ring = [(i, j, 0.0) for i in "abcde" for j in "abcde" if i != j] * 2
    one = spark.createDataFrame(ring, schema)
    assert {r.cluster for r in density_clusters(one).collect()} == {None}
    assert {r.cluster for r in density_clusters(one, single=True).collect()} == {"a"}
    two = one.unionByName(spark.createDataFrame([(i.upper(), j.upper(), d) for i, j, d in ring], schema))
    assert {r.id: r.cluster for r in density_clusters(two).collect()} == {x: ("a" if x.islower() else "A") for x in "abcdeABCDE"}
