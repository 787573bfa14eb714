import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm import near_vectors, posting_search

SCHEMA = "vec_id long, embedding array<float>, label int, id string, rank int"


def table(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(base)]
    for i in range(40):  # near copies, some of another label, and equal ones
        near = base[i % 5] + rng.normal(size=16) * 0.05
        rows.append((1000 + i, [float(x) for x in near], int(i % 5 % 3 if i % 4 else 2)))
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(5)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, [None] + [1.0] * 15, 1), (3004, [float("inf")] * 16, 1), (3005, rows[0][1], None), (3006, [], 1), (3007, [1.0, 2.0], 1), (3008, [1.0, 2.0], 1)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.float32(a).astype(float), np.float32(b).astype(float)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_near_duplicates_match_all_pairs(spark):
    rows, df = table(spark)
    links = {r[0]: set() for r in rows}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if good(a[1]) and good(b[1]) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    least = {i: i for i in links}
    for _ in links:
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in links}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df, 0.98).collect()}
    assert len(got) == len(rows)
    assert got == {i: (len(links[i]), least[i], least[i] == i) for i in links}
    assert sum(len(x) for x in links.values()) > 50


def test_near_duplicates_of_nothing(spark):
    _, df = table(spark)
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0
    bad = near_vectors.near_duplicates(df.where("vec_id between 3000 and 3004")).collect()
    assert [(r.n_links, r.kept) for r in bad] == [(0, True)] * 5


def test_many_near_copies_are_counted_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 8)
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(size=16) * 0.01], 1) for i in range(60)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.n_links for r in got} == {59} and {r.component_id for r in got} == {0}


def test_links_inside_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(1200, 64))
    rows[:400] = rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.1  # a third of all rows, mean cosine 0.99
    rows = np.float32(rows)
    u = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(df).collect()}
    assert links[:400].min() > 100 and all(got[i] == (0, i) for i in range(400, 1200))
    assert sum(got[i][0] for i in range(400)) >= 0.999 * links.sum() and {got[i][1] for i in range(400)} == {0}
    assert all(got[i][0] <= links[i] for i in range(400))


@pytest.mark.parametrize("block", [16, 2048])
def test_search_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(posting_search, "BLOCK", block)
    monkeypatch.setattr(posting_search, "LIST", 32)
    rows, df = table(spark, 500)
    have = [(i, v) for i, v, _ in rows if good(v) and len(v) == 16]
    got = {}
    for r in posting_search.nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = {i: v for i, v in have if i % 50 == 0}
    assert set(got) == set(asked)
    hits = 0
    for i, v in asked.items():
        best = sorted((-cosine(v, w), j) for j, w in have if j != i)[:5]
        found = sorted(got[i])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        assert all(abs(s - cosine(v, dict(have)[j])) < 1e-9 for _, j, s in found)
        hits += len({j for _, j in best} & {j for _, j, _ in found})
    assert hits >= 0.9 * 5 * len(asked)


def test_rows_that_repeat_an_id_all_take_part(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 60, [float(c) for c in v]) for i, v in enumerate(np.float32(rng.normal(size=(200, 8))))]
    rows += [(7, rows[50][1]), (50, rows[50][1]), (7, rows[50][1])]  # equal to a query, once under its own id
    got = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in posting_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).collect())
    true = Counter()
    for at, (i, v) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-round(cosine(v, w), 9), j) for k, (j, w) in enumerate(rows) if k != at)[:5]
            true.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(best))
    assert sum((got & true).values()) >= 0.9 * sum(true.values()) and sum(got.values()) == sum(true.values())
    assert got[50, 1, 7, 1.0] == got[50, 2, 7, 1.0] == got[50, 3, 50, 1.0] == 2  # each of the two equal queries finds the other three


def test_search_of_few_and_none(spark):
    _, df = table(spark)
    assert posting_search.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = posting_search.nearest(df.where("vec_id in (0, 1, 50)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (50, 1), (50, 2)]
    ties = posting_search.nearest(df.where("vec_id in (7, 2000, 2001, 2002, 2003, 2004, 100)"), F.col("vec_id") == 7).orderBy("rank").collect()
    assert [r.vec_id for r in ties] == [2000, 2001, 2002, 2003, 2004]


def test_ids_that_repeat_do_not_mix_labels(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 2), (2, [0.0, 1.0, 0.0], 1), (3, [0.0, 0.0, 1.0], 2), (3, [0.0, 0.0, 1.0], 2), (4, [0.0, 0.01, 1.0], 2)]
    out = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(tuple(r) for r in out) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]


@pytest.mark.parametrize("share", [0.01, 0.1, 1.0])
def test_links_of_planted_groups(spark, share):
    rng = np.random.default_rng(11)
    n = 2000
    m = int(n * share)
    rows = rng.normal(size=(n, 64))
    rows[:m] = rng.normal(size=64) + rng.normal(size=(m, 64)) * 0.1
    rows = np.float32(rows)
    u = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.99 * links.sum() and all(got[i] <= links[i] for i in got)


def test_graph_search_is_bounded_and_good():
    rng = np.random.default_rng(12)
    centroids = near_vectors.unit(rng.normal(size=(600, 16)))
    graph, u = posting_search.CentroidGraph(centroids), near_vectors.unit(rng.normal(size=(200, 16)))
    ids, far = graph.search(u, 24)
    assert ids.shape == (200, 24) and (np.diff(far, axis=1) >= 0).all() and all(len(set(row)) == 24 for row in ids.tolist())
    true = np.argsort(-(u @ centroids.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids.tolist(), true.tolist())]) > 0.97
