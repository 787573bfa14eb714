import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.sources import vector_index
from shoebox.sources.vector_index import VectorIndex


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 24))
    return np.float32(centers[rng.integers(40, size=4000)] + rng.normal(size=(4000, 24)) * 0.6)


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    rows = [(i, v.tolist(), i % 100, i % 1000) for i, v in enumerate(vectors)]
    rows += [(9000, None, 0, 0), (9001, [], 0, 0), (9002, [0.0] * 24, 0, 0), (9003, [float("nan")] * 24, 0, 0), (9004, [None] + [1.0] * 23, 0, 0), (9005, [1.0, 2.0], 0, 0), (9006, [2.0, 1.0], 1, 0), (7, vectors[11].tolist(), 7, 7)]
    df = spark.createDataFrame(rows, "id long, v array<float>, part int, cell int").repartition(6)
    return VectorIndex.build(df, str(tmp_path_factory.mktemp("index")), "id", "v")


def true(vectors, query, k, keep):
    u = np.vstack((vectors, vectors[11:12])).astype(float)
    ids = np.append(np.arange(len(vectors)), 7)
    cos = u @ query / np.linalg.norm(u, axis=1) / np.linalg.norm(query)
    return sorted((-round(float(c), 7), int(i)) for c, i in zip(cos, ids) if keep(i))[:k]


@pytest.mark.parametrize("every", [1, 100, 1000])
def test_recall_and_what_is_read(index, vectors, every):
    """Filters that keep all rows, one in a hundred and one in a thousand."""
    hits = asked = read = 0
    column = {1: F.lit(0), 100: F.col("part"), 1000: F.col("cell")}[every]
    for q in range(0, 4000, 500):
        found = index.search(vectors[q].tolist(), 4, where=column == 0)
        got = [(-round(r.score, 7), r.id) for r in found.hits.collect()]
        want = true(vectors, vectors[q].astype(float), 4, lambda i: i % every == 0)
        assert len(got) == 4 and got == sorted(got)
        hits, asked, read = hits + len(set(got) & set(want)), asked + len(want), read + found.cells_read
        assert found.rows_read <= 4001
    assert hits >= 0.95 * asked
    assert read / 8 < {1: 0.5, 100: 1.01, 1000: 1.01}[every] * len(index.cells)


def test_an_exact_search_is_brute_force_and_prunes(index, vectors):
    for q in (0, 11, 77):
        found = index.search((vectors[q].astype(float) * 3).tolist(), 6, exact=True)
        assert [(-round(r.score, 7), r.id) for r in found.hits.collect()] == true(vectors, vectors[q].astype(float), 6, lambda i: True)
    few = index.spark.createDataFrame([(i,) for i in (3, 5, 800, 9005)], "id long")
    assert [r.id for r in index.search(vectors[5].tolist(), 9, within=few).hits.collect()][0] == 5 and index.search(vectors[5].tolist(), 9, within=few).hits.count() == 3


def test_only_the_cells_asked_for_are_read(index):
    plan = index.table(3, 4).where("part = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [index_cell" in plan and "PushedFilters: [IsNotNull(part), EqualTo(part,1)]" in plan
    assert {r.index_cell for r in index.table(3, 4).select("index_cell").distinct().collect()} == {3, 4}


def test_other_lengths_and_odd_queries(index):
    assert [r.id for r in index.search([1.0, 2.0], 5).hits.collect()] == [9005, 9006]
    assert index.search([1.0], 5).hits.collect() == index.search([0.0] * 24, 5).hits.collect() == index.search([float("nan")] * 24, 5).hits.collect() == []


def test_a_new_version_takes_over_and_nothing_can_be_indexed(spark, index, tmp_path):
    path = str(tmp_path / "index")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    old = VectorIndex.build(df, path, "id", "v")
    VectorIndex.build(df.where("id = 2"), path, "id", "v")
    assert [r.id for r in old.search([1.0, 0.1], 5).hits.collect()] == [1, 2] and [r.id for r in VectorIndex(spark, path).search([1.0, 0.1], 5).hits.collect()] == [2]
    none = VectorIndex.build(df.limit(0), path, "id", "v")
    assert none.search([1.0, 0.0], 5).hits.collect() == []


def test_centroids_fill_every_cell():
    x = np.repeat(np.eye(4), 5, axis=0)
    c = vector_index.fit_centroids(x, 6)
    assert c.shape == (6, 4) and np.allclose(np.linalg.norm(c, axis=1), 1)
