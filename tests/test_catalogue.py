"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from shoebox.plans.collection import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(row[i]) for i in at) for row in relation.fetchall())


def test_components_match_union_find(spark):
    from shoebox.plans import catalogue
    from shoebox.schema import Catalog

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in catalogue._chained(Catalog(spark, SF)).collect():
        a, b = sorted((find(r.a), find(r.b)))
        parent[b] = a
    got = {r.node: r.component for r in QUERIES["union_find_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_near_duplicates_of_all_rows_match_all_pairs(spark):
    import numpy as np

    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").where("embedding is not null").collect())
    u = np.array([r.embedding for r in rows], np.float64)
    near = u @ u.T
    np.fill_diagonal(near, -np.inf)
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    pairs = {tuple(sorted((i, int(j)))) for i in range(len(rows)) for j in np.argsort(-near[i], kind="stable")[:10] if near[i, j] >= 0.38}
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        group[b] = a
    members = {}
    for i in list(group):
        members.setdefault(find(i), []).append(i)
    best = {g: max(ids, key=lambda i: (rows[i].label, -rows[i].vec_id)) for g, ids in members.items()}
    expected = {(rows[i].vec_id, rows[g].vec_id, len(ids), best[g] == i) for g, ids in members.items() for i in ids}
    got = {(r.vec_id, r.group, r["size"], r.is_best) for r in QUERIES["near_duplicates_all"](spark, SF).collect()}
    assert got == expected
    assert any(rows[i].vec_id % 20 and rows[j].vec_id % 20 for i, j in pairs)


def test_graph_of_nearest_has_every_row(spark):
    import numpy as np

    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").collect())
    u = np.array([r.embedding for r in rows], np.float64)
    near = u @ u.T
    np.fill_diagonal(near, -np.inf)
    want = {(rows[i].vec_id, rank + 1, rows[int(j)].vec_id) for i in range(len(rows)) for rank, j in enumerate(np.argsort(-near[i], kind="stable")[:10])}
    assert {(r.query_id, r["rank"], r.id) for r in QUERIES["knn_graph"](spark, SF).collect()} == want and len(want) == 10 * len(rows)


def test_graph_of_nearest_ties_as_in_sql(spark, tmp_path, monkeypatch):
    """Products that tie when summed in the order of the components, not in that of a matrix product of one query."""
    from shoebox.operators import groups

    monkeypatch.setattr(groups, "CELLS", 1)
    small = 2.0**-53
    rows = [(i, [1.0] + [small * (i % 2)] * 63, 0) for i in range(60)] + [(100, [1.0] * 64, 0), (101, [0.25] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"select query_id, rank, id from ({ORACLE['knn_graph']})").fetchall()
    assert {(r.query_id, r["rank"], r.id) for r in QUERIES["knn_graph"](spark, str(tmp_path)).collect()} == set(want)
    assert [i for q, _, i in sorted(want) if q == 100] == [101, *range(9)]
