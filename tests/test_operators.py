from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoebox.functions import text, vector
from shoebox.operators import aggregate, groups, pairs, ranking, timeline, tuning, upkeep
from shoebox.operators.geo import reverse_geocode
from shoebox.sources import files


def signal(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")


def test_rrf_ties_weights_and_zero(spark):
    a, b = signal(spark, ["x", "y", "z"]), signal(spark, ["y", "x"])
    assert [r.id for r in ranking.rrf({"a": a, "b": b}, {}).collect()] == ["x", "y", "z"]
    assert [r.id for r in ranking.rrf({"a": a, "b": b}, {"a": 1.0, "b": 2.0}).collect()][0] == "y"
    assert ranking.rrf({"a": a}, {"a": 0.0}).count() == 0


def test_metrics(spark):
    judged = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("none", "c", 0)], "query string, id string, grade int")
    rows = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(["x", "a", "y", "b"])], "query string, id string, rank int")
    got = {r.query: r for r in ranking.recall_precision_mrr_ndcg(rows, judged, 2).collect()}
    assert got["q"].recall == 0.5 and got["q"].precision == 0.5 and got["q"].mrr == 0.5 and 0 < got["q"].ndcg < 1
    assert got["none"].recall is None
    best = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "query string, id string, rank int")
    assert ranking.recall_precision_mrr_ndcg(best, judged, 10).where("query = 'q'").first().ndcg == 1.0


def test_representative_of_rows_without_score(spark):
    rows = spark.createDataFrame([("a", 2, None), ("a", 1, None), ("b", 3, 1.0), ("b", 4, None), (None, 5, 9.0)], "g string, id int, s double")
    got = {r.value: r.best_id for r in aggregate.group_counts(rows, F.col("g"), 50, ("id", "s")).collect()}
    assert got == {"a": 1, "b": 3}
    with pytest.raises(ValueError):
        aggregate.dimension("anything; drop table")


def test_first_last_counts_undated_rows(spark):
    rows = spark.createDataFrame([("g", datetime(2025, 1, 1), 1), ("g", datetime(2025, 1, 2), 2), ("g", None, 3)], "g string, at timestamp_ntz, id int")
    r = aggregate.first_last(rows, "g", "at", "id").first()
    assert (r.first_id, r.last_id, r.n) == (1, 2, 3)


def test_bursts_keep_equal_gaps_and_null_cameras(spark):
    start = datetime(2025, 1, 1)
    rows = [(i, None, start + timedelta(seconds=s), float(i)) for i, s in enumerate([0, 2, 4])] + [(9, "x", start + timedelta(seconds=1), 1.0), (10, None, start + timedelta(seconds=6.5), 1.0)]
    got = timeline.bursts(spark.createDataFrame(rows, "id int, camera string, at timestamp_ntz, sharp double"), "camera", "at", "id", "sharp").collect()
    assert [(r.camera, r["size"], r.best_id) for r in got] == [(None, 3, 2)]


def test_trips_join_away_segments_only(spark):
    day = datetime(2025, 1, 1)
    rows = [("u", day, day, False), ("u", day + timedelta(days=1), day + timedelta(days=1), True), ("u", day + timedelta(days=3), day + timedelta(days=3), True), ("u", day + timedelta(days=6), day + timedelta(days=6), True), ("u", day + timedelta(days=7), day + timedelta(days=7), None)]
    df = spark.createDataFrame(rows, "u string, started timestamp_ntz, ended timestamp_ntz, away boolean")
    assert [r.trip for r in timeline.trips(df, ["u"], "started", "ended", F.col("away")).orderBy("started").collect()] == [1, 2, 2, 3, 4]


def test_titles(spark):
    rows = [("Rome", datetime(2025, 6, 1, 3), datetime(2025, 6, 1, 9)), ("Rome", datetime(2025, 6, 1), datetime(2025, 6, 3)), (None, datetime(2025, 6, 30), datetime(2025, 7, 1))]
    df = spark.createDataFrame(rows, "p string, s timestamp_ntz, e timestamp_ntz")
    assert [r.t for r in df.select(timeline.title(F.col("p"), F.col("s"), F.col("e")).alias("t")).collect()] == ["Rome · Jun 1, 2025", "Rome · Jun 1–3, 2025", "Photos · Jun 2025 – Jul 2025"]


def test_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "fffffffffffffffe"), (None, "0000000000000000")], "a string, b string")
    assert [r.d for r in df.select(groups.hamming(groups.hex64("a"), groups.hex64("b")).alias("d")).collect()] == [1, 64]


def test_hamming_pairs_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 20)
    rows = [(i, int(x)) for i, x in enumerate(base)] + [(100 + i, int(x ^ np.int64(1 << int(rng.integers(0, 62))) ^ np.int64(1 << int(rng.integers(0, 62))))) for i, x in enumerate(base)] + [(200, None)]
    got = {(r.a, r.b, r.bits) for r in groups.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", 3).collect()}
    full = {i: x for i, x in rows if x is not None}
    assert got == {(a, b, d) for a in full for b in full if a < b and 0 < (d := bin((full[a] ^ full[b]) & (2**64 - 1)).count("1")) <= 3}


def test_nearest_to_queries_over_blocks(spark):
    v = np.random.default_rng(2).normal(size=(90, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id long, v array<double>")
    got = {}
    for r in groups.nearest_to_queries(df, df.where("id % 20 = 0"), "id", "v", 4, 16, 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in range(0, 90, 20):
        order = sorted((-float(v[q] @ v[i]), i) for i in range(90) if i != q)[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in order]


def test_labels_carry_over(spark):
    rows = [(1, 7)] * 6 + [(1, 8)] * 2 + [(2, 7)] * 3 + [(3, None)] * 3 + [(4, 8)] * 2
    got = {r.new: r.label for r in groups.carry_labels(spark.createDataFrame(rows, "new int, old int"), "new", "old").collect()}
    assert got == {1: 7, 2: None, 3: None, 4: 8}


def test_listing_diff(spark):
    before = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0), ("c", "3", 1.0), ("d", "4", 1.0), ("e", "4", 1.0), ("f", "9", 1.0)], "path string, file_hash string, mtime double")
    after = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 5.0), ("c", "x", 1.0), ("z", "4", 1.0), ("n", "7", 1.0), ("f", "9", 1.0)], "path string, file_hash string, mtime double")
    got = {r.path: (r.status, r.old_path) for r in upkeep.listing_diff(before, after).collect()}
    assert got == {"a": ("unchanged", None), "b": ("touched", None), "c": ("changed", None), "z": ("moved", "d"), "e": ("deleted", None), "n": ("new", None), "f": ("unchanged", None)}
    schema = "path string, file_hash string, mtime double"
    before, after = spark.createDataFrame([("g", None, 1.0), ("h", None, 1.0), ("i", "5", 1.0)], schema), spark.createDataFrame([("h", None, 1.0), ("j", None, 1.0), ("k", "5", 1.0)], schema)
    got = sorted((r.path, r.file_hash, r.status, r.old_path) for r in upkeep.listing_diff(before, after).collect())
    assert got == [("g", None, "deleted", None), ("h", None, "unchanged", None), ("j", None, "new", None), ("k", "5", "moved", "i")]


def test_upserts_and_ledger(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    come = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert {(r.k, r.v) for r in upkeep.upsert(have, come, ["k"], [F.desc("v")]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {(r.k, r.v) for r in upkeep.upsert(have, come, ["k"], [F.col("v")], keep_first=True).collect()} == {(1, "a"), (2, "b"), (3, "e")}
    ledger = spark.createDataFrame([("h1", "imported"), ("h2", "error")], "file_hash string, status string")
    new = spark.createDataFrame([("h1", "p"), ("h2", "q"), ("h3", "r"), ("h3", "s")], "file_hash string, path string")
    assert {r.path: r.status for r in upkeep.import_new(new, ledger, [F.col("path")]).collect()} == {"p": "already_seen", "q": "imported", "r": "imported", "s": "duplicate"}


def test_people_are_merged(spark):
    people = spark.createDataFrame([(1, None, ["x"], False), (2, "Bob", ["x", "y"], False), (3, None, [], False), (4, "Eve", [], False)], "cluster_id int, name string, aliases array<string>, hidden boolean")
    faces = spark.createDataFrame([("f", 1, False), ("g", 2, False), ("h", None, False)], "id string, cluster_id int, manual boolean")
    merged, moved = upkeep.merge_people(people, faces, 1, [3, 2])
    assert {(r.cluster_id, r.name, tuple(r.aliases)) for r in merged.collect()} == {(1, "Bob", ("x", "y")), (4, "Eve", ())}
    assert {(r.id, r.cluster_id, r.manual) for r in moved.collect()} == {("f", 1, False), ("g", 1, True), ("h", None, False)}
    assert {r.cluster_id for r in upkeep.without_orphans(people, moved).collect()} == {1, 2, 4}
    assert upkeep.assign_faces(faces, ["h"], 4).where("id = 'h'").first()[1:] == (4, True)


def test_relink(spark):
    df = spark.createDataFrame([("/a/b/c.jpg",), ("/a/bc.jpg",), ("/a/b",)], "path string")
    assert [r.path for r in upkeep.relink(df, "path", "/a/b/", "/z").collect()] == ["/z/c.jpg", "/a/bc.jpg", "/z"]


def test_geocoder_absorbs_districts(spark):
    places = [("Tokyo", "Tokyo", "Japan", 35.68, 139.69, 8e6), ("Paris", "IdF", "France", 48.85, 2.35, 2e6), ("Paris Vaugirard", "IdF", "France", 48.841, 2.30, 2e5), ("Evanston", "Illinois", "United States", 42.041, -87.69, 7.4e4), ("Chicago", "Illinois", "United States", 41.85, -87.65, 2.7e6), ("Nearby", "Illinois", "United States", 41.86, -87.66, 9e3)]
    points = [(1, 35.678, 139.686), (2, 48.8412, 2.3003), (3, 42.045, -87.688), (4, 0.0, 0.0), (5, None, None), (6, 41.861, -87.661)]
    got = reverse_geocode(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(places, "name string, admin1 string, country string, lat double, lon double, population double"))
    assert {r.id: r.place_name for r in got.collect()} == {1: "Tokyo", 2: "Paris", 3: "Evanston", 4: None, 5: None, 6: "Chicago"}


def test_scene_join_bounds_are_inclusive(spark):
    at = datetime(2025, 1, 1, 12)
    rows = [(1, None, at), (2, None, at + timedelta(minutes=10)), (3, None, at + timedelta(minutes=10, seconds=1)), (4, "x", at), (5, None, at - timedelta(minutes=10))]
    df = spark.createDataFrame(rows, "id int, camera string, at timestamp_ntz")
    assert {(r.anchor_id, r.id) for r in pairs.same_scene(df, df.where("id = 1"), "camera", "at", "id").collect()} == {(1, 2), (1, 5)}


def test_hash_split_is_sha1_modulo(spark):
    from hashlib import sha1

    df = spark.createDataFrame([(f"q{i:04d}",) for i in range(200)], "t string")
    assert all(r.b == int(sha1(r.t.encode()).hexdigest(), 16) % 1000 for r in df.select("t", text.hash_bucket("t").alias("b")).collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("The Cars were parked, and parties ended",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(text.tokens("t").alias("x")).collect()]
    assert got[0] == ["car", "park", "parti", "end"] and got[1] == [] and got[2] is None
    a = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r.j for r in a.select(text.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1 / 3, 0.0]


def test_rocchio_and_centroid(spark):
    moved = vector.rocchio([1.0, 0.0], [[0.0, 1.0]], [[1.0, 0.0]])
    assert np.allclose(moved, np.array([0.75, 0.75]) / np.linalg.norm([0.75, 0.75]))
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "v array<double>")
    assert vector.centroid(df, "v").first().centroid == [2.0, 4.0]


def test_bootstrap_is_reproducible(spark):
    rows = [(i, x, y) for i, (x, y) in enumerate([(0.1, 0.2), (0.5, 0.6), (float("nan"), 0.3), (0.9, 1.0), (0.4, 0.5), (None, 0.1)])]
    df = spark.createDataFrame(rows, "q int, a double, b double")
    low, high = tuning.bootstrap_mean(df, "q", "a", 300).first()
    assert low < 0.475 < high and tuning.bootstrap_mean(df.repartition(3), "q", "a", 300).first() == (low, high)
    assert tuning.paired_p(df, "q", "a", "b", 100).first().p == 0.0 and tuning.paired_p(df, "q", "b", "a", 100).first().p == 1.0
    assert tuning.paired_p(df.where("q = 0"), "q", "a", "b", 10).first().p is None


def test_tuning_prefers_the_simpler_of_equal_settings(spark):
    good = spark.createDataFrame([(q, f"d{q}", 1) for q in range(8)], "query int, id string, rank int")
    bad = spark.createDataFrame([(q, f"x{i}", i) for q in range(8) for i in (1, 2)], "query int, id string, rank int")
    judged = spark.createDataFrame([(q, f"d{q}", 1) for q in range(8)], "query int, id string, grade int")
    r = tuning.tune({"good": good, "bad": bad}, judged, "good").first()
    assert (r.w_good, r.w_bad, r.in_sample, r.cross_validated, r.pinned_alone) == (1.0, 0.0, 1.0, 1.0, 1.0)


@pytest.mark.parametrize("small", [20_000, 10])
def test_percentiles_are_exact(spark, small):
    rng = np.random.default_rng(3)
    values = {"a": rng.integers(0, 40, 9_000) / 4, "b": rng.normal(size=7_001), "c": np.array([2.0]), None: np.array([1.0, 4.0])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("a", None), ("d", None)]
    wanted = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in ranking.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", wanted, slack=0.02, small=small).collect()}
    assert set(got) == set(values)
    assert all(abs(got[g][n] - np.quantile(xs, p)) < 1e-9 for g, xs in values.items() for n, p in wanted.items())


def test_ids_that_are_text(spark):
    edges = [("b", "c"), ("c", "d"), ("x", "y"), ("d", "a-1")]
    got = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a-1": "a-1", "b": "a-1", "c": "a-1", "d": "a-1", "x": "x", "y": "x"}
    big = {r.component for r in groups.components(spark.createDataFrame([(2**62, 2**62 + 1), (2**62 + 2, 2**62 + 1), (2**62 + 4, 2**62 + 5)], "a long, b long")).collect()}
    assert big == {2**62, 2**62 + 4}
    assert groups.components(spark.createDataFrame([], "a string, b string")).count() == 0
    v = [[1.0, 0.0], [0.99, 0.14], [0.0, 1.0], [0.14, 0.99]]
    rows = spark.createDataFrame([(f"id-{i}", x, h, s) for i, (x, h, s) in enumerate(zip(v, (0, 1, 0, -1), (1.0, 2.0, 3.0, 3.0)))], "id string, v array<double>, h long, s double")
    near = groups.nearest_to_queries(rows, rows, "id", "v", 2)
    assert {(r.id, r.group, r.is_best) for r in groups.near_duplicates(near, rows, "id", "h", F.col("s")).collect()} == {("id-0", "id-0", False), ("id-1", "id-0", True)}
    assert {(r.id, r.is_best) for r in groups.near_duplicates(near, rows, "id", None, F.col("s")).where("id > 'id-1'").collect()} == {("id-2", True), ("id-3", False)}


def test_bursts_need_alike_neighbours(spark):
    start = datetime(2025, 1, 1)
    rows = [(f"p{i}", "cam", start + timedelta(seconds=i), float(i), v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.43], [0.0, 1.0], [0.1, 0.99], [0.1, 0.99]])]
    df = spark.createDataFrame(rows, "id string, camera string, at timestamp_ntz, sharp double, v array<double>")
    got = {(r["size"], r.best_id) for r in timeline.bursts(df, "camera", "at", "id", "sharp", alike=("v", 0.85)).collect()}
    assert got == {(2, "p1"), (3, "p4")}
    assert [r["size"] for r in timeline.bursts(df, "camera", "at", "id", "sharp").collect()] == [5]


def test_chains_cross_the_borders_of_slots(spark):
    rng = np.random.default_rng(7)
    start = datetime(2025, 1, 1)
    rows = [(i, ["a", None][i % 2], start + timedelta(seconds=int(s))) for i, s in enumerate(rng.integers(0, 4_000, 300))] + [(900, "a", None), (901, "a", None)]
    df = spark.createDataFrame(rows, "id int, who string, at timestamp_ntz")
    w = Window.partitionBy("who").orderBy("at", "id")
    gap = timeline.seconds_between(F.col("at"), F.lag("at").over(w)) <= 20
    plain = df.withColumn("n", F.coalesce(~gap, F.lit(True)).cast("int")).withColumn("n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for crowded in (0, 149, 1_000):  # always in slots; in slots as one time line has more rows; in one window
        cut = timeline.chains(df, ["who"], "at", ["id"], ["at"], lambda b: timeline.seconds_between(F.col("at"), b["at"]) <= 20, "n", slot_s=37, crowded=crowded)
        assert {tuple(r) for r in cut.select("id", "n").collect()} == {tuple(r) for r in plain.select("id", "n").collect()}
        assert ("chain_key" in cut._jdf.queryExecution().analyzed().toString()) == (crowded < 1_000)


def test_one_kind_is_replaced_alone(spark, tmp_path):
    from shoebox.schema import Catalog

    catalog = Catalog(spark, str(tmp_path))
    make = lambda *rows: spark.createDataFrame(rows, "kind string, photo_id string")
    catalog.write("photo_groups", make(("burst", "a"), ("duplicate", "b"), ("duplicate", "c")), ("kind",))
    catalog.write("photo_groups", make(("burst", "z")), ("kind",))
    assert {(r.kind, r.photo_id) for r in catalog["photo_groups"].collect()} == {("burst", "z"), ("duplicate", "b"), ("duplicate", "c")}


def test_training_pairs_leave_out_what_is_judged(spark):
    day = datetime(2025, 5, 1, 12)
    photos = spark.createDataFrame(
        [("j", "c", day, ["tree"]), ("copy", "x", day, ["tree"]), ("scene", "c", day + timedelta(minutes=9), ["tree"]), ("free", "c", day + timedelta(minutes=30), ["Photo", "tree", "y", "sky"]), ("bare", None, None, ["image"])],
        "id string, camera string, taken_at timestamp_ntz, keywords array<string>",
    ).withColumns({"media_type": F.lit("image"), "thumb_path": F.lit("t"), "error": F.lit(None).cast("string")})
    copies = spark.createDataFrame([("duplicate", "1", "j"), ("duplicate", "1", "copy"), ("burst", "1", "free")], "kind string, group_id string, photo_id string")
    judged = spark.createDataFrame([("j",)], "id string")
    assert {(r.id, r.why) for r in pairs.excluded(photos, judged, copies).collect()} == {("j", "judged"), ("copy", "group"), ("scene", "scene")}
    captions = spark.createDataFrame([("free", "The image shows a tall tree. Too short. It stands near the water! A third one is here."), ("j", "This is a tree.")], "photo_id string, caption string")
    feedback = spark.createDataFrame([("a tall tree", "bare", 1), ("Tall tree, a", "bare", 1), ("red boats", "bare", 1), ("red boat", "free", 0), ("the red boats at sea", "bare", 1)], "query string, photo_id string, label int")
    asked = spark.createDataFrame([("a tall tree!",), ("red boats at sea",)], "query string")
    got = {(r.id, r.text, r.source) for r in pairs.training_pairs(photos, captions, feedback, copies, judged, asked).collect()}
    assert got == {("free", "a tall tree.", "caption"), ("free", "It stands near the water!", "caption"), ("free", "a photo of tree, sky", "keywords"), ("bare", "red boats", "feedback")}


def test_alike_texts_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    make = lambda: " ".join(rng.choice(list("abcdefghij"), rng.integers(0, 9)))
    mine, theirs = [(i, make()) for i in range(200)], [(make(),) for _ in range(30)]
    got = {r.k for r in pairs.alike_texts(spark.createDataFrame(mine, "k int, t string"), "k", "t", spark.createDataFrame(theirs, "u string"), "u", 0.6).collect()}
    sets = [set(t.split()) for (t,) in theirs]
    assert got == {k for k, t in mine if any(s and len(s & set(t.split())) >= 0.6 * len(s | set(t.split())) for s in sets)}


def test_people_are_split_named_and_wiped(spark):
    people = spark.createDataFrame([(1, "Noor", ["x"], False), (7, None, [], True)], "cluster_id int, name string, aliases array<string>, hidden boolean")
    faces = spark.createDataFrame([("f", 1, False), ("g", 1, False), ("h", 3, False)], "id string, cluster_id int, manual boolean")
    more, moved, new = upkeep.split_person(people, faces, ["g"])
    assert new == 8 and {(r.id, r.cluster_id, r.manual) for r in moved.collect()} == {("f", 1, False), ("g", 8, True), ("h", 3, False)}
    assert {tuple(r) for r in more.where("cluster_id = 8").select("name", F.size("aliases"), "hidden").collect()} == {(None, 0, False)}
    named = upkeep.name_person(more, 8, "Ada", hidden=True).where("cluster_id = 8").first()
    assert (named.name, named.aliases, named.hidden) == ("Ada", [], True)
    assert [df.count() for df in upkeep.wipe_faces(faces, people)] == [0, 0]


def test_imports_wait_and_get_free_names(spark):
    now = datetime(2025, 1, 1, 12)
    listing = spark.createDataFrame([("a", now - timedelta(seconds=2)), ("b", now - timedelta(seconds=3))], "path string, mtime timestamp_ntz")
    assert [r.path for r in upkeep.stable(listing, F.lit(now)).collect()] == ["b"]
    taken = spark.createDataFrame([("x.jpg",), ("x-1.jpg",), ("y.tar",)], "name string")
    wanted = spark.createDataFrame([(1, "x.jpg"), (2, "x.jpg"), (3, "y.jpg"), (4, "y.jpg"), (5, "z")], "k int, name string")
    assert {r.k: r.free_name for r in upkeep.free_names(wanted, taken, "name", [F.col("k")]).collect()} == {1: "x-2.jpg", 2: "x-3.jpg", 3: "y.jpg", 4: "y-1.jpg", 5: "z"}
    new = spark.createDataFrame([(None, "p"), (None, "q")], "file_hash string, path string")
    ledger = spark.createDataFrame([("h1", "imported")], "file_hash string, status string")
    assert {r.status for r in upkeep.import_new(new, ledger, [F.col("path")]).collect()} == {"imported"}


def test_more_file_values(spark):
    xmp = "<dc:subject><rdf:Bag><rdf:li>sea</rdf:li><rdf:li>sky </rdf:li></rdf:Bag></dc:subject><lr:hierarchicalSubject><rdf:li>Places|Lisbon|sea</rdf:li></lr:hierarchicalSubject>"
    assert spark.range(1).select(files.xmp_keywords(F.lit(xmp)).alias("k")).first().k == ["sea", "sky", "Places", "Lisbon"]
    df = spark.createDataFrame([(0.0, 0.0), (91.0, 5.0), (38.7, -9.1), (None, 4.0)], "lat double, lon double")
    assert [tuple(r) for r in df.select(*files.position(F.col("lat"), F.col("lon"))).collect()] == [(None, None), (None, None), (38.7, -9.1), (None, None)]
    cams = spark.createDataFrame([("PENTAX RICOH", "K-3"), ("Olympus", "OLYMPUS E-M1"), (None, "Q2"), ("Leica", None), ("iFone Co", "X")], "a string, b string")
    assert [r.c for r in cams.select(files.camera_name(F.col("a"), F.col("b")).alias("c")).collect()] == ["Pentax K-3", "OLYMPUS E-M1", "Q2", "Leica", "iFone X"]
    times = spark.createDataFrame([(0.004,), (2.5,), (0.0,), (None,)], "s double")
    assert [r.t for r in times.select(files.shutter(F.col("s")).alias("t")).collect()] == ["1/250", "2.5s", None, None]
    zone = spark.createDataFrame([("+02:00",), ("-0330",), ("x",)], "z string")
    assert [r.m for r in zone.select(files.offset_minutes("z").alias("m")).collect()] == [120, -210, None]


def test_large_files_are_hashed_by_samples(spark, monkeypatch):
    monkeypatch.setattr(files, "HASHED_WHOLE", 8)
    monkeypatch.setattr(files, "SAMPLE", 2)
    rows = [b"0123456789", b"01x3456789", b"0123x56789", b"01234x6789", b"abc"]
    df = spark.createDataFrame([(bytearray(r), len(r)) for r in rows], "c binary, n long")
    from hashlib import sha256

    got = [r.h for r in df.select(files.content_hash("c", "n").alias("h")).collect()]
    assert got == [sha256(b"10" + r[:2] + r[5:7] + r[-2:] if len(r) > 8 else r).hexdigest() for r in rows]
    assert len(set(got)) == 3


def test_a_registry_keeps_models_apart(spark):
    from shoebox.functions import plugins

    lengths = plugins.Model("lengths", 1, lambda: lambda values: [[float(len(v))] for v in values], query_prefix="q: ")
    registry = plugins.Registry(lengths)
    row = spark.createDataFrame([("abc",)], "t string").select(registry.queries("t", "lengths").alias("q"), registry.documents("t", "lengths").alias("d")).first()
    assert (row.q, row.d) == ([6.0], [3.0])
    with pytest.raises(KeyError):
        registry["none"]
    with pytest.raises(ValueError):
        registry.add(lengths)


def test_near_misses_and_single_rows(spark):
    rows = spark.createDataFrame([(i, i / 100) for i in range(80, 100)], "k int, s double")
    got = groups.near_misses(rows, 0.97, 0.88, 0.97, "s", ["k"], 2).collect()
    assert sorted(r.kind for r in got) == ["flagged", "flagged", "near_miss", "near_miss"]
    assert aggregate.one(rows.where("k = 80")).s == 0.8
    with pytest.raises(LookupError):
        aggregate.one(rows.where("k = 1"))


def test_json_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "rows")
    files.replace_json(spark.range(3), path)
    files.replace_json(spark.range(5), path)
    assert spark.read.json(path).count() == 5
    files.replace_json(spark.read.schema("id long").json(path).where("id > 1"), path)  # rows may come from what they replace
    assert sorted(r.id for r in spark.read.json(path).collect()) == [2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["rows"]


def test_a_table_survives_a_writer_that_fails(spark, tmp_path):
    from shoebox.schema import Catalog
    from shoebox.sources.swap import put_in_place, restore

    catalog, path = Catalog(spark, str(tmp_path)), str(tmp_path / "people.parquet")
    ids = lambda: sorted(r.id for r in catalog["people"].collect())
    catalog.write("people", spark.range(3))
    catalog.write("people", catalog["people"].union(spark.range(7, 8)))
    assert ids() == [0, 1, 2, 7]
    with pytest.raises(Exception):  # noqa: B017
        catalog.write("people", catalog["people"].select(F.raise_error(F.lit("no")).alias("id")))
    assert ids() == [0, 1, 2, 7]
    with pytest.raises(Exception):  # noqa: B017 - nothing to put in its place: the old table comes back
        put_in_place(spark, str(tmp_path / "none"), path)
    assert ids() == [0, 1, 2, 7]
    (tmp_path / "people.parquet").rename(tmp_path / "people.parquet.old")  # a crash between the renames
    assert restore(spark, path) and not restore(spark, path)
    assert ids() == [0, 1, 2, 7]
    (tmp_path / "people.parquet").rename(tmp_path / "people.parquet.old")
    catalog.write("people", spark.range(1))
    assert ids() == [0] and not (tmp_path / "people.parquet.old").exists()


def test_file_kinds_and_times(spark, tmp_path):
    for name in ("a.JPG", "b.mov", "c.txt", ".hidden.jpg", "sub/d.cr2"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.media_type for r in files.list_media(spark, str(tmp_path), content=True).collect()}
    assert got == {"a.JPG": "image", "b.mov": "video", "d.cr2": "raw"}
    df = spark.createDataFrame([("41 52 48.0 N", "2025:06:01 18:30:00"), ("87 37 48 W", "bad")], "d string, t string")
    rows = df.select(files.dms_degrees("d").alias("d"), files.exif_time("t").alias("t")).collect()
    assert abs(rows[0].d - 41.88) < 1e-9 and rows[0].t == datetime(2025, 6, 1, 18, 30) and rows[1].d < 0 and rows[1].t is None


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n')
    rows = files.read_jsonl(spark, str(tmp_path), "id string, n int").collect()
    assert {(r.id, r._corrupt is not None) for r in rows} == {("a", False), (None, True)}


def test_near_duplicates_need_both_signs(spark):
    near = spark.createDataFrame([(1, 2, 0.97), (2, 3, 0.96), (4, 5, 0.99), (6, 7, 0.5)], "query_id long, id long, score double")
    rows = spark.createDataFrame([(1, 0, 10.0), (2, 1, 20.0), (3, 3, 20.0), (4, None, 1.0), (5, 0, 1.0), (6, 0, 1.0), (7, 0, 1.0)], "id long, h long, area double")
    got = {(r.id, r.group, r["size"], r.is_best) for r in groups.near_duplicates(near, rows, "id", "h", F.col("area")).collect()}
    assert got == {(1, 1, 3, False), (2, 1, 3, True), (3, 1, 3, False)}


def test_stratified_draw_is_stable(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(60)], "id int, s int")
    one, two = ({r.id for r in groups.stratified(df.repartition(n), "s", "id", 4).collect()} for n in (1, 5))
    assert one == two and len(one) == 16


def test_albums_of_a_trip(spark):
    start = datetime(2025, 3, 1, 12)
    home = [(i, "u", start + timedelta(days=i), "Ohio", 1.0) for i in range(9)]
    away = [(20 + i, "u", start + timedelta(days=30, hours=20 * i), "Japan", float(i)) for i in range(3)]
    df = spark.createDataFrame(home + away, "id int, u string, at timestamp_ntz, place string, sharp double")
    got = timeline.albums(df, ["u"], "at", "id", "place", F.col("place") == "Ohio", "sharp", least=3).collect()
    assert [(r.n, r.place, r.cover_id, r.title) for r in got] == [(3, "Japan", 22, "Japan · Mar 2025 – Apr 2025")]


def test_album_intervals(spark):
    from datetime import date

    df = spark.createDataFrame([(datetime(2025, 1, 1), datetime(2025, 1, 5))], "s timestamp_ntz, e timestamp_ntz")
    ask = lambda a, b: df.where(timeline.overlaps(F.col("s"), F.col("e"), a, b)).count()
    assert [ask(date(2025, 1, 5), None), ask(date(2025, 1, 6), None), ask(None, date(2025, 1, 1)), ask(None, date(2024, 12, 31)), ask(None, None)] == [1, 0, 1, 0, 1]


def test_plugin_encodes_pending_rows_only(spark):
    from shoebox.functions import plugins

    rows = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "y")], "id string, t string")
    done = spark.createDataFrame([("a", "m", [1.0])], "photo_id string, model string, embedding array<float>")
    got = plugins.fill_pending(rows, "id", "t", done, "m", lambda: lambda values: [[float(len(v))] for v in values]).collect()
    assert {(r.photo_id, r.model, tuple(r.embedding or ())) for r in got} == {("b", "m", ()), ("c", "m", (1.0,))}


def test_index_batch_clears_what_is_stale(spark):
    from shoebox.streaming.incremental import index_batch

    schema = "path string, file_hash string, mtime double"
    old = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0), ("c", "3", 1.0)], schema)
    new = spark.createDataFrame([("a", "1", 1.0), ("b", "9", 2.0), ("d", "3", 1.0)], schema)
    derived = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    changes, catalogue, left = index_batch(new, old, {"vectors": derived})
    assert {(r.path, r.status) for r in changes.collect()} == {("a", "unchanged"), ("b", "changed"), ("d", "moved")}
    assert {r.path for r in left["vectors"].collect()} == {"a", "c"} and catalogue.count() == 3


def test_synthetic_library(spark):
    from shoebox.sources.synthetic import library

    photos, vectors = library(spark, 200, 16)
    assert photos.count() == 200 and photos.select("place_name").distinct().count() == 5
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in vectors.limit(5).collect())


def one_by_one(wanted, taken):
    """Each name in turn, as an importer that looks at the folder before every file would give it."""
    held, out = dict(taken), []
    for name, content in wanted:
        stem, dot, extension = name.rpartition(".") if "." in name[1:] else (name, "", "")
        number, at = 0, name
        while at in held and not (held[at] is not None and held[at] == content):
            number += 1
            at = f"{stem}-{number}{dot}{extension}"
        held.setdefault(at, content)
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_free_names_are_those_of_one_import_after_another(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["a.jpg", "a-1.jpg", "a-1-1.jpg", "a-2.jpg", "a-2019.jpg", "a", "a-1", "b.tar.gz", "b.tar-1.gz", ".x", ".x-1", "a-1.jpg-2"]
    wanted = [(str(rng.choice(pool)), str(rng.integers(6))) for _ in range(60)]
    taken = list({str(rng.choice(pool)): str(rng.integers(6)) for _ in range(5)}.items())
    w = spark.createDataFrame([(i, *x) for i, x in enumerate(wanted)], "k int, name string, hash string").repartition(4)
    t = spark.createDataFrame(taken, "name string, hash string")
    got = {r.k: r.free_name for r in upkeep.free_names(w, t, "name", [F.col("k")], "hash").collect()}
    assert [got[i] for i in range(60)] == one_by_one(wanted, taken)
    alone = {r.k: r.free_name for r in upkeep.free_names(w, t, "name", [F.col("k")]).collect()}
    assert [alone[i] for i in range(60)] == one_by_one([(n, None) for n, _ in wanted], taken) and len(set(alone.values()) | {n for n, _ in taken}) == 60 + len(taken)


def test_neighbours_of_vectors_of_several_lengths_and_of_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.6, 0.8]), (6, None), (7, []), (8, [float("nan"), 1.0]), (9, [1.0, None]), (10, [float("inf"), 0.0]), (11, [-1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = [(1, 1, 2), (2, 1, 1), (3, 1, 11), (4, 1, 5), (5, 1, 4), (11, 1, 3)]
    assert sorted((r.query_id, r["rank"], r.id) for r in groups.nearest_to_queries(df, df, "id", "v", 3).collect()) == want
    kept, groups.SENT = groups.SENT, 0
    try:
        assert sorted((r.query_id, r["rank"], r.id) for r in groups.nearest_to_queries(df, df, "id", "v", 3, 4, 2).collect()) == want
    finally:
        groups.SENT = kept
    words = df.withColumn("id", F.format_string("v%02d", "id"))
    assert sorted((r.query_id, r.id) for r in groups.nearest_to_queries(words, words, "id", "v", 3).collect()) == [(f"v{a:02d}", f"v{b:02d}") for a, _, b in want]
    assert groups.nearest_to_queries(df.limit(0), df, "id", "v").count() == groups.nearest_to_queries(df, df.limit(0), "id", "v").count() == 0


def test_nearest_passes_on_the_best_some_queries_at_a_time():
    rng = np.random.default_rng(6)
    v, names = np.float32(rng.normal(size=(50, 4))), pa.array([f"v{i}" for i in range(50)])
    parts = list(groups._block_best(names, v, names, v, 3, 500))
    assert len(parts) == 5 and max(p.num_rows for p in parts) <= 10 * 3
    near = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(near, -np.inf)
    assert {(r["query_id"], r["id"]) for p in parts for r in p.to_pylist()} == {(f"v{i}", f"v{j}") for i in range(50) for j in np.argsort(-near[i])[:3]}
    assert [len(t) for t in groups.blocks_of(iter([pa.record_batch({"vector": [[1.0] * 4] * 6})] * 5), 40)] == [12, 12, 6]


def test_components_work_on_ever_fewer_edges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    chain, some = [(i, i + 1) for i in range(400)], [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(300, size=(150, 2))]
    edges = [*chain, *some, (5000, 5000)]
    df, rows = spark.createDataFrame(edges, "a long, b long"), []
    whole = type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a: (rows.append(self.count()), whole(self, *a))[1])
    got = {r.node: r.component for r in groups.components(df).collect()}
    want = {n: n for e in edges for n in e}
    for _ in range(401):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and sum(rows) < 8 * len(edges)


@pytest.mark.parametrize("sent", [pairs.SENT, -1])
def test_alike_texts_shuffle_no_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(pairs, "SENT", sent)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mine = spark.createDataFrame([(1, "a b c d e"), (2, "a b c x y z"), (3, "q r s t"), (4, "s t q r"), (5, ""), (6, None)], "k int, t string")
        found = pairs.alike_texts(mine, "k", "t", spark.createDataFrame([("a b c d",), ("q r s t u v",), ("",)], "u string"), "u", 0.6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (sent > 0)
        assert sorted(r.k for r in found.collect()) == [1, 3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def in_order(v, ids, k):
    """(query, rank, id) of the k nearest by products summed in the order of the components, then by id."""
    x, total = v.astype(float), np.zeros((len(v), len(v)))
    for c in x.T:
        total += c[:, None] * c
    return {(ids[q], n + 1, i) for q in range(len(v)) for n, (_, i) in enumerate(sorted((-total[q, j], ids[j]) for j in range(len(v)) if j != q)[:k])}


@pytest.mark.parametrize("sent", [groups.SENT, 0])
def test_equal_vectors_are_equally_near(spark, monkeypatch, sent):
    rng = np.random.default_rng(11)
    v = np.float32(rng.normal(size=(403, 37)))
    v[20:300] = v[rng.integers(0, 3, 280)]
    ids = [f"v{i:03d}" for i in rng.permutation(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id string, v array<float>").repartition(3)
    monkeypatch.setattr(groups, "SENT", sent)
    got = {(r.query_id, r["rank"], r.id) for r in groups.nearest_to_queries(df, df, "id", "v", 5, 150, 130).collect()}
    assert got == in_order(v, ids, 5)


def test_nearest_of_all_blocks_are_passed_on_once():
    rng = np.random.default_rng(12)
    for scale in (1.0, 1e-21, 1e-30, 1e15, 1e25):
        v, names = np.float32(rng.normal(size=(300, 5)) * scale), pa.array([f"v{i:03d}" for i in rng.permutation(300)])
        v[100:200] = v[7]
        table = pa.table({"id": names, "vector": pa.array(list(v), pa.list_(pa.float32()))})
        blocks = [table.slice(i, 40) for i in range(0, 300, 40)]
        parts = list(groups._best(groups.by_length(table), iter(blocks), 4, 1000))
        assert sum(p.num_rows for p in parts) == 4 * 300
        found = sorted((r["query_id"], -r["score"], r["id"]) for p in parts for r in p.to_pylist())
        assert {(q, n % 4 + 1, i) for n, (q, _, i) in enumerate(found)} == in_order(v, names.to_pylist(), 4)


def test_few_copies_leave_each_query_its_best():
    v = np.float32([[1.0, 2.0]] * 9 + [[0.5, 0.0]])
    ids, have = groups._few_copies(pa.array([5, 1, 1, 1, 2, 3, 4, 6, 7, 8]), v, 2)
    assert ids.to_pylist() == [1, 1, 2, 3, 8] and have.tolist() == [[1.0, 2.0]] * 4 + [[0.5, 0.0]]


def test_rows_without_an_id_are_no_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (None, [1.0, 0.0])], "id long, v array<float>")
    assert sorted((r.query_id, r.id) for r in groups.nearest_to_queries(df, df, "id", "v", 3).collect()) == [(1, 2), (2, 1)]
