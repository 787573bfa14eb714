"""Reverse geocoding against brute force: dense cities, the date line, the poles, and rows without a position."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import geo
from shoebox.operators.geo import reverse_geocode

PLACE = "name string, admin1 string, country string, lat double, lon double, population double"
POINT = "id int, lat double, lon double"


def km(a, b):
    (p, q), (r, s) = ((math.radians(x) for x in t) for t in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def expected(point, places, nearest):
    if point[1] is None or not math.isfinite(point[1]):
        return None
    hits = sorted((km(point[1:], p[3:5]), p[0], 1000.0 if p[5] is None else p[5]) for p in places if p[3] is not None)[:nearest]
    hits = [h for h in hits if h[0] <= 150]
    if not hits:
        return None
    _, name, people = hits[0]
    cities = [h for h in hits if h[0] <= 1.5 + 3.5 * math.log10(max(h[2], 1000) / 1000)]
    cities = [h for h in cities if (people < 25_000 and h[2] >= 20 * max(people, 1000)) or (name.startswith(h[1] + " ") and h[2] > people)]
    return max(cities, key=lambda h: (h[2], -h[0]), default=hits[0])[1]


def world(seed, n_towns, n_points):
    """A dense city with half of all points and places, others anywhere, and some at the date line and the poles."""
    rng = np.random.default_rng(seed)
    city = lambda n: np.column_stack([48.8 + rng.normal(0, 0.1, n), 2.3 + rng.normal(0, 0.15, n)])
    anywhere = lambda n: np.column_stack([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)])
    line = lambda n: np.column_stack([rng.uniform(-20, -10, n), (rng.uniform(179, 181, n) + 180) % 360 - 180])
    pole = lambda n: np.column_stack([rng.choice([-1, 1], n) * rng.uniform(88.5, 90, n), rng.uniform(-180, 180, n)])
    some = lambda n: np.concatenate([city(n // 2), anywhere(n // 6), line(n // 6), pole(n // 6)]).tolist()
    towns = [(f"Big {i}" if i % 3 else f"Big {i - i % 30} {i}", "a", "c", lat, lon, float(10 ** rng.uniform(2, 6.5)) if i % 7 else None) for i, (lat, lon) in enumerate(some(n_towns))]
    return towns, [(i, lat, lon) for i, (lat, lon) in enumerate(some(n_points))]


@pytest.mark.parametrize("nearest", [50, 5])
def test_geocoder_equals_brute_force(spark, nearest):
    towns, points = world(nearest, 900, 600)
    towns += [("Nowhere", None, None, None, None, 1e6), ("At the pole", None, None, 90.0, 0.0, 1e3)]
    points += [(9000, None, None), (9001, float("nan"), 1.0), (9002, 1.0, None), (9003, 90.0, 77.0), (9004, *points[0][1:]), (9005, -16.0, 180.0), (9006, -16.0, -180.0)]
    got = reverse_geocode(spark.createDataFrame(points, POINT), spark.createDataFrame(towns, PLACE), nearest=nearest).collect()
    assert {r.id: r.place_name for r in got} == {p[0]: None if p[2] is None else expected(p, towns, nearest) for p in points}
    assert len(got) == len(points) and all((r.distance_km is None) == (r.place_name is None) for r in got)


def test_geocoder_of_empty_tables_and_repeated_places(spark):
    towns, points = spark.createDataFrame([("B", "x", "y", 1.0, 1.0, 5e3), ("A", "x", "y", 1.0, 1.0, 5e3)] * 60, PLACE), spark.createDataFrame([(1, 1.001, 1.0), (1, 1.001, 1.0)], POINT)
    assert [r.place_name for r in reverse_geocode(points, towns).collect()] == ["A", "A"]
    assert reverse_geocode(points.limit(0), towns).collect() == []
    assert [r.place_name for r in reverse_geocode(points, towns.limit(0)).collect()] == [None, None]


def test_a_district_gives_way_only_to_a_bigger_city_of_its_name(spark):
    towns = [("Lyon", "r", "f", 45.76, 4.835, 5e5), ("Lyon 03", "r", "f", 45.75, 4.85, 1e5), ("Ys", "r", "f", 10.0, 10.0, 30_000.0), ("Ys Port", "r", "f", 10.01, 10.0, 40_000.0), ("Hut", "r", "f", 20.0, 20.0, 10.0), ("Town", "r", "f", 20.01, 20.0, 15_000.0)]
    points = [(1, 45.75, 4.851), (2, 10.0101, 10.0), (3, 20.0, 20.0)]
    got = reverse_geocode(spark.createDataFrame(points, POINT), spark.createDataFrame(towns, PLACE))
    # the port is larger than its namesake; a hut of 10 counts as 1000, so a town of 15,000 isn't 20 times as large
    assert {r.id: r.place_name for r in got.collect()} == {1: "Lyon", 2: "Ys Port", 3: "Hut"}


def test_points_that_see_a_dense_city_from_far_get_short_lists(spark):
    rng = np.random.default_rng(4)
    towns = [(f"T {i}", None, None, *p, 1e3) for i, p in enumerate(np.column_stack([rng.uniform(40, 40.6, 4000), rng.uniform(9, 9.6, 4000)]).tolist())]
    points = [(i, *p) for i, p in enumerate(np.column_stack([rng.uniform(39, 41.6, 150), rng.uniform(7.5, 11, 150)]).tolist())]
    df, places = spark.createDataFrame(points, POINT), spark.createDataFrame(towns, PLACE)
    on = [df.select(*geo._on_sphere(F.col("lat"), F.col("lon"))).select(geo._cell(geo.LEVELS).alias("spot")), places.select(F.col("name").alias("place"), *geo._on_sphere(F.col("lat"), F.col("lon"))).select("place", geo._cell(geo.LEVELS).alias("cell"))]
    sizes = [r.n for r in geo.place_lists(*on).select(F.size("places").alias("n")).collect()]
    assert 0 < max(sizes) <= geo.SHORT * geo.NEAREST < len(towns)
    assert {r.id: r.place_name for r in reverse_geocode(df, places).collect()} == {p[0]: expected(p, towns, 50) for p in points}
