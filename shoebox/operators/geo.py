"""Reverse geocoding: the nearest place of a gazetteer, with suburbs absorbed by their city."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.session import ensure_checkpoint_dir

#: The earth's radius and how far a place may lie, in km; what makes a place small, and a city large; the
#: least population counted, which is also that of a place without one; and how many of the nearest places are looked at.
EARTH_KM, FARTHEST_KM, SMALL, LARGER, LEAST, NEAREST = 6371.0088, 150.0, 25_000, 20, 1000.0, 50

#: The side of the largest cells, the chord of FARTHEST_KM on a sphere of radius 1; how often cells are halved at most;
#: and how many times the places that count a list may hold before its part is halved.
SIDE, LEVELS, SHORT = 2 * math.sin(FARTHEST_KM / EARTH_KM / 2) * 1.000001, 12, 8


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def city_radius_km(population: Column) -> Column:
    return 1.5 + 3.5 * F.log10(F.greatest(population, F.lit(LEAST)) / LEAST)


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Coordinates in space, so that neither the date line nor the poles are borders."""
    lat, lon = F.radians(lat), F.radians(lon)
    return [(F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")]


def _cell(levels: int) -> Column:
    """The smallest cell that holds (x, y, z)."""
    return F.struct(*[F.floor((F.col(c) + 1) / (SIDE / 2**levels)).cast("int").alias(c) for c in "xyz"])


def _above(cell: str, halvings: int) -> Column:
    """The cell so many halvings larger that holds a cell."""
    return F.struct(*[F.shiftright(F.col(cell)[c], halvings).alias(c) for c in "xyz"])


def _located(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("lat").between(-90, 90) & (F.abs("lon") < F.lit(float("inf"))))


def _needed(met: DataFrame, level: int, nearest: int) -> DataFrame:
    """Of (part, cell, n) the cells of a part that may hold one of the `nearest` places of a point in it, and in `total`
    the places of all of them. Lengths are counted in sides of the level's cells, so their squares are whole numbers."""
    apart = [F.abs(F.col("part")[c] - F.col("cell")[c]).cast("long") for c in "xyz"]
    least, most = (sum((x * x for x in side), F.lit(0)) for side in ([F.greatest(d - 1, F.lit(0)) for d in apart], [d + 1 for d in apart]))
    met = met.select("part", "cell", "n", least.alias("least"), most.alias("most")).where(F.col("least") <= 4**level)
    own = Window.partitionBy("part")
    # so many places lie no farther than `enough` from any point of the part
    met = met.withColumn("held", F.sum("n").over(own.orderBy("most"))).withColumn("enough", F.min(F.when(F.col("held") >= nearest, F.col("most"))).over(own))
    met = met.where(F.col("enough").isNull() | (F.col("least") <= F.col("enough")))
    return met.select("part", "cell", F.sum("n").over(own).alias("total"))


def place_lists(spots: DataFrame, towns: DataFrame, levels: int = LEVELS, nearest: int = NEAREST) -> DataFrame:
    """(level, part, places): for parts that hold every one of `spots` (spot) once, the `towns` (cell, place) that can be
    among the `nearest` of a point there. Spots and cells are smallest ones (`_cell`).

    Parts and the cells around them are halved together, from the largest on, for as long as the cells that a part
    needs hold more than SHORT * nearest places. A part meets counts of cells, not places, and how many cells it needs
    depends on the geometry alone, also where it looks at a dense city from far away. Only places on (nearly) one spot
    make a longer list, which is whole. Each round is a checkpoint.
    """
    ensure_checkpoint_dir(spots.sparkSession)
    spots, counts = spots.distinct().checkpoint(), towns.groupBy("cell").agg(F.count("*").alias("n")).checkpoint()

    def cells(level: int) -> DataFrame:
        return counts.groupBy(_above("cell", levels - level).alias("cell")).agg(F.sum("n").alias("n"))

    met = spots.select(_above("spot", levels).alias("part")).distinct().select("part", *[F.col("part")[c].alias(c) for c in "xyz"])
    for c in "xyz":
        met = met.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    met, done = met.select("part", F.struct(*"xyz").alias("cell")).join(cells(0), "cell"), []
    for level in range(levels + 1):
        met = _needed(met, level, nearest).checkpoint()
        long = met.where((F.col("total") > SHORT * nearest) & F.lit(level < levels)).select("part", "cell")
        done.append(met.where((F.col("total") <= SHORT * nearest) | F.lit(level == levels)).select(F.lit(level).alias("level"), "part", "cell"))
        if long.isEmpty():
            break
        halves = spots.select(_above("spot", levels - level).alias("part"), _above("spot", levels - level - 1).alias("half"))
        halves = halves.join(long.select("part").distinct(), "part").distinct()
        smaller = cells(level + 1).select(_above("cell", 1).alias("of"), F.col("cell").alias("smaller"), "n")
        met = halves.join(long, "part").join(smaller, F.col("cell") == F.col("of")).select(F.col("half").alias("part"), F.col("smaller").alias("cell"), "n")
    held = towns.select("place", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), _above("cell", levels - n).alias("cell")) for n in range(len(done))])).alias("at"))
    found = reduce(DataFrame.unionByName, done).join(held.select("place", "at.level", "at.cell"), ["level", "cell"])
    return found.groupBy("level", "part").agg(F.collect_list("place").alias("places"))


def reverse_geocode(points: DataFrame, places: DataFrame, levels: int = LEVELS, nearest: int = NEAREST) -> DataFrame:
    """`points` (with lat, lon) with place_name, admin1, country and distance_km of their place, or nulls.

    Cells are cubes around the sphere. `place_lists` gives each part of it that has points a short list of places: the
    smaller a part, the denser places lie in sight of it. Points meet the lists by one equi-join, never each other: a
    city with half of all points has many parts, and adaptive execution splits one with very many points.

    Of the `nearest` places within FARTHEST_KM the first wins, of equally near ones the first by name. If it is small, or
    named "City District", it gives way to the most populous one LARGER times as big, or of that name and bigger, whose
    radius holds the point. Points and places without a finite position take no part (their place is null).
    """
    # a position is looked up once; a number of partitions of its own, as the work is more than its bytes tell
    where = _located(points.select("lat", "lon")).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lat", "lon").distinct()
    towns = _located(places).select(
        F.struct(F.col("name").alias("place_name"), "admin1", "country", F.coalesce(F.col("population").cast("double"), F.lit(LEAST)).alias("population"), "lat", "lon", *_on_sphere(F.col("lat"), F.col("lon"))).alias("place")
    )
    towns = towns.select("place", "place.x", "place.y", "place.z").select("place", _cell(levels).alias("cell"))
    asked = where.select("lat", "lon", *_on_sphere(F.col("lat"), F.col("lon"))).select("lat", "lon", *"xyz", _cell(levels).alias("spot"))
    near = place_lists(asked.select("spot"), towns, levels, nearest)

    def chord(p: Column) -> Column:
        return sum(((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in "xyz"), F.lit(0.0))

    parts = F.array(*[F.struct(F.lit(n).alias("level"), _above("spot", levels - n).alias("part")) for n in range(levels + 1)])
    met = asked.select("lat", "lon", *"xyz", F.explode(parts).alias("at")).select("lat", "lon", *"xyz", "at.level", "at.part").join(near, ["level", "part"])
    met = met.select("lat", "lon", F.slice(F.sort_array(F.transform("places", lambda p: F.struct(chord(p).alias("chord"), p.alias("place")))), 1, nearest).alias("hits"))

    def measured(h: Column) -> Column:
        p = h["place"]
        return F.struct(great_circle_km(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("km"), p["place_name"].alias("place_name"), p["admin1"].alias("admin1"), p["country"].alias("country"), p["population"].alias("population"))

    hits = met.select("lat", "lon", F.array_sort(F.filter(F.transform("hits", measured), lambda h: h["km"] <= FARTHEST_KM)).alias("hits"))
    hits = hits.select("lat", "lon", "hits", F.get("hits", F.lit(0)).alias("near"))
    population = F.col("near.population")

    def gives_way(h: Column) -> Column:
        larger = (population < SMALL) & (h["population"] >= LARGER * F.greatest(population, F.lit(LEAST)))
        district = F.col("near.place_name").startswith(F.concat(h["place_name"], F.lit(" "))) & (h["population"] > population)
        return (h["km"] <= city_radius_km(h["population"])) & (larger | district)

    cities = F.transform(F.filter("hits", gives_way), lambda h: F.struct(h["population"].alias("population"), (-h["km"]).alias("closeness"), h.alias("place")))
    found = hits.select("lat", "lon", F.coalesce(F.array_max(cities)["place"], "near").alias("geo_place"))
    named = [F.col(f"geo_place.{a}").alias(b) for a, b in (("place_name", "place_name"), ("admin1", "admin1"), ("country", "country"), ("km", "distance_km"))]
    return points.join(found, ["lat", "lon"], "left").select(*points.columns, *named)
