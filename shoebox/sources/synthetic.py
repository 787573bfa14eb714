"""A synthetic library for load tests, made by Spark at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places with their positions, and cameras.
PLACES = (("Lisbon", "Portugal", 38.72, -9.14), ("Nairobi", "Kenya", -1.29, 36.82), ("Ghent", "Belgium", 51.05, 3.72), ("Hobart", "Australia", -42.88, 147.33), ("Quito", "Ecuador", -0.18, -78.47))
CAMERAS = ("Pentax K-3", "Olympus E-M1", "Leica Q2", "Ricoh GR III")


def library(spark: SparkSession, n: int, dim: int = 512, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(photos, embeddings): n rows over ten years, five places and four cameras; vectors of length one."""
    ids = spark.range(n).select(F.col("id").cast("string").alias("id"), F.rand(seed).alias("r"), F.rand(seed + 1).alias("s"), F.rand(seed + 2).alias("t"))
    place = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(p, ("place_name", "country", "lat", "lon"))]) for p in PLACES]), F.floor(F.col("r") * len(PLACES)).cast("int") + 1)
    camera = F.element_at(F.array(*[F.lit(c) for c in CAMERAS]), F.floor(F.col("s") * len(CAMERAS)).cast("int") + 1)
    taken = F.timestamp_seconds(F.lit(1420070400) + F.floor(F.col("t") * 10 * 365 * 86400)).cast("timestamp_ntz")
    photos = ids.select("id", place.alias("p"), camera.alias("camera"), taken.alias("taken_at")).select("id", "p.*", "camera", "taken_at")
    parts = F.array(*[F.randn(seed + 10 + i) for i in range(dim)])
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    vectors = spark.range(n).select(F.col("id").cast("string").alias("photo_id"), parts.alias("v")).select("photo_id", F.lit("synthetic").alias("model"), F.transform("v", lambda x: (x / length).cast("float")).alias("embedding"))
    return photos, vectors
