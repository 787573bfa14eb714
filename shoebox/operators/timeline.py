"""Segmentation of time-ordered rows: bursts, sessions, trips, homes and album titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.vector import dot
from shoebox.operators.aggregate import best_id


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds from one timestamp to another, with fractions."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / 1e6


#: Rows of a time line that one task sorts, beyond which time lines are cut into slots of so many seconds and spread over tasks.
CROWDED, SLOT = 2_000_000, 28 * 86_400


def chains(rows: DataFrame, partition: list[str], at: str, tie: list[str], carried: list[str], joined: Callable[[Column], Column], name: str, slot_s: int = SLOT, crowded: int = CROWDED) -> DataFrame:
    """Number the chains of each partition (null being a value), in the order of `at` and `tie`.

    `joined` says, in terms of the `carried` columns and given a struct of those of the row before, whether a row goes on
    with its chain. A row without a time begins a chain. Rows are counted first: where no partition has more than `crowded`,
    one window does. Otherwise windows run inside slots of time, and what crosses their borders is a row for each slot,
    with its first and last rows and the number of chains that begin after the first. Either way gives the same numbers.
    """
    inside, order, kept = Window.partitionBy(*partition).orderBy(at, *tie), F.struct(at, *tie), F.struct(*carried)

    def begins(before: Column) -> Column:
        return F.coalesce(~joined(before), F.lit(True)).cast("int")

    if crowded and rows.groupBy(*partition).agg(F.count("*").alias("chain_n")).where(F.col("chain_n") > crowded).isEmpty():
        # before the first row is null, so that row begins a chain
        met = rows.withColumn("chain_before", F.lag(kept).over(inside)).withColumn("chain_break", begins(F.col("chain_before")))
        return met.select(*rows.columns, F.sum("chain_break").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(name))

    keyed = rows.withColumn("chain_key", F.struct(*partition, F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (slot_s * 1_000_000)).alias("chain_slot")))
    inside = Window.partitionBy("chain_key").orderBy(at, *tie)
    met = keyed.withColumn("chain_before", F.lag(kept).over(inside))
    met = met.withColumn("chain_break", F.when(F.col("chain_before").isNull(), 0).otherwise(begins(F.col("chain_before"))))
    met = met.withColumn("chain_n", F.sum("chain_break").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    slots = met.groupBy("chain_key").agg(F.min_by(kept, order).alias("chain_first"), F.max_by(kept, order).alias("chain_last"), F.max("chain_n").alias("chain_inner"))
    by_slot = Window.partitionBy(*[F.col("chain_key")[c] for c in partition]).orderBy(F.col("chain_key")["chain_slot"])
    slots = slots.select("chain_key", "chain_inner", "chain_first.*", F.lag("chain_last").over(by_slot).alias("chain_before"))
    slots = slots.select("chain_key", "chain_inner", begins(F.col("chain_before")).alias("chain_break"))
    until = F.sum(F.col("chain_inner") + F.col("chain_break")).over(by_slot.rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.select("chain_key", (until - F.col("chain_inner")).alias("chain_base"))
    return met.join(slots, "chain_key").select(*rows.columns, (F.col("chain_base") + F.col("chain_n")).alias(name))


def gap_segments(rows: DataFrame, partition: list[str], at: str, id_col: str, gap_s: float, name: str = "segment", alike: tuple[str, float] | None = None) -> DataFrame:
    """Rows with the number of their segment: a gap of more than `gap_s` since the row before begins a new one, and with
    `alike`, a vector and the least product, a row before that is less alike. Equal gaps keep together."""

    def joined(before: Column) -> Column:
        near = seconds_between(F.col(at), before[at]) <= gap_s
        return near & (dot(alike[0], before[alike[0]]) >= alike[1]) if alike else near

    return chains(rows, partition, at, [id_col], [at, *([alike[0]] if alike else [])], joined, name)


def bursts(rows: DataFrame, camera: str, at: str, id_col: str, sharpness: str, gap_s: float = 2.0, least: int = 2, alike: tuple[str, float] | None = None) -> DataFrame:
    """(camera, burst, size, best_id, started): runs of rows of one camera, null being one too, at most gap_s apart and,
    if `alike` names a vector and a product, each as much like the one before."""
    grouped = gap_segments(rows, [camera], at, id_col, gap_s, "burst", alike).groupBy(camera, "burst")
    best = best_id(id_col, F.coalesce(sharpness, F.lit(0.0)))
    return grouped.agg(F.count("*").alias("size"), best.alias("best_id"), F.min(at).alias("started")).where(F.col("size") >= least)


def mode(rows: DataFrame, group: list[str], value: str, first_seen: str) -> DataFrame:
    """The commonest value of each group; of equally common ones the first seen."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"), F.min(first_seen).alias("seen"))
    key = F.struct(F.col("n"), -F.unix_micros(F.col("seen").cast("timestamp")), F.col(value))
    return counted.groupBy(*group).agg(F.max_by(value, key).alias(value), F.max("n").alias("n"))


def trips(segments: DataFrame, partition: list[str], start: str, end: str, away: Column, gap_s: float = 48 * 3600, name: str = "trip") -> DataFrame:
    """Segments with the number of their trip: consecutive segments away from home, at most gap_s apart, are one."""
    flagged = segments.withColumn("is_away", F.coalesce(away, F.lit(False)))

    def joined(before: Column) -> Column:
        return F.col("is_away") & before["is_away"] & (seconds_between(F.col(start), before[end]) <= gap_s)

    return chains(flagged, partition, start, [end], ["is_away", start, end], joined, name, 12 * SLOT).drop("is_away")


def title(place: Column, start: Column, end: Column) -> Column:
    """"Place · Jun 1, 2025", "Place · Jun 1–3, 2025" or "Place · Jun 2025 – Jul 2025"."""
    same_day = F.to_date(start) == F.to_date(end)
    same_month = F.date_format(start, "yyyy-MM") == F.date_format(end, "yyyy-MM")
    day, days = F.date_format(start, "MMM d, yyyy"), F.concat(F.date_format(start, "MMM d"), F.lit("–"), F.date_format(end, "d, yyyy"))
    months = F.concat(F.date_format(start, "MMM yyyy"), F.lit(" – "), F.date_format(end, "MMM yyyy"))
    return F.concat(F.coalesce(place, F.lit("Photos")), F.lit(" · "), F.when(same_day, day).when(same_month, days).otherwise(months))


def albums(rows: DataFrame, partition: list[str], at: str, id_col: str, region: str, home: Column, sharpness: str, gap_s: float = 8 * 3600, trip_gap_s: float = 48 * 3600, least: int = 15, position: tuple[str, ...] = ()) -> DataFrame:
    """Albums of a time line: sessions, merged to trips where their region is away from home, of `least` rows or more.

    (partition, trip, started, ended, n, region, cover_id, title): the commonest region (the first seen of equals) and
    the sharpest row; with `position` also the mean of those columns as centroid_*. A session without a region is not away.
    """
    sessions = gap_segments(rows.where(F.col(at).isNotNull()), partition, at, id_col, gap_s)
    spans = sessions.groupBy(*partition, "segment").agg(F.min(at).alias("started"), F.max(at).alias("ended"))
    where = mode(sessions.select(*partition, "segment", region, at), [*partition, "segment"], region, at).drop("n")
    numbered = trips(spans.join(where, [*partition, "segment"], "left"), partition, "started", "ended", ~home & F.col(region).isNotNull(), trip_gap_s)
    placed = sessions.join(numbered.select(*partition, "segment", "trip"), [*partition, "segment"])
    cover = best_id(id_col, F.coalesce(sharpness, F.lit(0.0)))
    middle = [F.avg(c).alias(f"centroid_{c}") for c in position]  # nulls don't count
    found = placed.groupBy(*partition, "trip").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"), cover.alias("cover_id"), *middle).where(F.col("n") >= least)
    named = mode(placed.select(*partition, "trip", region, at), [*partition, "trip"], region, at).drop("n")
    out = found.join(named, [*partition, "trip"], "left")
    return out.withColumn("title", title(F.col(region), F.col("started"), F.col("ended")))


def overlaps(start: Column, end: Column, low, high) -> Column:
    """An interval that reaches into the days from `low` through `high`, each where given."""
    from datetime import timedelta

    out = F.lit(True)
    if low is not None:
        out = out & (end >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        out = out & (start < F.lit(high + timedelta(days=1)).cast("timestamp_ntz"))
    return out
