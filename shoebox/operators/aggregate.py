"""Whitelisted aggregates over a collection, and the listings that go with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dimension(name: str, taken_at: str = "taken_at") -> Column:
    """A grouping expression by name; anything else is refused."""
    known = {
        "city": F.col("place_name"), "region": F.col("admin1"), "country": F.col("country"), "camera": F.col("camera"), "lens": F.col("lens"),
        "year": F.year(taken_at).cast("string"), "month": F.date_format(taken_at, "yyyy-MM"), "weekday": F.date_format(taken_at, "EEEE"), "hour": F.hour(taken_at).cast("string"),
        "focal_length": F.bround("focal_length", 0).cast("int").cast("string"), "aperture": F.col("aperture").cast("string"),
    }
    if name not in known:
        raise ValueError(f"no such dimension: {name}")
    return known[name]


def best_id(id_col: str, *scores: Column | str) -> Column:
    """An aggregate: the id of the highest scores, null being the lowest; of equals the least id, of whatever type."""
    keys = [F.col(s) if isinstance(s, str) else s for s in scores]
    order = [k for s in keys for k in (s.isNull(), -s)]
    return F.min_by(id_col, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)], F.col(id_col).alias("id")))


def group_counts(rows: DataFrame, group: Column, top_n: int = 50, best: tuple[str, str] | None = None) -> DataFrame:
    """(value, n) of the most frequent groups, null left out, largest first and then by value.

    best = (id, score) adds best_id: the id of the highest score, then the smallest id; rows without a score come last.
    """
    aggs = [F.count("*").alias("n")]
    if best:
        aggs.append(best_id(*best).alias("best_id"))
    counted = rows.groupBy(group.alias("value")).agg(*aggs).where(F.col("value").isNotNull())
    return counted.orderBy(F.desc("n"), "value").limit(min(top_n, 50))


def name_sets(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(names, n): how many keys have just this set of names."""
    sets = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"))
    return sets.groupBy("names").agg(F.count("*").alias("n"))


def first_last(rows: DataFrame, group: str, at: str, id_col: str) -> DataFrame:
    """First and last id by time for each group; n counts rows without a time too."""
    timed = F.col(at).isNotNull()
    return rows.groupBy(group).agg(
        F.min_by(id_col, F.when(timed, F.struct(at, id_col))).alias("first_id"), F.max_by(id_col, F.when(timed, F.struct(at, id_col))).alias("last_id"),
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"),
    )


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def newest_of_best(rows: DataFrame, relevance: list[Column], at: list[Column], n: int) -> DataFrame:
    """The n most relevant rows, then in time order."""
    return rows.orderBy(*relevance).limit(n).orderBy(*at)


def vocabulary(columns: list[tuple[DataFrame, str]], top_n: int) -> DataFrame:
    """Values of several columns with their counts summed, the most frequent first."""
    parts = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")) for df, c in columns]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(top_n)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for each table; every count is a job of its own scan."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, df in tables.items()])


def top_groups(rows: DataFrame, group: str, member: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the largest groups joined to their members: (group, size, member)."""
    largest = rows.groupBy(group).agg(F.count("*").alias("size")).orderBy(F.desc("size"), group).offset(offset).limit(limit)
    return rows.join(F.broadcast(largest), group).select(group, "size", member)  # `limit` rows


def top_members(rows: DataFrame, group: str, member: str, score: str, n: int) -> DataFrame:
    """(group, members, total): the n best members of each group, as an array. Numbering stops at n within each task."""
    w = Window.partitionBy(group).orderBy(F.desc(score), member)
    best = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    best = best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", member))), lambda s: s[member]).alias("members"))
    return best.join(rows.groupBy(group).agg(F.count("*").alias("total")), group)


def count_members(groups: DataFrame, members: DataFrame, on: str, member: str) -> DataFrame:
    """Members counted before they are joined, so that groups without any stay with 0."""
    counted = members.groupBy(on).agg(F.count(member).alias("n"))
    return groups.join(counted, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def people_list(people: DataFrame, faces: DataFrame, hidden: bool = False, samples: int = 6) -> DataFrame:
    """People with faces: (cluster_id, name, n_faces, n_photos, sample_faces), named ones first, then by number of faces
    and by cluster. Faces are counted before people join; the best `samples` of each are numbered within tasks first."""
    place = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("det_score"), "id")
    best = faces.select("cluster_id", "id", "det_score").withColumn("place", F.row_number().over(place)).where(F.col("place") <= samples)
    best = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("sample_faces"))
    counted = faces.groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.count_distinct("photo_id").alias("n_photos"))
    shown = people if hidden else people.where(~F.coalesce("hidden", F.lit(False)))
    rows = shown.select("cluster_id", "name").join(counted, "cluster_id").join(best, "cluster_id")
    return rows.orderBy(F.col("name").isNull(), F.desc("n_faces"), "cluster_id")


def range_newest(rows: DataFrame, at: str, id_col: str, inside: Column, n: int) -> DataFrame:
    """The n newest rows of a range and, on each, the total of the range: counted beside, not by collecting it."""
    held = rows.where(inside)
    total = held.agg(F.count("*").alias("total"))
    return held.orderBy(F.desc_nulls_last(at), id_col).limit(n).crossJoin(F.broadcast(total))  # one row


def one(rows: DataFrame):
    """The single row of a lookup by key; LookupError if there is none."""
    row = rows.first()
    if row is None:
        raise LookupError("no such row")
    return row
