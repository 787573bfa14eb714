"""Keeping tables up to date: listing differences, upserts, cascades, ledgers, path rewrites."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, file_hash, status, old_path) from two listings (path, file_hash, mtime).

    unchanged; touched: only the time differs; changed: the content differs; moved: a new path whose content is that
    of a path now missing (each missing path is used once, in path order); new; deleted. Without a hash nothing is moved.
    """
    old = before.select("path", F.col("file_hash").alias("old_hash"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("was"))
    new = after.select("path", "file_hash", "mtime", F.lit(True).alias("is"))
    both = old.join(new, "path", "full_outer")
    known = both.where(F.col("was") & F.col("is")).select(
        "path", "file_hash", F.when(~F.col("old_hash").eqNullSafe(F.col("file_hash")), "changed").when(F.col("old_mtime").eqNullSafe(F.col("mtime")), "unchanged").otherwise("touched").alias("status"), F.lit(None).cast("string").alias("old_path")
    )
    w = Window.partitionBy("file_hash").orderBy("path")
    gone = both.where(F.col("is").isNull() & F.col("old_hash").isNotNull()).select("path", F.col("old_hash").alias("file_hash")).withColumn("turn", F.row_number().over(w))
    come = both.where(F.col("was").isNull() & F.col("file_hash").isNotNull()).select("path", "file_hash").withColumn("turn", F.row_number().over(w))
    met = come.withColumnRenamed("path", "new_path").join(gone.withColumnRenamed("path", "old_path"), ["file_hash", "turn"], "full_outer")
    moved = met.select(
        F.coalesce("new_path", "old_path").alias("path"), "file_hash",
        F.when(F.col("new_path").isNull(), "deleted").when(F.col("old_path").isNull(), "new").otherwise("moved").alias("status"),
        F.when(F.col("new_path").isNotNull(), F.col("old_path")).alias("old_path"),
    )
    # however many rows have no hash, they stay where the first join put them
    lone = both.where((F.col("was").isNull() & F.col("file_hash").isNull()) | (F.col("is").isNull() & F.col("old_hash").isNull()))
    lone = lone.select("path", F.lit(None).cast(moved.schema["file_hash"].dataType).alias("file_hash"), F.when(F.col("was").isNull(), "new").otherwise("deleted").alias("status"), F.lit(None).cast("string").alias("old_path"))
    return known.unionByName(moved).unionByName(lone)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column], keep_first: bool = False) -> DataFrame:
    """`existing` with the latest incoming row of each key in place of its own; keep_first leaves known keys alone.

    The incoming side is reduced to a row for each key before it meets the table.
    """
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    new = incoming.withColumn("upsert_turn", best).where("upsert_turn = 1").drop("upsert_turn")
    if keep_first:
        return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def pending(rows: DataFrame, key: str, derived: list[DataFrame]) -> DataFrame:
    """Keys that lack a row in any of the derived tables, each once."""
    out = None
    for table in derived:
        lacking = rows.select(key).join(table.select(key), key, "left_anti")
        out = lacking if out is None else out.unionByName(lacking)
    return out.distinct()


def invalidate(derived: dict[str, DataFrame], key: str, changed: DataFrame) -> dict[str, DataFrame]:
    """Derived tables without the rows of changed or removed keys."""
    return {name: df.join(changed.select(key), key, "left_anti") for name, df in derived.items()}


def with_children(removed: DataFrame, rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Removed keys and those of the rows that have them as parent."""
    children = rows.join(removed.select(F.col(key).alias(parent)), parent, "left_semi").select(key)
    return removed.select(key).unionByName(children).distinct()


def import_new(incoming: DataFrame, ledger: DataFrame, order: list[Column]) -> DataFrame:
    """Incoming files with a status: the first of each content not in the ledger is imported, its copies are
    duplicates, and contents the ledger holds as imported are already_seen. Contents with an error are tried again. A
    file without a hash is a content of its own."""
    seen = ledger.where("status <> 'error'").select("file_hash").distinct().withColumn("is_seen", F.lit(True))
    turn = F.row_number().over(Window.partitionBy("file_hash", F.when(F.col("file_hash").isNull(), F.xxhash64(*order))).orderBy(*order))
    return incoming.withColumn("turn", turn).join(seen, "file_hash", "left").withColumn("status", F.when(F.col("is_seen"), "already_seen").when((F.col("turn") == 1) | F.col("file_hash").isNull(), "imported").otherwise("duplicate")).drop("turn", "is_seen")


def relink(rows: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """Paths at or below `old` now lie below `new`."""
    old, new = old.rstrip("/"), new.rstrip("/")
    below = (F.col(path) == old) | F.col(path).startswith(old + "/")
    return rows.withColumn(path, F.when(below, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(F.col(path)))


def assign_faces(faces: DataFrame, face_ids: list[str], cluster: int) -> DataFrame:
    """Faces put into a cluster by hand; that keeps them there."""
    chosen = F.col("id").isin(face_ids)
    return faces.withColumn("cluster_id", F.when(chosen, F.lit(cluster)).otherwise(F.col("cluster_id"))).withColumn("manual", chosen | F.col("manual"))


def merge_people(people: DataFrame, faces: DataFrame, target: int, sources: list[int]) -> tuple[DataFrame, DataFrame]:
    """Source clusters join the target, which keeps its name, or else takes the first named source's, and all aliases."""
    involved = people.where(F.col("cluster_id").isin([target, *sources]))
    rank = F.array_position(F.array(*[F.lit(c) for c in [target, *sources]]), F.col("cluster_id"))
    merged = involved.agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), rank)).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.bool_and("hidden").alias("hidden")
    ).withColumn("cluster_id", F.lit(target))
    rest = people.where(~F.col("cluster_id").isin([target, *sources]))
    moved = F.col("cluster_id").isin(sources)
    return rest.unionByName(merged.select(*people.columns)), faces.withColumn("manual", F.col("manual") | F.coalesce(moved, F.lit(False))).withColumn("cluster_id", F.when(moved, F.lit(target)).otherwise(F.col("cluster_id")))


def without_orphans(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People with a name, and clusters that still have faces."""
    return people.where("name is not null").unionByName(people.where("name is null").join(faces.select("cluster_id"), "cluster_id", "left_semi"))


def split_person(people: DataFrame, faces: DataFrame, face_ids: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """The given faces get a new cluster, above all that either table has, and stay in it; its number comes back too."""
    most = faces.select("cluster_id").unionByName(people.select("cluster_id")).agg(F.coalesce(F.max("cluster_id"), F.lit(-1))).first()[0]
    row = faces.sparkSession.createDataFrame([(most + 1,)], "n int").select(*[F.col("n").cast(f.dataType).alias(f.name) if f.name == "cluster_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in people.schema])
    row = row.select(*[F.array().cast(people.schema[c].dataType).alias(c) if c == "aliases" else F.lit(False).alias(c) if c == "hidden" else F.col(c) for c in people.columns])
    return people.unionByName(row), assign_faces(faces, face_ids, most + 1), most + 1


def name_person(people: DataFrame, cluster: int, name: str | None, aliases: list[str] | None = None, hidden: bool | None = None) -> DataFrame:
    """A cluster's name, and its aliases and whether it is hidden where they are given; others are left alone."""
    own = F.col("cluster_id") == cluster
    new = {"name": F.lit(name or None).cast("string"), **({"aliases": F.array(*[F.lit(a) for a in aliases]).cast("array<string>")} if aliases is not None else {}), **({"hidden": F.lit(hidden)} if hidden is not None else {})}
    return people.select(*[F.when(own, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in people.columns])


def wipe_faces(faces: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without rows."""
    return faces.limit(0), people.limit(0)


def video_frames(videos: DataFrame, frames: DataFrame, inherited: list[str]) -> DataFrame:
    """A row for each frame (video_id, frame_ts, and columns of its own) of a video: its path and hash with the time, the
    video's time moved on by it, and the video's `inherited` columns. Paths that are there already are the caller's to
    keep (upsert with keep_first)."""
    own = [c for c in frames.columns if c not in ("video_id", "frame_ts")]
    at = F.format_string("%.2f", "frame_ts")
    taken = F.timestamp_micros(F.unix_micros(F.col("taken_at").cast("timestamp")) + F.round(F.col("frame_ts") * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    met = frames.join(videos.select(F.col("id").alias("video_id"), "path", "file_hash", "taken_at", *inherited), "video_id")
    return met.select(
        F.concat("path", F.lit("#t="), at).alias("path"), F.concat("file_hash", F.lit(":"), at).alias("file_hash"), F.lit("image").alias("media_type"), F.lit("video_frame").alias("format"),
        taken.alias("taken_at"), F.lit(True).alias("is_video_frame"), F.col("video_id").alias("source_video_id"), "frame_ts", *inherited, *own,
    )


def stable(listing: DataFrame, now: Column, wait_s: float = 3.0) -> DataFrame:
    """Files that nothing has written to for `wait_s` seconds; the others wait for the next listing."""
    return listing.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp")) >= wait_s * 1e6)


def free_names(wanted: DataFrame, taken: DataFrame, name: str, order: list[Column], content: str | None = None) -> DataFrame:
    """`wanted` with the column free_name: its name, or that with the least of "-1", "-2" ... before its extension that no
    taken name and no row before it in `order` has. With `content`, a hash that both tables have, a name counts as free
    for a row of the same content.

    Names that can meet are those that are equal without all such suffixes; they lie together in one sorted pass that
    holds, of one such family at a time, the names given out.
    """
    family = F.regexp_replace(name, r"(-\d+)+(?=(\.[^./]*)?$)", "")
    mark = F.col(content).cast("string") if content else F.lit(None).cast("string")
    place = F.row_number().over(Window.partitionBy("free_family").orderBy(*order))
    rows = wanted.withColumn("free_family", family).withColumn("free_place", place).withColumn("free_content", mark)
    rows = rows.withColumn("free_wanted", F.struct(*[F.col(c) for c in wanted.columns]))
    held = taken.select(family.alias("free_family"), F.lit(0).alias("free_place"), mark.alias("free_content"), F.col(name).alias("free_name"), F.lit(None).cast(rows.schema["free_wanted"].dataType).alias("free_wanted"))
    both = rows.select("free_family", "free_place", "free_content", F.col(name).alias("free_name"), "free_wanted").unionByName(held)
    dealt = both.repartition("free_family").sortWithinPartitions("free_family", "free_place")
    named = dealt.mapInArrow(_give_names, dealt.schema).where("free_place > 0")
    return named.select(*[F.col("free_wanted")[c].alias(c) for c in wanted.columns], "free_name")


def _give_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family, given, counters = None, {}, {}
    for batch in batches:
        names = batch.column("free_name").to_pylist()
        for at, (own, place, content) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("free_family", "free_place", "free_content")))):
            if own != family:
                family, given, counters = own, {}, {}
            if place and names[at] is not None:
                names[at] = _free_name(names[at], content, given, counters)
            given.setdefault(names[at], content)
        yield batch.set_column(batch.schema.get_field_index("free_name"), "free_name", pa.array(names, pa.string()))


def _free_name(name: str, content: str | None, given: dict[str, str | None], counters: dict[str, tuple[int, dict[str, str]]]) -> str:
    """The first of name, name-1, ... that isn't given, or is to the same content. `counters` keeps, of each wanted name,
    how far its numbers are given out and to what contents, so that many rows of one name take few steps each."""
    if name not in given:
        return name
    stem, dot, extension = name.rpartition(".") if "." in name.rpartition("/")[2][1:] else (name, "", "")
    number, contents = counters.get(name, (0, {}))
    at = name if not number else f"{stem}-{number}{dot}{extension}"
    while at in given:
        if given[at] is not None:
            contents.setdefault(given[at], at)
        number += 1
        at = f"{stem}-{number}{dot}{extension}"
    counters[name] = (number, contents)
    return contents.get(content, at) if content is not None else at
