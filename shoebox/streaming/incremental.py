"""Incremental indexing with Structured Streaming: events in, tables kept up to date, state bounded."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.operators import upkeep


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def last_event(events: DataFrame, key: str, order: str) -> DataFrame:
    """Of the events of one batch the last of each key: a debounce in which the last write wins."""
    rest = F.struct(*[c for c in events.columns if c != key])
    return events.groupBy(key).agg(F.max_by(rest, order).alias("e")).select(key, "e.*")


def apply_events(state: DataFrame, events: DataFrame, key: str, order: str, op: str = "op") -> DataFrame:
    """State after a batch of upsert and delete events."""
    last = last_event(events, key, order)
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(op) == "upsert").select(*state.columns))


def session_windows(events: DataFrame, at: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, started, ended, n): sessions by event time; with `late`, a watermark bounds what state is kept."""
    timed = events.withWatermark(at, late) if late else events
    return timed.groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("ended")).select(key, F.col("w.start").alias("started"), "ended", "n")


def tumbling_counts(events: DataFrame, at: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """(key, started, n) in windows of event time."""
    timed = events.withWatermark(at, late) if late else events
    return timed.groupBy(F.col(key), F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all that is available to `each`, batch by batch; a restart goes on where the checkpoint says."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def index_batch(listing: DataFrame, catalogued: DataFrame, derived: dict[str, DataFrame], key: str = "path") -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """One step of indexing from a full listing: (changes, catalogue, derived tables).

    The listing's differences tell moved files from new ones; derived rows of changed and deleted files go, so that the
    next stages find them pending. File sources of a stream name no deletions, so this runs on listings.
    """
    changes = upkeep.listing_diff(catalogued, listing)
    stale = changes.where("status in ('changed', 'deleted')").select(key)
    return changes, listing.select(*catalogued.columns), upkeep.invalidate(derived, key, stale)


def quiet(events: DataFrame, key: str, at: str, now, wait_s: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(ready, waiting): the last event of each key nothing has happened to for `wait_s` seconds before `now`, and all
    events of the others, which the next batch takes up again."""
    last = events.groupBy(key).agg(F.max(at).alias("quiet_last"))
    still = last.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("quiet_last").cast("timestamp")) >= wait_s * 1e6).select(key)
    return last_event(events.join(still, key, "left_semi"), key, at), events.join(still, key, "left_anti")


def apply_moves(rows: DataFrame, moves: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows with moved paths, unmatched): moves are (old, new). Frames of a video ("path#t=...") move with it; a move
    whose old path is not here is a new file at its new one."""
    whole, rest = F.regexp_extract(path, r"^(.*?)(#t=.*)?$", 1), F.regexp_extract(path, r"^(.*?)(#t=.*)?$", 2)
    own = moves.groupBy("old").agg(F.max("new").alias("new"))
    moved = rows.withColumn("move_from", whole).join(own.withColumnRenamed("old", "move_from"), "move_from", "left")
    moved = moved.select(*[F.when(F.col("new").isNotNull(), F.concat("new", rest)).otherwise(F.col(path)).alias(path) if c == path else F.col(c) for c in rows.columns])
    return moved, own.join(rows.select(F.col(path).alias("old")), "old", "left_anti").select(F.col("new").alias(path))


def sweep(catalogued: DataFrame, listing: DataFrame, derived: list[DataFrame], key: str = "path") -> DataFrame:
    """(path, todo) of a sweep over everything, for what events have missed: files to scan, to remove, to complete."""
    changes = upkeep.listing_diff(catalogued, listing)
    scan = changes.where("status in ('new', 'changed')").select(key, F.lit("scan").alias("todo"))
    gone = changes.where("status = 'deleted'").select(key, F.lit("remove").alias("todo"))
    known = changes.where("status in ('unchanged', 'touched')").select(key)
    return scan.unionByName(gone).unionByName(upkeep.pending(known, key, derived).withColumn("todo", F.lit("complete")))


def debounced(events: DataFrame, key: str, order: str, wait_s: float = 5.0) -> DataFrame:
    """The last event (by `order`, a whole number) of each key, once nothing has come for the key for `wait_s` seconds.

    State is one event for each key that is waiting, and goes with its timer, which a restart finds in the checkpoint. Of
    events with equal `order` one is chosen by its content, so that replays agree. An event without a key or an order is
    left out. The stream's other columns may be of any type that JSON can hold.
    """
    fine = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    packed = events.select(F.col(key).cast("string").alias("debounce_key"), F.col(order).cast("bigint").alias("turn"), F.to_json(F.struct(*events.columns), fine).alias("event"))

    def step(_, batches, state):
        if state.hasTimedOut:
            (_, event) = state.get
            state.remove()
            yield pd.DataFrame({"event": [event]})
            return
        last = tuple(state.get) if state.exists else None
        for batch in batches:
            for turn, event in zip(batch["turn"].tolist(), batch["event"].tolist()):
                last = max(last, (turn, event)) if last else (turn, event)
        state.update(last)
        state.setTimeoutDuration(max(1, int(wait_s * 1000)))

    keyed = packed.where("debounce_key is not null and turn is not null").groupBy("debounce_key")
    quiet_ones = keyed.applyInPandasWithState(step, "event string", "turn bigint, event string", "append", "ProcessingTimeTimeout")
    return quiet_ones.select(F.from_json("event", events.schema, fine).alias("e")).select("e.*")


def write_once(path: str, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that runs dependent stages, each on what the one before has written, exactly once for each batch.

    A stage's rows of a batch are the folder `stage`/batch=id. A stage that has finished left _SUCCESS there, and a restart
    after a loss in between goes on behind it; one that was cut off is written anew. The folders are the ledger.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows, spark = batch, batch.sparkSession
        for name, stage in stages.items():
            at = f"{path.rstrip('/')}/{name}/batch={number}"
            made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
            if not made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(made):
                stage(rows).write.mode("overwrite").parquet(at)
            rows = spark.read.parquet(at)

    return each
