"""Debouncing with timers and stages that run once, across restarts."""

import time

from shoebox.streaming import incremental

SCHEMA = "path string, seq bigint, op string, at timestamp, size double"


def put(spark, folder, rows):
    spark.createDataFrame(rows, "path string, seq bigint, op string, size double").selectExpr("path", "seq", "op", "timestamp_micros(seq * 1000001) as at", "size").coalesce(1).write.mode("append").parquet(folder)


def test_each_keys_last_event_comes_once_over_a_restart(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    put(spark, source, [("a", 1, "upsert", 1.0), ("a", 3, "delete", None), ("a", 2, "upsert", 2.0), ("b", 1, "upsert", 0.1), (None, 9, "upsert", 1.0), ("z", None, "upsert", 1.0)])
    schema = spark.createDataFrame([], SCHEMA).schema

    def start(wait):
        stream = incremental.debounced(incremental.event_stream(spark, source, schema), "path", "seq", wait)
        return stream.writeStream.foreachBatch(incremental.write_once(out, {"changes": lambda df: df})).option("checkpointLocation", checkpoint).trigger(processingTime="300 milliseconds").start()

    def seen():
        try:
            return sorted((r.path, r.seq, r.op, r.at.timestamp(), r["size"]) for r in spark.read.parquet(f"{out}/changes").collect())
        except Exception as e:
            assert "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)
            return []

    first = start(12.0)
    time.sleep(8)  # a batch is in, and its timers still run
    assert first.lastProgress and first.exception() is None
    first.stop()
    assert seen() == []
    put(spark, source, [("b", 5, "upsert", 0.5)])  # comes while nothing runs, and pushes b's timer on
    second = start(12.0)
    end = time.time() + 60
    while len(seen()) < 2 and time.time() < end:
        time.sleep(1)
    time.sleep(2)
    second.stop()
    assert seen() == [("a", 3, "delete", 3.000003, None), ("b", 5, "upsert", 5.000005, 0.5)]


def test_stages_run_once_and_go_on_behind_a_loss(spark, tmp_path):
    ran, lost = [], {"two"}

    def stage(name):
        def run(df):
            ran.append(name)
            if name == "two" and lost:
                lost.clear()
                raise RuntimeError("lost")
            return df.selectExpr("*", f"1 as {name}")

        return run

    each = incremental.write_once(str(tmp_path), {"one": stage("one"), "two": stage("two")})
    batch = spark.range(3)
    try:
        each(batch, 0)
    except RuntimeError:
        pass
    each(batch, 0)
    each(batch, 0)
    each(spark.range(5), 1)
    assert ran == ["one", "two", "two", "one", "two"]  # one of batch 0 isn't run again, nor is anything of a whole batch
    rows = spark.read.parquet(str(tmp_path / "two"))
    assert rows.groupBy("batch").count().orderBy("batch").collect() == [(0, 3), (1, 5)] and rows.columns == ["id", "one", "two", "batch"]
