from datetime import datetime, timedelta

from shoebox.streaming import incremental

SCHEMA = "path string, seq long, op string, at timestamp, value int"


def events():
    start = datetime(2025, 1, 1)
    rows = [(f"p{i % 4}", i, "delete" if i % 7 == 3 else "upsert", start + timedelta(minutes=i * (1 if i % 9 else 40)), i) for i in range(60)]
    return rows


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    rows = events()
    for i in range(0, 60, 15):
        spark.createDataFrame(rows[i : i + 15], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], SCHEMA).schema
    state = {"df": spark.createDataFrame([], "path string, value int")}

    def each(batch, _):
        kept = incremental.apply_events(state["df"], batch, "path", "seq").collect()
        state["df"] = spark.createDataFrame(kept, "path string, value int")

    stream = incremental.event_stream(spark, str(tmp_path / "in"), schema)
    incremental.run_available(stream, each, str(tmp_path / "checkpoint"))
    expected = {}
    for path, _, op, _, value in rows:
        expected.pop(path, None)
        if op == "upsert":
            expected[path] = value
    assert {r.path: r.value for r in state["df"].collect()} == expected
    incremental.run_available(stream, each, str(tmp_path / "checkpoint"))  # nothing new: nothing changes
    assert {r.path: r.value for r in state["df"].collect()} == expected


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    spark.createDataFrame(events(), SCHEMA).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in incremental.session_windows(table, "at", "path", "10 minutes").collect()}
    stream = incremental.session_windows(incremental.event_stream(spark, str(tmp_path / "in"), table.schema), "at", "path", "10 minutes")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from sessions").collect()} == batch


def test_events_wait_for_quiet(spark):
    from datetime import datetime, timedelta

    from shoebox.streaming.incremental import quiet

    now = datetime(2025, 1, 1, 12)
    rows = [("a", "upsert", now - timedelta(seconds=9)), ("a", "delete", now - timedelta(seconds=5)), ("b", "upsert", now - timedelta(seconds=7)), ("b", "upsert", now - timedelta(seconds=1))]
    ready, waiting = quiet(spark.createDataFrame(rows, "path string, op string, at timestamp_ntz"), "path", "at", now)
    assert [(r.path, r.op) for r in ready.collect()] == [("a", "delete")] and waiting.count() == 2


def test_moves_take_frames_along(spark):
    from shoebox.streaming.incremental import apply_moves

    rows = spark.createDataFrame([("/a.mp4", 1), ("/a.mp4#t=1.00", 2), ("/b", 3)], "path string, k int")
    moves = spark.createDataFrame([("/a.mp4", "/z.mp4"), ("/outside", "/new")], "old string, new string")
    moved, unmatched = apply_moves(rows, moves)
    assert {r.k: r.path for r in moved.collect()} == {1: "/z.mp4", 2: "/z.mp4#t=1.00", 3: "/b"} and [r.path for r in unmatched.collect()] == ["/new"]


def test_a_sweep_finds_what_events_missed(spark):
    from shoebox.streaming.incremental import sweep

    schema = "path string, file_hash string, mtime double"
    old = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0), ("c", "3", 1.0)], schema)
    new = spark.createDataFrame([("a", "1", 1.0), ("b", "9", 2.0), ("d", "4", 1.0)], schema)
    got = {(r.path, r.todo) for r in sweep(old, new, [spark.createDataFrame([("b",)], "path string")]).collect()}
    assert got == {("a", "complete"), ("b", "scan"), ("d", "scan"), ("c", "remove")}
