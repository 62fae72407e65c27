import datetime as dt

from tickloom.streaming import streams

T = dt.datetime(2024, 1, 25, 9)


def written(spark, tmp_path, rows, schema):
    for n, part in enumerate(rows):  # a file each, in order of name and time
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    return streams.table_stream(spark, str(tmp_path), "t", 1)


def test_batches_are_sealed_by_the_watermark(spark, tmp_path):
    # Spark drops late rows by the watermark that the micro-batch before began with: two batches after the one that moved it.
    rows = [[("A", T), ("B", T), (None, None)], [("A", T + dt.timedelta(minutes=30))], [("A", T + dt.timedelta(minutes=31))], [("A", T)], [("A", T + dt.timedelta(minutes=60))]]
    out = streams.run_to_table(streams.sealed(written(spark, tmp_path, rows, "p string, t timestamp_ntz"), "t", "p"), folder=str(tmp_path / "out"))
    got = {r.batch_ts: r.n_rows for r in out.collect()}
    assert got[T] == 2 and T + dt.timedelta(minutes=60) not in got  # the late row is not added; the last batch is still open


def test_copies_are_dropped(spark, tmp_path):
    rows = [[("k", T, 1), ("j", T, 1)], [("k", T, 2)], [(None, T, 3), (None, T, 4)]]
    stream = written(spark, tmp_path, rows, "k string, t timestamp_ntz, n int")
    out = streams.run_to_table(streams.deduplicated(stream, ["k"], "t"), folder=str(tmp_path / "out"))
    assert sorted(r.k or "" for r in out.collect()) == ["", "j", "k"]


def test_state_is_carried_over(spark, tmp_path):
    rows = [[("P", T, "a", 10.0, 2)], [("P", T + dt.timedelta(seconds=2), "c", 14.0, -3), ("P", T + dt.timedelta(seconds=1), "b", 12.0, 2), ("Q", T, "d", 1.0, 1)]]
    out = streams.run_to_table(streams.positions(written(spark, tmp_path, rows, "product string, at timestamp_ntz, key string, px double, qty long")), folder=str(tmp_path / "out"))
    last = {r.product: r for r in out.collect() if r.n == (3 if r.product == "P" else 1)}
    assert last["P"].pos == 1 and last["P"].gross == 9.0 and last["Q"].pos == 1


def test_late_rows(spark):
    df = spark.createDataFrame([(1, T, T + dt.timedelta(seconds=180)), (2, T, T + dt.timedelta(seconds=180, microseconds=1)), (3, None, T), (4, T, None)], "n int, t timestamp_ntz, a timestamp_ntz")
    assert [r.n for r in streams.late_rows(df, "t", "a", 180).collect()] == [2]
