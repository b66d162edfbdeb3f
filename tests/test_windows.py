"""Windows of event time: what a stream tells, what it leaves open, what came too late, and going on after a stop."""

from datetime import datetime, timedelta

from tallyline.streaming.windows import arriving, count_windows, missed, write_available

SCHEMA = "at timestamp, kind string"
DAY = datetime(2026, 3, 5)


def _arrive(spark, folder, *rows):
    frame = spark.createDataFrame([(DAY + timedelta(minutes=m) if m is not None else None, k) for m, k in rows], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(str(folder))


def _rows(frame):
    return sorted((int((r.window_start - DAY).total_seconds() // 60), str(r.kind), r.n) for r in frame.collect())


def _run(spark, base, width, gap=False, late="10 minutes"):
    stream = count_windows(arriving(spark, str(base / "in"), SCHEMA, 1), "at", width, ["kind"], late, gap)
    write_available(stream, str(base / "out"), str(base / "checkpoint"))
    return spark.read.parquet(str(base / "out"))


def test_windows_are_told_once_and_late_rows_named(spark, tmp_path):
    _arrive(spark, tmp_path / "in", (1, "a"), (5, "a"), (7, None), (61, "a"), (None, "a"))
    _arrive(spark, tmp_path / "in", (75, "a"), (2, "a"))  # the latest time seen is 61 - 10: the first hour is still open
    told = _run(spark, tmp_path, "60 minutes")
    assert _rows(told) == [(0, "None", 1), (0, "a", 3)]
    _arrive(spark, tmp_path / "in", (130, "b"), (3, "a"), (4, "c"), (70, "a"))
    told = _run(spark, tmp_path, "60 minutes")
    assert _rows(told) == [(0, "None", 1), (0, "a", 3), (60, "a", 3)]
    arrived = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert _rows(missed(told, arrived, "at", "60 minutes", ["kind"])) == [(0, "a", 1), (0, "c", 1)]
    assert _rows(count_windows(arrived, "at", "60 minutes", ["kind"])) == [
        (0, "None", 1), (0, "a", 4), (0, "c", 1), (60, "a", 3), (120, "b", 1)
    ]


def test_sessions_grow_across_batches(spark, tmp_path):
    _arrive(spark, tmp_path / "in", (1, "a"), (8, "a"), (40, "a"), (5, "b"))
    _arrive(spark, tmp_path / "in", (45, "a"), (31, "b"))
    told = _run(spark, tmp_path, "10 minutes", gap=True, late="30 minutes")
    _arrive(spark, tmp_path / "in", (200, "z"))
    told = _run(spark, tmp_path, "10 minutes", gap=True, late="30 minutes")
    assert _rows(told) == [(1, "a", 2), (5, "b", 1), (31, "b", 1), (40, "a", 2)]


def test_nothing_arrived(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    told = spark.createDataFrame([], "window_start timestamp, window_end timestamp, kind string, n long")
    arrived = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert count_windows(arrived, "at", "1 hour", ["kind"]).count() == 0
    assert missed(told, arrived, "at", "1 hour", ["kind"]).count() == 0
