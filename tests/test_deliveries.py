"""The watch over deliveries: gaps, late days and repeats are told once, across batches and stops."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tallyline.operators.gates import delivery_gaps
from tallyline.streaming.deliveries import watch_deliveries
from tallyline.streaming.windows import arriving, write_available

SCHEMA = "source string, day date, at timestamp, extra int"
FIRST = date(2026, 3, 1)
HOLIDAYS = ["2026-03-04"]


def _arrive(spark, base, *rows):
    """Rows of source, day of March, day and hour of arrival (unset: the evening of the day)."""
    made = []
    for source, day, *arrival in rows:
        at_day, hour = arrival or (day, 20)
        made.append((source, date(2026, 3, day), datetime(2026, 3, 1) + timedelta(days=at_day - 1, hours=hour), 1))
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(base / "in"))


def _watch(spark, base, last=date(2026, 3, 10), at_once=1, patience="0 days", disorder="1 hour"):
    stream = arriving(spark, str(base / "in"), SCHEMA, at_once)
    found = watch_deliveries(stream, "source", "day", "at", FIRST, last, HOLIDAYS, patience, disorder)
    write_available(found, str(base / "out"), str(base / "checkpoint"))
    return sorted(((r.source or "", r.day.day, r.finding) for r in spark.read.parquet(str(base / "out")).collect()))


def test_findings_are_told_once_and_a_silent_source_is_found(spark, tmp_path):
    _arrive(spark, tmp_path, ("a", 1), ("b", 1), ("a", 2), ("a", 2), (None, 1))
    assert _watch(spark, tmp_path) == [("a", 2, "repeat")]
    # b and the source without a name say nothing more; a goes on.
    _arrive(spark, tmp_path, ("a", 3), ("a", 5), ("a", 2, 5, 21))
    first = [("", 2, "gap"), ("", 3, "gap"), ("a", 2, "repeat"), ("b", 2, "gap"), ("b", 3, "gap")]
    assert _watch(spark, tmp_path) == first
    assert _watch(spark, tmp_path) == first
    # After a stop: a day told as a gap comes twice, a holiday is delivered, a day outside of the calendar too.
    _arrive(spark, tmp_path, ("b", 2, 6, 1), ("b", 2, 6, 2), ("a", 4, 6, 3), ("a", 20, 6, 4), ("b", 5, 6, 5))
    after = first + [("b", 2, "late"), ("b", 2, "repeat"), ("", 5, "gap"), ("b", 5, "gap"), ("b", 5, "late")]
    assert _watch(spark, tmp_path) == sorted(after)


def test_patience_and_disorder(spark, tmp_path):
    # Day 1 of a comes a day after its end, within patience; of b, the arrivals of a day are seen in the wrong order.
    _arrive(spark, tmp_path, ("a", 1, 2, 12), ("b", 1, 4, 2), ("b", 2))
    _arrive(spark, tmp_path, ("b", 1, 3, 1), ("a", 2, 4, 5))
    _arrive(spark, tmp_path, ("a", 3, 6, 12), ("b", 3, 6, 1))
    assert _watch(spark, tmp_path, patience="2 days", disorder="30 hours") == [("b", 1, "repeat")]
    _arrive(spark, tmp_path, ("a", 6, 8, 12), ("b", 6, 8, 1))
    # Day 3 was due as the 6th began; both sources brought it later on that day.
    assert _watch(spark, tmp_path, patience="2 days", disorder="30 hours") == [
        ("a", 3, "gap"), ("a", 3, "late"), ("b", 1, "repeat"), ("b", 3, "gap"), ("b", 3, "late")
    ]


def test_gaps_are_those_of_the_whole_table(spark, tmp_path):
    days = [1, 2, 5, 6, 9, 11, 12, 17, 18, 19, 24]
    for part in (days[:4], days[4:5], days[5:]):
        _arrive(spark, tmp_path, *[("s", d) for d in part])
    told = _watch(spark, tmp_path, date(2026, 3, 23))
    table = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    whole = delivery_gaps(table, "day", FIRST, date(2026, 3, 23), HOLIDAYS)
    assert [d for _, d, f in told if f == "gap"] == [r.d for r in whole.select(F.dayofmonth("day").alias("d")).orderBy("d").collect()]
    # The calendar goes on.
    _arrive(spark, tmp_path, ("s", 28))
    longer = _watch(spark, tmp_path, date(2026, 3, 31))
    assert [row for row in longer if row not in told] == [("s", d, "gap") for d in (25, 26, 27)]
    # A shorter one loses nothing that was seen or told.
    _arrive(spark, tmp_path, ("s", 30))
    assert _watch(spark, tmp_path, date(2026, 3, 23)) == longer
    _arrive(spark, tmp_path, ("s", 31))
    assert [row for row in _watch(spark, tmp_path, date(2026, 3, 31)) if row not in longer] == [("s", 29, "gap")]


def test_nothing_arrived(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert _watch(spark, tmp_path) == []
