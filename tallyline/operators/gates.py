"""Whole-file checks: record counts, header dates, missing deliveries.

A gate is a small frame with its findings. ``demand`` is the action that turns
a failed one into an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.errors import ConfigError, GateFailed
from tallyline.functions.dates import expected_calendar, previous_business_day_of
from tallyline.functions.naming import date_pattern, quoted, require_column
from tallyline.sources.layout import FieldSpec, Layout
from tallyline.sources.segments import FILE


def trailer_count(
    trailer: DataFrame, field: str, basis: str = "inclusive", header_lines: int = 0, trailer_lines: int = 0
) -> DataFrame:
    """Data rows a trailer announces. ``inclusive`` counts header and trailer lines too."""
    value = F.col(quoted(require_column(trailer.columns, field))).try_cast("bigint")
    if basis == "inclusive":
        value = value - (header_lines + trailer_lines)
    elif basis != "data":
        raise ConfigError(f"count basis {basis!r}")
    keep = [FILE] if FILE in trailer.columns else []
    return trailer.select(*keep, value.alias("expected"))


def announced_total(expected: DataFrame) -> DataFrame:
    """The counts of all files as one row; NULL if one of them cannot be read."""
    known = F.count("expected") == F.count(F.lit(1))
    return expected.agg(F.when(known, F.sum("expected")).alias("expected"))


def count_gate(data: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: expected, actual, ok. An unreadable expectation is not ok.

    ``expected`` has one row per file; the counts of several files add up.
    """
    total = announced_total(expected)
    counted = data.agg(F.count(F.lit(1)).alias("actual"))
    return counted.select(total.scalar().alias("expected"), "actual").withColumn(
        "ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    )


def count_gate_by_file(data: DataFrame, expected: DataFrame) -> DataFrame:
    """The count gate for each file: rows are counted in the map tasks, then per file."""
    counted = data.groupBy(FILE).agg(F.count(F.lit(1)).alias("actual"))
    return expected.join(counted, FILE, "left").select(
        FILE,
        "expected",
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce(F.col("expected") == F.coalesce("actual", F.lit(0)), F.lit(False)).alias("ok"),
    )


def date_status(raw: Column, expected: Column, pattern: str = "yyyyMMdd") -> Column:
    """OK, MISMATCH, INVALID_DATE (right shape, no such day), PARSE_ERROR, FIELD_NOT_FOUND."""
    pattern = date_pattern(pattern)
    day = F.try_to_date(raw, pattern)
    shape = "^" + "".join(r"\d" if c in "yMdHms" else "\\" + c if not c.isalnum() else c for c in pattern) + "$"
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), "FIELD_NOT_FOUND")
        .when(day.isNull() & raw.rlike(shape), "INVALID_DATE")
        .when(day.isNull(), "PARSE_ERROR")
        .when(day == expected, "OK")
        .otherwise("MISMATCH")
    )


def header_date_gate(
    header: DataFrame,
    field: str,
    run_date: date | Column,
    holidays: Sequence | None = None,
    pattern: str = "yyyyMMdd",
) -> DataFrame:
    """Is the header date of a previous delivery the business day before ``run_date``?"""
    day = run_date if isinstance(run_date, Column) else F.lit(run_date)
    expected = previous_business_day_of(day, holidays)
    raw = F.col(quoted(require_column(header.columns, field)))
    keep = [FILE] if FILE in header.columns else []
    status = date_status(raw, expected, pattern)
    return header.select(
        *keep,
        expected.alias("expected"),
        raw.alias("actual"),
        status.alias("status"),
        (status == "OK").alias("ok"),
    )


def delivery_gaps(
    deliveries: DataFrame,
    day: str,
    first: date,
    last: date,
    holidays: Sequence | None = None,
) -> DataFrame:
    """Days of the calendar on which nothing arrived.

    ``day`` holds the date of each delivery. Days are made distinct before the
    join, whatever one day delivered; the calendar has a row per day.
    """
    arrived = deliveries.select(F.col(quoted(day)).cast("date").alias("day")).distinct()
    calendar = expected_calendar(deliveries.sparkSession, first, last, holidays)
    return calendar.join(arrived, "day", "left_anti").select("day")


def delivery_check(
    headers: DataFrame, field: str, folder_day: Column, pattern: str = "yyyyMMdd"
) -> DataFrame:
    """Does the header date of each file agree with the date of its folder?"""
    raw = F.col(quoted(require_column(headers.columns, field)))
    return headers.select(FILE, folder_day.alias("expected"), raw.alias("actual")).withColumn(
        "status", date_status(F.col("actual"), F.col("expected"), pattern)
    )


def _matches(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, which may be a glob, and what it finds there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, list(fs.globStatus(target) or [])


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path names at least one file or folder."""
    return bool(_matches(spark, path)[1])


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path; 0 if there is nothing."""
    fs, found = _matches(spark, path) if path else (None, [])
    return sum(fs.getContentSummary(status.getPath()).getLength() for status in found)


def demand(gate: DataFrame, what: str, samples: int = 5) -> None:
    """Raise unless every row of a gate is ok; shows the first rows that are not."""
    failed = gate.filter(~F.col("ok")).limit(samples).collect()
    if failed:
        raise GateFailed(f"{what}: {[r.asDict() for r in failed]}")


def count_layout(field: str, start: int, length: int) -> Layout:
    """The layout of a control file of which only the count matters."""
    return Layout.of([FieldSpec(field, "long", start, length)])
