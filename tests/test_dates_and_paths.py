"""Calendar, path-date expressions, path resolution, names. No Spark needed except for columns."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyline.errors import ConfigError, UnknownColumn
from tallyline.functions.dates import (
    active_holidays,
    expected_calendar,
    partition_value,
    previous_business_day,
    previous_business_day_of,
)
from tallyline.functions.naming import date_pattern, find_column, hyphen_safe, require_column
from tallyline.sources import paths

D = date
CASES = [
    (D(2026, 3, 10), [], D(2026, 3, 9)),
    (D(2026, 1, 2), ["2026-01-01"], D(2025, 12, 31)),
    (D(2026, 3, 10), ["2026-03-09", "2026-03-08"], D(2026, 3, 7)),
    (D(2026, 3, 9), [], D(2026, 3, 8)),  # a Monday: Sunday counts
    (D(2026, 3, 10), [{"active": False, "date": "2026-03-09"}], D(2026, 3, 9)),
    (D(2026, 3, 10), [{"name": "x", "date": "2026-03-09"}], D(2026, 3, 8)),
]


@pytest.mark.parametrize("day,holidays,want", CASES)
def test_previous_business_day(spark, day, holidays, want):
    assert previous_business_day(day, holidays) == want
    column = previous_business_day_of(F.lit(day), holidays)
    assert spark.range(1).select(column).first()[0] == want


def test_calendar(spark):
    days = expected_calendar(spark, D(2026, 2, 27), D(2026, 3, 2), ["2026-03-01"])
    assert [r.day for r in days.orderBy("day").collect()] == [D(2026, 2, 27), D(2026, 2, 28), D(2026, 3, 2)]
    assert active_holidays(None) == []


@pytest.mark.parametrize(
    "expression,want",
    [
        ("load_date()", "20260310"),
        ("CURRENT_DATE()", "20260310"),
        ("date_sub(current_date(), 10)", "20260228"),
        ("date_format(current_date(), 'MM-dd-yyyy')", "03-10-2026"),
        ("date_format(current_date(), 'YYYYMM')", "202603"),
        ("last_day(current_date())", "20260331"),
        ("FIXED", "FIXED"),
        ("", ""),
    ],
)
def test_partition_value(expression, want):
    assert partition_value(expression, D(2026, 3, 10)) == want


def test_partition_value_rejects_other_patterns():
    with pytest.raises(ConfigError):
        partition_value("date_format(current_date(), 'EEE')", D(2026, 3, 10))


RUN = D(2026, 3, 10)
SETTINGS = {
    "raw_bucket_prefix": "s3://raw",
    "curated_bucket_prefix": "s3://curated/",
    "efs_output_prefix": "/efs",
    "validation_bucket_prefix": "s3://valid",
    "error_bucket_prefix": "s3://error",
}


def test_input_paths():
    v2 = {"dataset_name": "A.DAT", "frequency": "daily"}
    assert paths.input_path(v2, RUN, None, "IFACE", SETTINGS) == "s3://raw/IFACE/DAILY/20260310/A.DAT"
    v1 = {"source_path": "in", "source_file_name": "B.DAT", "frequency": "WEEKLY", "partition_col": "date_sub(current_date(),1)"}
    assert paths.input_path(v1, RUN, "/base") == "/base/in/WEEKLY/20260309/B.DAT"
    assert paths.input_path({**v1, "frequency": ""}, RUN, "/base") == "/base/in/B.DAT"
    assert paths.input_path({"path": "x/y"}, RUN, "/base") == "/base/x/y"
    assert paths.input_path({"s3_path": "s3://b/k"}, RUN, "/base") == "s3://b/k"
    assert paths.input_path({"dataset": "d"}, RUN) == "d" and paths.input_path({}, RUN) == ""
    assert paths.input_path_on(v1, D(2026, 3, 6)) == "in/WEEKLY/20260306/B.DAT"


def test_path_range_skips_holidays():
    node = {"source_path": "/in", "source_file_name": "B.DAT", "frequency": "DAILY"}
    found = paths.input_paths_between(node, D(2026, 3, 4), D(2026, 3, 6), ["2026-03-05"])
    assert found == ["/in/DAILY/20260304/B.DAT", "/in/DAILY/20260306/B.DAT"]


def test_output_and_validation_paths():
    assert paths.output_path({"dataset_name": "O", "frequency": "daily"}, RUN, None, "I", SETTINGS) == "s3://curated/I/DAILY/20260310"
    efs = {"dataset_name": "O", "target_storage": "EFS"}
    assert paths.output_path(efs, RUN, None, "I", SETTINGS) == "/efs/I"
    assert paths.output_path({"source_path": "/o", "frequency": "monthly"}, RUN) == "/o/MONTHLY/20260310"
    assert paths.output_path({"path": "o"}, RUN, "/b") == "/b/o"
    assert paths.target_name({"target_file_name": "X"}, "fixed") == "X.DAT"
    assert paths.target_name({"dataset_name": "x.dat"}, "fixed") == "x.dat"
    assert paths.target_name({"dataset_name": "X"}, "csv") == "X"
    got = paths.validation_paths({"dataset_name": "V", "error_dataset_name": "E", "frequency": "DAILY"}, RUN, "I", SETTINGS)
    assert got == {"valid": "s3://valid/I/DAILY/20260310", "error": "s3://error/I/DAILY/20260310", "valid_name": "V", "error_name": "E"}
    legacy = paths.validation_paths({"validated_path": "/v", "error_path": "/e"}, RUN)
    assert (legacy["valid"], legacy["error"]) == ("/v", "/e")


def test_count_file_paths():
    node = {"control_file_name": "C.CTL", "source_path": "/in", "frequency": "DAILY"}
    assert paths.count_file_path(node, RUN) == "/in/DAILY/20260310/C.CTL"
    assert paths.count_file_path({"count_file_path": "c.txt"}, RUN, "/b") == "/b/c.txt"
    assert paths.count_file_path({"control_file_name": "C"}, RUN, None, "I", SETTINGS) == "s3://raw/I/C"
    assert not paths.has_count_file({}) and paths.has_count_file(node)
    assert paths.reader_path("s3://b/k") == "s3a://b/k" and paths.reader_path("/x") == "/x"


def test_names():
    assert find_column(["A_B", "c"], "A-B") == "A_B" and find_column(["A_B"], "a-b") == "A_B"
    assert find_column(["A"], "B") is None
    with pytest.raises(UnknownColumn):
        require_column(["a", "A"], "à")
    with pytest.raises(UnknownColumn):
        find_column(["A-B", "A_B"], "A_B")
    assert date_pattern("YYYY-MM-DD") == "yyyy-MM-dd" and date_pattern("yyyy'DAY'") == "yyyy'DAY'"
    assert date_pattern(None) == "yyyyMMdd"


@pytest.mark.parametrize(
    "text,want",
    [
        ("A-B", "`A_B`"),
        ("A-C", "A - `C`"),
        ("A-B-C", "`A_B` - `C`"),
        ("A - B", "A - B"),
        ("X-5", "X - 5"),
        ("sum(A-B) - 'A-B'", "sum(`A_B`) - 'A-B'"),
        ("`A-B` + 1", "`A_B` + 1"),
    ],
)
def test_hyphens_in_expressions(text, want):
    assert hyphen_safe(text, ["A_B", "C"]) == want
