"""Positional lines: parsing, typing, formatting."""

from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyline.errors import ConfigError
from tallyline.functions.fixed import format_lines, parse_lines
from tallyline.sources.layout import FieldSpec, Layout

LAYOUT = Layout.of(
    [
        FieldSpec("KEY", "long", length=12),
        FieldSpec("NAME", length=8),
        FieldSpec("AMOUNT", "decimal", length=15, precision=2),
        FieldSpec("DAY", "date", length=8),
        FieldSpec("CODE", length=6, just_right=True),
    ]
)
SCHEMA = "KEY bigint, NAME string, AMOUNT decimal(14,2), DAY date, CODE string"
WORD = st.text("ABCxyz0-9/é", min_size=1, max_size=6)
ROW = st.tuples(
    st.none() | st.integers(-(10**11) + 1, 10**12 - 1),
    st.none() | WORD,
    st.none() | st.decimals(Decimal("-99999999999.99"), Decimal("999999999999.99"), places=2),
    st.none() | st.dates(date(1900, 1, 1), date(2100, 1, 1)),
    st.none() | WORD,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=40))
def test_parse_of_format_is_identity(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    lines = format_lines(frame, LAYOUT)
    assert all(len(r.value) == 49 for r in lines.collect())
    back = [tuple(r) for r in parse_lines(lines, LAYOUT, as_types=True).collect()]
    want = [tuple("" if v is None and i in (1, 4) else v for i, v in enumerate(r)) for r in rows]
    assert sorted(map(repr, back)) == sorted(map(repr, want))


def _line(spark, value, field, dtype, **options):
    frame = spark.createDataFrame([(value,)], f"V {dtype}")
    return format_lines(frame, Layout.of([field]), **options).first().value


@pytest.mark.parametrize(
    "value,line",
    [("12.34", "001234"), ("-5", "-00500"), ("0", "000000"), (None, "      "), ("-0.05", "-00005")],
)
def test_scaled_digits(spark, value, line):
    value = None if value is None else Decimal(value)
    assert _line(spark, value, FieldSpec("V", "decimal", length=6, precision=2), "decimal(10,2)") == line


def test_numbers_and_text(spark):
    assert _line(spark, 42, FieldSpec("V", "long", length=5), "bigint") == "   42"
    assert _line(spark, 42.0, FieldSpec("V", "long", length=5), "double") == "   42"
    assert _line(spark, "abcdef", FieldSpec("V", length=4), "string") == "abcd"
    assert _line(spark, "ab", FieldSpec("V", length=4, just_right=True), "string") == "  ab"
    assert _line(spark, date(2026, 3, 5), FieldSpec("V", length=10, format="DD/MM/YYYY"), "date") == "05/03/2026"


def test_overflow_is_an_error_unless_asked_for(spark):
    field = FieldSpec("V", "long", length=3)
    with pytest.raises(Exception, match="exceeds 3 characters"):
        _line(spark, 12345, field, "bigint")
    assert _line(spark, 12345, field, "bigint", on_overflow="truncate") == "123"
    assert _line(spark, 12345, field, "bigint", on_overflow="null") == "   "


def test_eighteen_digits_stay_exact(spark):
    field = FieldSpec("V", "decimal", length=18, precision=2)
    value = Decimal("9999999999999999.99")
    assert _line(spark, value, field, "decimal(18,2)") == "9" * 18
    lines = spark.createDataFrame([("9" * 18,)], "value string")
    assert parse_lines(lines, Layout.of([field]), as_types=True).first()[0] == value


def test_bad_values_become_null_not_errors(spark):
    lines = spark.createDataFrame([("12AB  20260230",), ("000150",), ("",)], "value string")
    layout = Layout.of([FieldSpec("N", "decimal", length=6, precision=2), FieldSpec("D", "date", length=8)])
    rows = [tuple(r) for r in parse_lines(lines, layout, as_types=True).collect()]
    assert rows == [(None, None), (Decimal("1.50"), None), (None, None)]


def test_plain_cut(spark):
    lines = spark.createDataFrame([("ABCDE12345XYZ",)], "value string")
    layout = Layout.of([FieldSpec("A", length=5), FieldSpec("B", length=5), FieldSpec("C", length=3)])
    assert tuple(parse_lines(lines, layout).first()) == ("ABCDE", "12345", "XYZ")


def test_absolute_starts(spark):
    fields = [FieldSpec("A", start=121, length=3), FieldSpec("B", start=124, length=2)]
    short = spark.createDataFrame([("ABCDE",)], "value string")
    for layout in (Layout.of(fields, continued=True), Layout.of(fields, 5)):
        assert tuple(parse_lines(short, layout).first()) == ("ABC", "DE")
    full = spark.createDataFrame([("x" * 120 + "ABCDE",)], "value string")
    for layout in (Layout.of(fields, continued=False), Layout.of(fields, 200)):
        assert tuple(parse_lines(full, layout).first()) == ("ABC", "DE")
    with pytest.raises(ConfigError):
        Layout.of(fields)


def test_all_lines_of_a_layout_are_cut_alike(spark):
    layout = Layout.of([FieldSpec("A", start=11, length=5)], continued=True)
    lines = spark.createDataFrame([("ABCDEFGHIJ",), ("KLMNOPQRSTUVWXYZ",)], "value string")
    assert sorted(r.A for r in parse_lines(lines, layout).collect()) == ["ABCDE", "KLMNO"]


def test_doubles_beyond_decimals_are_an_overflow(spark):
    frame = spark.createDataFrame([(1e37,), (float("nan"),), (None,)], "N double")
    for field in (FieldSpec("N", "decimal", length=12, precision=2), FieldSpec("N", "long", length=12)):
        layout = Layout.of([field])
        for row in ("1e37", "'NaN'"):
            with pytest.raises(Exception, match="exceeds 12 characters"):
                format_lines(frame.filter(f"N = double({row})"), layout).collect()
        shown = [r.value for r in format_lines(frame, layout, on_overflow="null").collect()]
        assert shown == [" " * 12] * 3


def test_gaps_overlaps_and_missing_columns(spark):
    frame = spark.createDataFrame([("ab", "cd")], "A string, B string")
    gap = Layout.of([FieldSpec("B", start=6, length=2), FieldSpec("A", start=1, length=2), FieldSpec("X", start=9, length=2)], 12)
    assert format_lines(frame, gap).first().value == "ab   cd     "
    over = Layout.of([FieldSpec("A", start=1, length=4), FieldSpec("B", start=3, length=2)])
    assert format_lines(frame, over).first().value == "abcd"


def test_layout_types_and_metadata():
    schema = LAYOUT.struct()
    assert schema["AMOUNT"].dataType.simpleString() == "decimal(15,2)"
    assert schema["AMOUNT"].metadata["start"] == 21 and schema["CODE"].metadata["just_right"] is True
    with pytest.raises(ConfigError):
        Layout.of([FieldSpec("A-B"), FieldSpec("A_B")])


def test_rules_of_a_layout():
    rules = LAYOUT.rules()
    assert rules[2] == {"field": "AMOUNT", "data_type": "NUMBER", "max_length": 15, "nullable": True}
    assert rules[3]["date_format"] == "yyyyMMdd" and rules[1]["data_type"] == "TEXT"
