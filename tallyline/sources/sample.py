"""Sample rows from field definitions, one per row of a given frame.

Each type has a generator that makes a value from the row's number; names of fields play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.naming import date_pattern
from tallyline.sources.layout import FieldSpec, Layout

# Days before the run date that sample dates go through before they repeat.
DAYS = 365
_Generator = Callable[[FieldSpec, Column, date], Column]


def _digits(f: FieldSpec, index: Column, run_date: date) -> Column:
    """The row's number from 1, in hundreds where the field has decimals; no longer than the field."""
    number = (index + 1) * (100 if f.precision else 1)
    width = f.length or 10
    return F.lpad(F.pmod(number, F.lit(10 ** min(width, 18))).cast("string"), width, "0")


def _day(f: FieldSpec, index: Column, run_date: date) -> Column:
    day = F.date_sub(F.lit(run_date), F.pmod(index, F.lit(DAYS)).cast("int"))
    return F.date_format(day, date_pattern(f.format, "yyyyMMdd"))


def _moment(f: FieldSpec, index: Column, run_date: date) -> Column:
    second = F.timestamp_seconds(F.unix_seconds(F.lit(run_date).cast("timestamp")) - F.pmod(index, F.lit(86_400 * DAYS)))
    return F.date_format(second, date_pattern(f.format, "yyyyMMddHHmmss"))


def _flag(f: FieldSpec, index: Column, run_date: date) -> Column:
    return F.when(F.pmod(index, F.lit(2)) == 0, "true").otherwise("false")


def _letters(f: FieldSpec, index: Column, run_date: date) -> Column:
    """The row's number in letters, A to Z and then AA on, filled with blanks; the last letters if it is too long."""
    base = F.translate(F.conv((index + 1).cast("string"), 10, 26), "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    width = f.length or 10
    return F.rpad(F.right(base, F.lit(width)), width, " ")


GENERATORS: dict[str, _Generator] = {"date": _day, "timestamp": _moment, "boolean": _flag}


def sample_value(field: FieldSpec, index: Column, run_date: date) -> Column:
    """A value for the row with the given 0-based index."""
    fallback = _digits if field.is_numeric else _letters
    return GENERATORS.get(field.kind, fallback)(field, index, run_date)


def sample_rows(spark: SparkSession, layout: Layout, rows: int, run_date: date) -> DataFrame:
    """``rows`` sample rows, generated in parallel."""
    return sample_over(spark.range(rows), "id", layout, run_date)


def sample_over(frame: DataFrame, index: str, layout: Layout, run_date: date) -> DataFrame:
    """A sample row for every row of ``frame``, numbered by its column ``index``."""
    at = F.col(index).cast("bigint")
    return frame.select(*[sample_value(f, at, run_date).alias(f.column) for f in layout.data_fields()])
