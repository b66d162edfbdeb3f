"""Row filters, and the split of rows into valid and rejected ones."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal, InvalidOperation

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import ConfigError, UnknownOperation
from tallyline.functions.naming import column_name, hyphen_safe, require_column

# The words each comparison may be written as.
OPERATION_WORDS = {
    "==": ("==", "=", "eq", "equal", "equals"),
    "!=": ("!=", "<>", "ne", "not_equal", "not_equals"),
    ">": (">", "gt", "greater", "greater_than"),
    "<": ("<", "lt", "less", "less_than"),
    ">=": (">=", "ge", "gte", "greater_equal"),
    "<=": ("<=", "le", "lte", "less_equal"),
    "in": ("in", "in_list"),
    "not_in": ("not_in", "not_in_list", "nin"),
    "contains": ("contains",),
    "is_null": ("is_null",),
    "is_not_null": ("is_not_null",),
}
_MEANING = {word: name for name, words in OPERATION_WORDS.items() for word in words}


# Numbers in text: 20 digits before the point and 18 after it are kept.
EXACT = "decimal(38,18)"


def _typed_pair(col: Column, dtype: T.DataType, value) -> tuple[Column, Column, bool]:
    """Column and literal in one type, and whether the column had to be cast for it.

    Text compared with a number is read as a number; text that is none becomes
    NULL and so matches nothing. A text literal takes the type of the column.
    """
    if isinstance(value, bool) or value is None:
        return col, F.lit(value), False
    if isinstance(value, (int, float, Decimal)):
        if isinstance(dtype, T.StringType):
            return col.try_cast("double" if isinstance(value, float) else EXACT), F.lit(value), True
        return col, F.lit(value), False
    if isinstance(value, str) and isinstance(dtype, T.NumericType):
        try:
            number = Decimal(value.strip())
        except InvalidOperation:
            return col, F.lit(None).cast(dtype), False
        # A literal of the column's own kind, so that the comparison can reach the scan.
        if isinstance(dtype, (T.FloatType, T.DoubleType)) or not number.is_finite():
            return col, F.lit(float(number)), False
        if isinstance(dtype, T.IntegralType) and number == int(number):
            return col, F.lit(int(number)), False
        return col, F.lit(number), False
    if isinstance(value, str) and not isinstance(dtype, T.StringType):
        return col, F.lit(value).try_cast(dtype), False
    return col, F.lit(value), False


def condition(df: DataFrame, field: str, operation: str = "==", value=None) -> Column:
    """One comparison as a column. NULL fields make it NULL, except for the null tests."""
    name = require_column(df.columns, field)
    col, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    meaning = _MEANING.get(str(operation or "==").strip().lower())
    if meaning is None:
        raise UnknownOperation(f"filter operation {operation!r}")
    if meaning == "is_null":
        return col.isNull()
    if meaning == "is_not_null":
        return col.isNotNull()
    if meaning == "contains":
        return col.cast("string").contains(str(value))
    if meaning in ("in", "not_in"):
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        member = is_member(col, dtype, values)
        return member if meaning == "in" else ~member
    left, right, _ = _typed_pair(col, dtype, value)
    compare = {
        "==": left == right,
        "!=": left != right,
        ">": left > right,
        "<": left < right,
        ">=": left >= right,
        "<=": left <= right,
    }
    return compare[meaning]


def is_member(col: Column, dtype: T.DataType, values: Sequence) -> Column:
    """``col`` in a list of literals given by the description."""
    if not values:
        return F.lit(False)
    pairs = [_typed_pair(col, dtype, v) for v in values]
    if not any(cast for _, _, cast in pairs):
        return col.isin([right for _, right, _ in pairs])
    tests = [left == right for left, right, _ in pairs]
    combined = tests[0]
    for test in tests[1:]:
        combined = combined | test
    return combined


def predicate(df: DataFrame, conditions: Sequence[dict]) -> Column | None:
    """All conditions joined by AND; None when there are none."""
    combined = None
    for c in conditions:
        test = condition(df, c.get("field", ""), c.get("operation") or c.get("op") or "==", c.get("value"))
        combined = test if combined is None else combined & test
    return combined


def filter_rows(df: DataFrame, conditions: Sequence[dict] | str) -> DataFrame:
    """Keep the rows that meet all conditions, or a condition written as SQL."""
    if isinstance(conditions, str):
        return df.filter(F.expr(hyphen_safe(conditions, df.columns))) if conditions.strip() else df
    test = predicate(df, conditions)
    return df if test is None else df.filter(test)


def split_rows(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and all others: a test that is NULL rejects."""
    passes = F.coalesce(test, F.lit(False))
    return df.filter(passes), df.filter(~passes)


def split_members(df: DataFrame, field: str, values: Sequence) -> tuple[DataFrame, DataFrame]:
    """Rows whose field is in the list, and the rest, NULL fields included."""
    name = require_column(df.columns, field)
    return split_rows(df, is_member(F.col(f"`{name}`"), df.schema[name].dataType, list(values)))


_EQUALS = re.compile(r"""^\s*`?([A-Za-z_][\w-]*)`?\s*==?\s*(['"])(.*)\2\s*$""")


def parse_condition(df: DataFrame, text: str) -> Column:
    """The condition of an aggregation: ``FIELD = 'value'``, or any SQL test.

    A text that does not make a column is an error, never "no condition".
    """
    match = _EQUALS.match(text)
    if match and match.group(2) not in match.group(3):
        return condition(df, match.group(1), "==", match.group(3))
    try:
        test = F.expr(hyphen_safe(text, df.columns))
        df.select(test)
    except AnalysisException as problem:
        raise ConfigError(f"condition {text!r} cannot be read: {problem}") from problem
    return test


def filter_step(df: DataFrame, logic: dict) -> DataFrame:
    """The ``filter`` step of a description."""
    if logic.get("else_branch") and isinstance(logic.get("value_list"), list):
        return split_members(df, column_name(logic.get("field", "")), logic["value_list"])[1]
    if isinstance(logic.get("condition"), str):
        return filter_rows(df, logic["condition"])
    return filter_rows(df, logic.get("conditions") or [])
