"""Positional lines: cutting fields out, typing them, and formatting them back.

Everything here is a column expression, so a whole record costs one projection
inside whole-stage codegen.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import UnknownOperation
from tallyline.functions.naming import date_pattern, find_column
from tallyline.sources.layout import INTEGER_WORDS, FieldSpec, Layout


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def cut(line: Column, field: FieldSpec, offset: int = 0) -> Column:
    """The trimmed text of a field; ``offset`` is what the layout counts before this record."""
    return F.trim(F.substring(line, field.start - offset, field.length))


def typed(text: Column, field: FieldSpec) -> Column:
    """Text to the declared type; anything that does not parse is NULL, never an error."""
    kind = field.kind
    if kind == "decimal" and field.precision:
        return implied_decimal(text, field.spark_type)
    if kind == "date":
        return F.try_to_date(text, date_pattern(field.format))
    if kind == "timestamp":
        pattern = date_pattern(field.format, "yyyyMMdd HH:mm:ss")
        return F.try_to_timestamp(text, F.lit(pattern))
    if isinstance(field.spark_type, T.StringType):
        return text
    return text.try_cast(field.spark_type)


def implied_decimal(text: Column, to: T.DecimalType) -> Column:
    """Digits without a point, the last ``scale`` of them after it. Exact."""
    digits = F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast(T.DecimalType(to.precision, 0))
    step = Decimal(1).scaleb(-to.scale)
    return (digits * F.lit(step)).try_cast(to)


def parse_lines(
    lines: DataFrame,
    layout: Layout,
    value: str = "value",
    as_types: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Lines to columns. Fields stay text unless ``as_types``, so rules can see bad values."""
    texts = lines.select(*keep, *[cut(F.col(value), f, layout.offset).alias(f.column) for f in layout])
    if not as_types:
        return texts
    return texts.select(*keep, *[typed(F.col(f"`{f.column}`"), f).alias(f.column) for f in layout])


def cast_fields(df: DataFrame, layout: Layout) -> DataFrame:
    """Give text columns their declared types in one projection; other columns pass."""
    by_column = {f.column.lower(): f for f in layout}
    kept = []
    for name, dtype in df.dtypes:
        f = by_column.get(name.lower().replace("-", "_"))
        if f is None:
            kept.append(F.col(f"`{name}`"))
        elif dtype == "string":
            kept.append(_plain_typed(F.col(f"`{name}`"), f).alias(name))
        else:
            kept.append(F.col(f"`{name}`").try_cast(f.spark_type).alias(name))
    return df.select(*kept)


def _plain_typed(text: Column, field: FieldSpec) -> Column:
    """Like ``typed`` but decimals are written with their point."""
    if field.kind == "decimal":
        return text.try_cast(T.DecimalType(18, field.precision or 4))
    return typed(text, field)


def fit(text: Column, length: int, on_overflow: str, name: str) -> Column:
    """Guard a number that is longer than its field."""
    if on_overflow == "truncate":
        return F.substring(text, 1, length)
    if on_overflow == "error":
        message = F.concat(F.lit(f"value of {name} exceeds {length} characters: "), text)
        return F.when(F.length(text) > length, F.raise_error(message).cast("string")).otherwise(text)
    if on_overflow == "null":
        return F.when(F.length(text) <= length, text)
    raise UnknownOperation(f"on_overflow={on_overflow!r}")


def zero_filled(digits: Column, length: int) -> Column:
    """Zero-pad digit text on the left; a minus sign takes the first position."""
    return F.when(
        digits.startswith("-"),
        F.concat(F.lit("-"), F.lpad(F.substring(digits, F.lit(2), F.length(digits)), length - 1, "0")),
    ).otherwise(F.lpad(digits, length, "0"))


def scaled_digits(value: Column, precision: int, dtype: T.DataType | None = None) -> Column:
    """A number as the digits of value * 10^precision, rounded half up.

    Decimals keep their own width: up to 18 digits Spark computes them as longs.
    """
    factor = F.lit(Decimal(10) ** precision)
    if isinstance(dtype, T.DecimalType) and dtype.precision + precision < 38:
        width = min(38, dtype.precision - dtype.scale + precision + 1)
        return (value * factor).cast(T.DecimalType(width, 0)).cast("string")
    whole = (value.try_cast(T.DecimalType(38 - precision, precision)) * factor).cast(T.DecimalType(38, 0))
    # What no decimal can hold is longer than any field, so that it meets the rule for numbers too long.
    return F.when(value.isNotNull() & whole.isNull(), F.rpad(value.cast("string"), 400, "~")).otherwise(
        whole.cast("string")
    )


def field_text(value: Column, field: FieldSpec, dtype: T.DataType | None = None) -> Column:
    """A value as text, not yet fitted to its length."""
    if field.kind == "decimal" and field.precision:
        return scaled_digits(value, field.precision, dtype)
    if field.is_numeric:
        if field.kind in INTEGER_WORDS and isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
            whole = value.try_cast(T.DecimalType(38, 0)).cast("string")
            return F.when(value.isNotNull() & whole.isNull(), F.rpad(value.cast("string"), 400, "~")).otherwise(whole)
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        default = "yyyyMMdd" if isinstance(dtype, T.DateType) or field.kind == "date" else "yyyyMMddHHmmss"
        return F.date_format(value, date_pattern(field.format, default))
    return value.cast("string")


def fit_field(text: Column, field: FieldSpec, on_overflow: str = "error") -> Column:
    """Text as exactly ``length`` characters; NULL becomes blanks.

    The text is used several times: pass a column, not a long expression.
    """
    n = field.length
    if field.is_numeric:
        piece = fit(text, n, on_overflow, field.name)
        scaled = field.kind == "decimal" and field.precision
        piece = zero_filled(piece, n) if scaled else F.lpad(piece, n, " ")
    elif field.just_right:
        piece = F.lpad(F.substring(text, 1, n), n, " ")
    else:
        piece = F.rpad(text, n, " ")
    return F.coalesce(piece, F.lit(" " * n))


def format_field(
    value: Column, field: FieldSpec, dtype: T.DataType | None = None, on_overflow: str = "error"
) -> Column:
    """A value as exactly ``length`` characters, in one expression."""
    return fit_field(field_text(value, field, dtype), field, on_overflow)


def format_lines(
    df: DataFrame,
    layout: Layout,
    map_by: str = "name",
    on_overflow: str = "error",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows to a ``value`` column of fixed-width lines; fields without a column are blank.

    ``map_by="position"`` takes the columns (without those kept) in order.
    Texts are computed by a projection of their own: fitting looks at them
    more than once, and Spark does not merge projections in that case.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in df.columns if c not in keep]
    sources = {}
    for i, f in enumerate(layout):
        if map_by == "position":
            sources[f.column] = names[i] if i < len(names) else None
        else:
            sources[f.column] = find_column(df.columns, f.name)
    texts = {f.column: f"_text{i}" for i, f in enumerate(layout) if sources[f.column] is not None}
    staged = df.select(
        *keep,
        *[
            field_text(F.col(f"`{sources[f.column]}`"), f, types[sources[f.column]]).alias(texts[f.column])
            for f in layout
            if f.column in texts
        ],
    )
    pieces = []
    for f in layout:
        blank = F.lit(" " * f.length)
        piece = fit_field(F.col(texts[f.column]), f, on_overflow) if f.column in texts else blank
        pieces.append((f.start - layout.offset, f.length, piece))
    line = assemble(pieces)
    if layout.record_length:
        line = F.rpad(line, layout.record_length, " ")
    return staged.select(*keep, line.alias("value"))


def assemble(pieces: list[tuple[int, int, Column]]) -> Column:
    """Pieces ``(start, length, text)`` as one line; gaps are blank, later pieces lie on top."""
    ordered = sorted(pieces, key=lambda p: p[0])
    overlapping = any(a[0] + a[1] > b[0] for a, b in zip(ordered, ordered[1:]))
    if overlapping:
        line = F.lit(" " * max(start + length - 1 for start, length, _ in pieces))
        for start, length, piece in pieces:
            line = F.overlay(line, piece, start, length)
        return line
    parts, cursor = [], 1
    for start, length, piece in ordered:
        if start > cursor:
            parts.append(F.lit(" " * (start - cursor)))
        parts.append(piece)
        cursor = start + length
    return F.concat(*parts) if parts else F.lit("")
