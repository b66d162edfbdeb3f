"""Control records: one summary row per data set, and its positional text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import ConfigError
from tallyline.functions.dates import on_run_date
from tallyline.functions.fixed import assemble, fit, zero_filled
from tallyline.functions.naming import column_name, date_pattern, find_column, hyphen_safe, quoted
from tallyline.sources.layout import INTEGER_WORDS

# Field lengths when none is declared.
NUMBER_LENGTH, TEXT_LENGTH = 15, 20
# Other shapes a header date may have.
_DATE_PATTERNS = ("yyyyMMdd", "yyyy-MM-dd", "MM/dd/yyyy")

_HEADER_DATE = re.compile(
    r"to_date\s*\(\s*(?:first\s*\(\s*)?`?([\w-]+)`?\s*\)?\s*,\s*'([^']*)'\s*\)", re.IGNORECASE
)
_HEADER_FIRST = re.compile(r"^first\s*\(\s*`?([\w-]+)`?\s*\)$", re.IGNORECASE)


@dataclass(frozen=True)
class ControlField:
    """One field of a control record."""

    name: str
    type: str = "STRING"
    expression: str = ""
    length: int = 0
    begin: int = 0
    format: str = ""
    just_right: bool = False

    @classmethod
    def parse(cls, entry: dict) -> ControlField:
        return cls(
            name=(entry.get("name") or "").strip(),
            type=(entry.get("type") or "STRING").strip(),
            expression=(entry.get("expression") or "").strip(),
            length=int(entry.get("length") or 0),
            begin=int(entry.get("begin") or entry.get("start") or 0),
            format=(entry.get("format") or "").strip(),
            just_right=bool(entry.get("just_right", False)),
        )

    @property
    def column(self) -> str:
        return column_name(self.name)

    @property
    def is_integer(self) -> bool:
        return self.type.lower() in INTEGER_WORDS

    @property
    def size(self) -> int:
        return self.length or (NUMBER_LENGTH if self.is_integer else TEXT_LENGTH)

    @property
    def sql(self) -> str:
        """The expression, or the default: a count for whole numbers, blank for the rest."""
        return self.expression or ("count(*)" if self.is_integer else "''")


def control_fields(entries: Sequence[dict | ControlField]) -> list[ControlField]:
    fields = [e if isinstance(e, ControlField) else ControlField.parse(e) for e in entries]
    fields = [f for f in fields if f.name]
    if not fields:
        raise ConfigError("a control record needs at least one named field")
    return fields


def control_row(
    df: DataFrame,
    fields: Sequence[dict | ControlField],
    header: DataFrame | None = None,
    run_date: date | None = None,
) -> DataFrame:
    """All fields of the control record in one aggregation, one row.

    ``header`` is the one-row frame of header fields. Dates of the form
    ``to_date(first(FIELD), 'F')``, also inside ``last_day``, and ``first(FIELD)``
    take the field from it when the data has no such column.
    """
    specs = control_fields(fields)
    sums: list[Column] = []
    shown: list[Column] = []
    for f in specs:
        looked_up = _from_header(df, f.sql, header)
        if looked_up is None:
            sql = on_run_date(hyphen_safe(f.sql, df.columns), run_date)
            sums.append(F.expr(sql).alias(f.column))
            shown.append(F.col(quoted(f.column)))
        else:
            shown.append(looked_up.alias(f.column))
    row = df.agg(*sums) if sums else df.sparkSession.range(1)
    return row.select(*shown)


def _from_header(df: DataFrame, sql: str, header: DataFrame | None) -> Column | None:
    """A header field as a scalar of its one-row frame, as text."""
    if header is None:
        return None
    plain = _HEADER_FIRST.match(sql)
    dated = _HEADER_DATE.search(sql)
    name = (plain or dated).group(1) if plain or dated else None
    if name is None or find_column(df.columns, name) is not None:
        return None
    column = find_column(header.columns, name)
    if column is None:
        raise ConfigError(f"{sql!r}: no header field {name!r}")
    raw = F.trim(F.col(quoted(column)))
    if dated is None:
        value = raw
    else:
        pattern = date_pattern(dated.group(2))
        day = F.coalesce(*[F.try_to_date(raw, p) for p in dict.fromkeys((pattern, *_DATE_PATTERNS))])
        if re.search(r"last_day\s*\(", sql, re.IGNORECASE):
            day = F.last_day(day)
        # A text that is no date is passed on as it stands.
        value = F.coalesce(F.date_format(day, pattern), raw)
    found = header.select(value.alias("v"))
    differ = F.raise_error(F.lit(f"{sql}: the headers of several files differ")).cast("string")
    one = found.agg(F.when(F.min("v") != F.max("v"), differ).otherwise(F.max("v")).alias("v"))
    return F.coalesce(one.scalar(), F.lit(""))


def control_piece(value: Column, f: ControlField, dtype: T.DataType, on_overflow: str = "error") -> Column:
    """A control value as exactly ``size`` characters."""
    n, kind = f.size, f.type.upper()
    text = value.cast("string")
    temporal = isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if f.is_integer:
        whole = F.coalesce(F.split_part(F.trim(text), F.lit("."), F.lit(1)), F.lit(""))
        return zero_filled(fit(whole, n, on_overflow, f.name), n)
    if kind in ("DOUBLE", "FLOAT", "DECIMAL", "NUMBER"):
        return F.lpad(fit(F.coalesce(text, F.lit("")), n, on_overflow, f.name), n, " ")
    if temporal and (kind in ("DATE", "TIMESTAMP") or f.format):
        default = "yyyyMMddHHmmss" if kind == "TIMESTAMP" else "yyyyMMdd"
        text = F.date_format(value, date_pattern(f.format, default))
    text = F.substring(F.coalesce(text, F.lit("")), 1, n)
    return F.lpad(text, n, " ") if f.just_right and kind not in ("DATE", "TIMESTAMP") else F.rpad(text, n, " ")


def _placed(fields: Sequence[ControlField], pieces: Sequence[Column]) -> Column:
    """Pieces at their declared positions; those without one follow each other from the start."""
    out, cursor = [], 1
    for f, piece in zip(fields, pieces):
        out.append((f.begin or cursor, f.size, piece))
        if not f.begin:
            cursor += f.size
    return assemble(out)


def control_lines(
    row: DataFrame,
    fields: Sequence[dict | ControlField],
    names: bool = False,
    on_overflow: str = "error",
) -> DataFrame:
    """The control row as a text line, with ``names`` after a line of field names."""
    specs = control_fields(fields)
    types = {f.name: f.dataType for f in row.schema.fields}
    pieces = [control_piece(F.col(quoted(f.column)), f, types[f.column], on_overflow) for f in specs]
    lines = [_placed(specs, pieces)]
    if names:
        titles = [F.lit(f.name[: f.size].ljust(f.size)) for f in specs]
        lines.insert(0, _placed(specs, titles))
    return row.select(F.explode(F.array(*lines)).alias("value"))


def control_file(
    df: DataFrame,
    fields: Sequence[dict | ControlField],
    header: DataFrame | None = None,
    names: bool = False,
    run_date: date | None = None,
) -> DataFrame:
    """Control row and text in one go."""
    return control_lines(control_row(df, fields, header, run_date), fields, names)


def read_control_lines(lines: DataFrame, fields: Sequence[dict | ControlField]) -> DataFrame:
    """Control text back to columns: whole numbers lose their leading zeros."""
    out, cursor = [], 1
    for f in control_fields(fields):
        text = F.trim(F.substring("value", f.begin or cursor, f.size))
        if f.is_integer:
            text = F.when(text.rlike(r"^\d+$"), text.try_cast("decimal(38,0)").cast("string")).otherwise(text)
        out.append(text.alias(f.column))
        if not f.begin:
            cursor += f.size
    return lines.select(*out)
