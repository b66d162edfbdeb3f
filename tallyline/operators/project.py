"""Column selection and record-style column arithmetic (the ``select`` step).

A step's expressions may use each other's targets in order, yet a step is one
projection: every new column is composed from columns already built, and only
the last ``select`` touches the frame.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.errors import ConfigError, UnknownColumn
from tallyline.functions.naming import column_name, find_column, hyphen_safe, quoted, require_column

_NUMBER = re.compile(r"^[+-]?\d+(\.\d+)?$")
# Words of a STRING statement that are not operands.
_STRING_WORDS = ("BY", "DELIMITED", "SIZE")


def project(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Select and reorder; ``*`` keeps everything."""
    if columns == "*" or list(columns) == ["*"]:
        return df
    names = [require_column(df.columns, c) for c in columns]
    return df.select(*[F.col(f"`{n}`").alias(column_name(c)) for n, c in zip(names, columns)])


def literal(text: str) -> Column | None:
    """A number or a quoted text as a literal; None for anything else."""
    text = text.strip()
    if _NUMBER.match(text):
        return F.lit(Decimal(text)) if "." in text else F.lit(int(text))
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return F.lit(text[1:-1])
    return None


class _Row:
    """The columns of a row while a step's expressions are applied.

    Plain entries refer to the frame. A target that a later SQL expression
    needs is materialised by one more projection (``settle``); Catalyst merges
    the projections again.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.columns: dict[str, Column] = {c: F.col(quoted(c)) for c in df.columns}
        self.pending: set[str] = set()

    def find(self, name: str) -> str | None:
        return find_column(self.columns, name)

    def get(self, name: str) -> Column:
        return self.columns[require_column(self.columns, name)]

    def operand(self, text: str) -> Column:
        """A literal or a column; an unknown name is an error."""
        value = literal(text)
        return self.get(text) if value is None else value

    def put(self, target: str, value: Column) -> None:
        name = self.find(target) or column_name(target)
        self.columns[name] = value
        self.pending.add(name)

    def settle(self) -> DataFrame:
        if self.pending:
            self.df = self.df.select(*[c.alias(n) for n, c in self.columns.items()])
            self.columns = {c: F.col(quoted(c)) for c in self.df.columns}
            self.pending = set()
        return self.df

    def sql(self, text: str) -> Column:
        """A Spark SQL expression over the current columns; it must resolve."""
        frame = self.settle()
        try:
            value = F.expr(hyphen_safe(text, frame.columns))
            frame.select(value)
        except Exception as problem:
            raise ConfigError(f"expression {text!r} cannot be read: {problem}") from problem
        return value


def _words(text: str, *marks: str) -> list[str]:
    """Operands of a simple expression, which separate at blanks and the given signs."""
    for mark in marks:
        text = text.replace(mark, " ")
    return text.split()


def _start(row: _Row, target: str, default: int) -> Column:
    """The running value of a target; a variable not seen yet has a starting value."""
    name = row.find(target)
    return F.lit(default) if name is None else F.coalesce(row.columns[name], F.lit(default))


def _numeric(row: _Row, text: str, target: str) -> list[Column]:
    """Operands other than the target itself."""
    same = column_name(target).lower()
    words = _words(text, "+", "*")
    return [row.operand(w) for w in words if column_name(w).lower() != same]


def _move(row: _Row, e: dict, target: str, text: str) -> Column:
    if e.get("literal") is True:
        return F.lit(e.get("value", text))
    if not text.strip():
        return F.lit(None).cast("string")
    value = literal(text)
    if value is not None:
        return value
    # A word that names no column is a code such as OK.
    name = row.find(text)
    return F.lit(text.strip()) if name is None else row.columns[name]


def _add(row: _Row, e: dict, target: str, text: str) -> Column:
    total = _start(row, target, 0)
    for value in _numeric(row, text, target):
        total = total + value
    return total


def _subtract(row: _Row, e: dict, target: str, text: str) -> Column:
    return _start(row, target, 0) - row.operand(_first(text))


def _multiply(row: _Row, e: dict, target: str, text: str) -> Column:
    total = _start(row, target, 1)
    for value in _numeric(row, text, target):
        total = total * value
    return total


def _divide(row: _Row, e: dict, target: str, text: str) -> Column:
    return F.try_divide(_start(row, target, 0), row.operand(_first(text)))


def _compute(row: _Row, e: dict, target: str, text: str) -> Column:
    return row.sql(text)


def _initialize(row: _Row, e: dict, target: str, text: str) -> Column:
    return F.lit(e.get("value", 0))


def _string(row: _Row, e: dict, target: str, text: str) -> Column:
    parts = e.get("operands") or re.findall(r"""'[^']*'|"[^"]*"|\S+""", text)
    parts = [p for p in parts if p.upper() not in _STRING_WORDS]
    if not parts:
        raise ConfigError(f"nothing to join for {target!r}")
    return F.concat_ws(e.get("delimiter", ""), *[row.operand(p).cast("string") for p in parts])


def _unstring(row: _Row, e: dict, target: str, text: str) -> Column:
    """The first piece, or with operands ``[field, start, length]`` (start from 0) a substring."""
    operands = e.get("operands")
    if operands:
        source, start, length = operands
        return F.substring(row.get(source), int(start) + 1, int(length))
    return F.split_part(row.get(_first(text)), F.lit(e.get("delimiter") or ","), F.lit(1))


def _inspect(row: _Row, e: dict, target: str, text: str) -> Column:
    """Replace a pattern, or with ``count`` tell how often it occurs."""
    source = row.get(_first(text))
    if e.get("count"):
        return F.regexp_count(source, F.lit(e["count"]))
    return F.regexp_replace(source, F.lit(e.get("before", "")), F.lit(e.get("after", "")))


def _first(text: str, *marks: str) -> str:
    words = _words(text, *marks)
    if not words:
        raise UnknownColumn("an operand is missing")
    return words[0]


OPERATIONS = {
    "move": _move,
    "add": _add,
    "subtract": _subtract,
    "multiply": _multiply,
    "divide": _divide,
    "compute": _compute,
    "initialize": _initialize,
    "string": _string,
    "unstring": _unstring,
    "inspect": _inspect,
}


def compute(df: DataFrame, expressions: Sequence[dict]) -> DataFrame:
    """Apply expressions ``{target, expression, operation, …}`` in order, row by row.

    An operation without a name of its own is a Spark SQL expression. With
    ``rounded`` the result is rounded half up to ``precision`` digits.
    """
    row = _Row(df)
    for e in expressions:
        target = e.get("target") or e.get("output_field") or ""
        if not target.strip():
            raise ConfigError(f"expression without target: {e}")
        word = str(e.get("operation") or e.get("op") or "move").strip().lower()
        build = OPERATIONS.get(word, _compute)
        value = build(row, e, target, str(e.get("expression") or ""))
        if e.get("rounded"):
            value = F.round(value, int(e.get("precision") or 0))
        row.put(target, value)
    return row.settle()


def with_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add or replace one column by a Spark SQL expression."""
    return compute(df, [{"target": name, "operation": "compute", "expression": expression}])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[require_column(df.columns, c) for c in columns])


def select_step(df: DataFrame, logic: dict) -> DataFrame:
    """The ``select`` step of a description."""
    columns, expressions = logic.get("columns"), logic.get("expressions")
    if columns and expressions:
        raise ConfigError("a select step has either columns or expressions")
    if columns:
        return project(df, columns)
    return compute(df, expressions or [])
