"""Row validation: rules compile to message columns, evaluated in one projection.

A row is valid when no rule has a message for it. Blank text counts as missing
everywhere: only the not-null rule objects to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import ConfigError, UnknownColumn, UnknownOperation
from tallyline.functions.fixed import is_blank
from tallyline.functions.naming import column_name, date_pattern, find_column
from tallyline.operators.filters import is_member
from tallyline.sources.readers import RAW

ERRORS, VALID = "_validation_errors", "_is_valid"

# Named text formats and their patterns.
FORMAT_PATTERNS = {
    "alpha": r"^[A-Za-z\s]+$",
    "numeric": r"^\d+(\.\d+)?$",
    "alphanumeric": r"^[A-Za-z0-9\s]+$",
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
}
# Numeric rule types and the Spark type a value must parse as.
NUMBER_TYPES = {
    "int": "int",
    "integer": "int",
    "long": "bigint",
    "bigint": "bigint",
    "double": "double",
    "float": "float",
    "decimal": "decimal",
    "number": "decimal",
}
# Digits with at most one point and a sign; casts alone would take NaN, 12D and 12f for numbers.
_DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)$"
_FLOAT_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_MODES = {"FLAG": "FLAG", "FLAGGED": "FLAG", "DROP": "DROP", "ABORT": "ABORT"}

# What is said about a field that fails.
SAYS = {
    "missing": "must not be null or empty",
    "number": "is not a valid {kind}",
    "date": "is not a valid date (expected: {pattern})",
    "timestamp": "is not a valid timestamp (expected: {pattern})",
    "length": "exceeds max length {limit}",
    "date_format": "does not match date format '{pattern}'",
    "pattern": "does not match pattern '{pattern}'",
    "format": "is not a valid {form} value",
    "list": "is not in the list",
    "range": "is not in the range {bounds}",
    "size": "does not have a length in the range {bounds}",
}


@dataclass(frozen=True)
class Check:
    """A failed test and what to say about it."""

    failed: Column
    message: str
    code: str


@dataclass(frozen=True)
class Subject:
    """The field a rule looks at: as a column, as the text it came from, and what the rule says."""

    rule: dict
    name: str
    column: Column
    text: Column
    dtype: T.DataType

    @property
    def given(self) -> Column:
        """Blank text counts as missing, which only the not-null rule objects to."""
        return ~is_blank(self.text)

    def fails(self, test: Column, says: str, **words) -> Check:
        message = f"'{self.name}' {SAYS[says].format(**words)}"
        return Check(test, message, self.rule.get("code") or "E001")

    def unless(self, passes: Column, says: str, **words) -> Check:
        """Fails where a value is given that does not pass."""
        return self.fails(self.given & ~F.coalesce(passes, F.lit(False)), says, **words)


def _subject(df: DataFrame, rule: dict, column: str) -> Subject:
    col = F.col(f"`{column}`")
    kept = RAW + column
    text = F.col(f"`{kept}`") if kept in df.columns else col.cast("string")
    return Subject(rule, column_name(rule["field"]), col, text, df.schema[column].dataType)


def _is_number(text: Column, kind: str) -> Column:
    value = F.trim(text)
    if kind == "decimal":
        return value.rlike(_DECIMAL_TEXT)
    if kind in ("double", "float"):
        return value.rlike(_FLOAT_TEXT) & value.try_cast(kind).isNotNull()
    return value.try_cast(kind).isNotNull()


def _number_type(kind: str) -> Callable[[Subject], Check]:
    return lambda s: s.unless(_is_number(s.text, NUMBER_TYPES[kind]), "number", kind=kind)


def _date_type(s: Subject, says: str = "date", *keys: str) -> Check:
    pattern = next((s.rule[k] for k in ("date_format", *keys) if s.rule.get(k)), "yyyyMMdd")
    return s.unless(F.try_to_date(s.text, date_pattern(pattern)).isNotNull(), says, pattern=pattern)


def _timestamp_type(s: Subject) -> Check:
    pattern = s.rule.get("date_format") or "yyyyMMdd HH:mm:ss"
    parsed = F.try_to_timestamp(s.text, F.lit(date_pattern(pattern)))
    return s.unless(parsed.isNotNull(), "timestamp", pattern=pattern)


def _matching(s: Subject, pattern: str) -> Check | None:
    return s.unless(s.text.rlike(pattern), "pattern", pattern=pattern) if pattern else None


def _named_format(form: str) -> Callable[[Subject], Check]:
    return lambda s: s.unless(s.text.rlike(FORMAT_PATTERNS[form]), "format", form=form)


def _in_list(s: Subject) -> Check:
    values = list((s.rule.get("params") or {}).get("values") or [])
    return s.unless(is_member(s.column, s.dtype, values), "list")


def _between(s: Subject, measured: Column, says: str) -> Check:
    params = s.rule.get("params") or {}
    low, high = params.get("min"), params.get("max")
    inside = measured.isNotNull()
    if low is not None:
        inside = inside & (measured >= F.lit(float(low)))
    if high is not None:
        inside = inside & (measured <= F.lit(float(high)))
    shown = f"{'' if low is None else low}..{'' if high is None else high}"
    return s.unless(inside, says, bounds=shown)


def _in_range(s: Subject) -> Check:
    text = F.trim(s.column.cast("string"))
    return _between(s, F.when(_is_number(text, "double"), text).try_cast("double"), "range")


_Builder = Callable[[Subject], "Check | None"]
# What each word of a rule asks for. A word that asks for nothing has None.
_BY_TYPE: dict[str, _Builder | None] = {
    **dict.fromkeys(("string", "str", "text", ""), None),
    **{kind: _number_type(kind) for kind in NUMBER_TYPES},
    "date": _date_type,
    "timestamp": _timestamp_type,
}
_BY_FORMAT: dict[str, _Builder | None] = {
    "any": None,
    "date": lambda s: _date_type(s, "date_format", "pattern"),
    "regex": lambda s: _matching(s, s.rule.get("pattern") or ""),
    **{form: _named_format(form) for form in FORMAT_PATTERNS},
}
_BY_CHECK: dict[str, _Builder | None] = {
    "": None,
    "not_null": lambda s: s.fails(~s.given, "missing"),
    "regex": lambda s: _matching(s, (s.rule.get("params") or {}).get("pattern") or s.rule.get("pattern") or ""),
    "in_list": _in_list,
    "in_range": _in_range,
    "length": lambda s: _between(s, F.length(s.text).cast("double"), "size"),
}


def _builder(table: dict[str, _Builder | None], word: str, what: str, field: str) -> _Builder | None:
    if word not in table:
        raise UnknownOperation(f"rule {what} {word!r} of {field}")
    return table[word]


def _checks(df: DataFrame, rule: dict, column: str) -> list[Check]:
    """The checks of one rule: presence, type, length, format, named check."""
    s = _subject(df, rule, column)
    word = lambda key, default: str(rule.get(key) or default).lower()
    parts = [
        None if rule.get("nullable", True) else _BY_CHECK["not_null"],
        _builder(_BY_TYPE, word("data_type", "string"), "type", s.name),
        None if rule.get("max_length") in (None, "") else _max_length,
        _builder(_BY_FORMAT, word("format", "any"), "format", s.name),
        _builder(_BY_CHECK, word("check", ""), "check", s.name),
    ]
    found = [part(s) for part in parts if part is not None]
    return [check for check in found if check is not None]


def _max_length(s: Subject) -> Check:
    limit = int(s.rule["max_length"])
    return s.fails(F.coalesce(F.length(s.text) > limit, F.lit(False)), "length", limit=limit)


def compile_rules(df: DataFrame, rules: Sequence[dict], on_missing: str = "raise") -> list[Check]:
    """All checks of all rules, in order. A rule for an absent field raises, or is skipped."""
    if on_missing not in ("raise", "skip"):
        raise ConfigError(f"on_missing={on_missing!r}")
    checks: list[Check] = []
    for rule in rules:
        if not rule.get("field"):
            raise ConfigError(f"rule without field: {rule}")
        column = find_column(df.columns, rule["field"])
        if column is None:
            if on_missing == "skip":
                continue
            raise UnknownColumn(f"rule for {rule['field']!r}, columns are {df.columns}")
        checks += _checks(df, rule, column)
    return checks


def messages(checks: Sequence[Check]) -> Column:
    """All messages of a row joined by '; ', empty for a valid row."""
    if not checks:
        return F.lit("")
    return F.concat_ws("; ", *[F.when(c.failed, F.lit(c.message)) for c in checks])


def passes(checks: Sequence[Check]) -> Column:
    """True when no check failed. Never NULL."""
    bad = F.lit(False)
    for c in checks:
        bad = bad | c.failed
    return ~F.coalesce(bad, F.lit(False))


def _told(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Every row with its messages, worked out once.

    They come out of a generator of one value, which the optimiser neither repeats in
    the filters behind it nor merges with them.
    """
    return df.select("*", F.explode(F.array(messages(checks))).alias(ERRORS))


def annotate(df: DataFrame, rules: Sequence[dict], on_missing: str = "raise") -> DataFrame:
    """Add the messages and the verdict to every row."""
    told = _told(df, compile_rules(df, rules, on_missing))
    return told.select("*", (F.col(ERRORS) == "").alias(VALID))


def split_valid(
    df: DataFrame, rules: Sequence[dict], on_missing: str = "raise"
) -> tuple[DataFrame, DataFrame]:
    """Valid rows as they came, and the others with their messages."""
    checks = compile_rules(df, rules, on_missing)
    bad = _told(df, checks).filter(F.col(ERRORS) != "").select("*", F.lit(False).alias(VALID))
    return df.filter(passes(checks)), bad


def fail_mode(word: str | None) -> str:
    """FLAG, DROP or ABORT."""
    mode = _MODES.get((word or "FLAG").strip().upper())
    if mode is None:
        raise UnknownOperation(f"fail mode {word!r}")
    return mode


def shape(df: DataFrame, rules: Sequence[dict], mode: str = "FLAG", on_missing: str = "raise") -> DataFrame:
    """What a step hands on: all rows annotated (FLAG), valid rows (DROP), rows as they came (ABORT)."""
    mode = fail_mode(mode)
    if mode == "FLAG":
        return annotate(df, rules, on_missing)
    if mode == "DROP":
        return df.filter(passes(compile_rules(df, rules, on_missing)))
    return df


def enrich(
    df: DataFrame,
    rules: Sequence[dict],
    run_time: datetime,
    flag: str = "VAL_FLAG",
    stamp: str = "PROC_TS",
    code: str = "ERR_CODE",
) -> DataFrame:
    """Add the columns of an output record: Y/N, processing time, code of the first failed rule."""
    checks = compile_rules(df, rules)
    first = F.coalesce(*[F.when(c.failed, F.lit(c.code)) for c in checks], F.lit("0000"))
    return df.select(
        "*",
        F.when(passes(checks), "Y").otherwise("N").alias(flag),
        F.lit(f"{run_time:%Y%m%d%H%M%S}").alias(stamp),
        first.alias(code),
    )
