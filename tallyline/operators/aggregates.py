"""Grouped and global aggregates, plain or under a condition.

All functions here combine in the map tasks first, so a group that holds much
of the table reaches its reducer as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import ConfigError, UnknownOperation
from tallyline.functions.naming import column_name, hyphen_safe, require_column
from tallyline.operators.filters import EXACT, parse_condition, split_members

# The words for each aggregate.
AGGREGATE_WORDS = {
    "sum": ("sum", "add"),
    "count": ("count", "tallying"),
    "avg": ("avg", "average"),
    "min": ("min",),
    "max": ("max",),
}
_AGGREGATE = {word: name for name, words in AGGREGATE_WORDS.items() for word in words}


def aggregate_column(df: DataFrame, spec: dict) -> Column:
    """One aggregation entry as a column.

    Under a condition a sum counts other rows as 0; avg, min and max leave them
    out. Text columns are summed and averaged as decimals.
    """
    word = str(spec.get("operation") or spec.get("op") or "sum").strip().lower()
    name = _AGGREGATE.get(word)
    if name is None:
        raise UnknownOperation(f"aggregate {word!r}")
    field = spec.get("field") or "*"
    alias = spec.get("alias") or f"{word}_{column_name(field)}"
    test = parse_condition(df, spec["condition"]) if spec.get("condition") else None

    if field == "*":
        if name != "count":
            raise ConfigError(f"{word} needs a field")
        out = F.count(F.lit(1)) if test is None else F.count_if(test)
        return out.alias(alias)

    source = require_column(df.columns, field)
    value = F.col(f"`{source}`")
    if name in ("sum", "avg") and isinstance(df.schema[source].dataType, T.StringType):
        value = value.try_cast(EXACT)
    if name == "count":
        out = F.count(value) if test is None else F.count_if(test)
    elif name == "sum":
        out = F.sum(value if test is None else F.when(test, value).otherwise(F.lit(0)))
    else:
        shown = value if test is None else F.when(test, value)
        out = {"avg": F.avg, "min": F.min, "max": F.max}[name](shown)
    return out.alias(alias)


def aggregate(
    df: DataFrame,
    group_by: Sequence[str] = (),
    aggregations: Sequence[dict] | dict[str, str] = (),
) -> DataFrame:
    """Group and aggregate; without groups one row.

    Aggregations are entries ``{field, operation, alias, condition}``, or a map
    from output name to an SQL aggregate expression. None at all passes the
    rows through.
    """
    if isinstance(aggregations, dict):
        columns = [
            F.expr(hyphen_safe(text, df.columns)).alias(column_name(out))
            for out, text in aggregations.items()
        ]
    else:
        columns = [aggregate_column(df, spec) for spec in aggregations]
    if not columns:
        return df
    keys = [F.col(f"`{require_column(df.columns, k)}`") for k in group_by]
    return df.groupBy(*keys).agg(*columns)


def aggregate_step(df: DataFrame, logic: dict) -> DataFrame:
    """The ``aggregate`` step of a description."""
    return aggregate(df, logic.get("group_by") or [], logic.get("aggregations") or [])


def debit_credit(
    df: DataFrame,
    keys: Sequence[str],
    type_field: str,
    amount_field: str,
    debit: str = "DR",
    credit: str = "CR",
) -> tuple[DataFrame, DataFrame]:
    """Totals per key and the rejected rows.

    Rows whose type is neither debit nor credit are rejected. Net is credit
    minus debit. The type test runs before the shuffle, both sums in one pass.
    """
    valid, rejected = split_members(df, type_field, [debit, credit])
    kind = column_name(type_field)
    totals = aggregate(
        valid,
        keys,
        [
            {"field": amount_field, "op": "sum", "alias": "SUM_TOTAL_DEBIT", "condition": f"{kind} = '{debit}'"},
            {"field": amount_field, "op": "sum", "alias": "SUM_TOTAL_CREDIT", "condition": f"{kind} = '{credit}'"},
        ],
    )
    net = F.col("SUM_TOTAL_CREDIT") - F.col("SUM_TOTAL_DEBIT")
    return totals.withColumn("SUM_NET", net), rejected


def sum_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows with equal keys become one, the named fields added up, in key order."""
    specs = [{"field": f, "op": "sum", "alias": column_name(f)} for f in fields]
    summed = aggregate(df, keys, specs)
    return summed.orderBy(*[F.col(f"`{require_column(summed.columns, k)}`") for k in keys])
