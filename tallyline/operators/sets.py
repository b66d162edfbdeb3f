"""Sort, union, merge, distinct, and the first few rows by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import ConfigError
from tallyline.functions.naming import require_column
from tallyline.session import staged


def _order(df: DataFrame, key: str | dict | tuple, ascending: bool) -> Column:
    if isinstance(key, dict):
        direction = str(key.get("direction") or ("asc" if ascending else "desc")).lower()
        key, ascending = key.get("column") or key.get("field") or "", not direction.startswith("desc")
    elif isinstance(key, tuple):
        key, ascending = key[0], not str(key[1]).lower().startswith("desc")
    col = F.col(f"`{require_column(df.columns, key)}`")
    return col.asc() if ascending else col.desc()


# Copies of one row that travel as one counted row.
CHUNK = 10_000


def sort_rows(
    df: DataFrame,
    keys: Sequence[str | dict | tuple],
    ascending: bool = True,
    copies: bool = True,
) -> DataFrame:
    """Global order; NULLs come first ascending, last descending.

    A key may carry its own direction. Rows with equal keys are ordered by a
    hash of the row: the result is reproducible, and the range partitioner can
    cut inside a key that holds a large share of the rows. Repeated rows are counted in the map tasks,
    sorted as chunks of counted rows and written out again, so that one row
    that makes up much of the table spreads as well. ``copies=False`` saves that where rows are
    known to differ; rows with maps, which cannot be counted, go without.
    """
    if not keys:
        raise ConfigError("a sort needs at least one key")
    order = [_order(df, key, ascending) for key in keys]
    columns = [F.col(f"`{c}`") for c in df.columns]
    plain = [f.name for f in df.schema.fields if not _holds_map(f.dataType)]
    hashed = [F.col(f"`{n}`") for n in plain]
    if not copies or len(plain) < len(columns):
        return df.orderBy(*order, F.xxhash64(*hashed))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    last = F.floor((F.col("_n") - 1) / CHUNK).cast("bigint")
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    placed = chunks.orderBy(*order, F.xxhash64(*hashed), "_chunk")
    size = F.least(F.lit(CHUNK), F.col("_n") - F.col("_chunk") * CHUNK).cast("int")
    return placed.select(*columns, F.explode(F.array_repeat(F.lit(1), size)).alias("_n")).drop("_n")


def numbered(df: DataFrame, keys: Sequence[str | dict | tuple], name: str, copies: bool = True) -> DataFrame:
    """Add the position of each row in an order, from 1, as column ``name``.

    Rows (without ``copies``, if they are known to differ) are sorted across tasks and written once; those of a range are counted on
    from the rows of the ranges before it. The running total is over one number a range.
    """
    placed = sort_rows(df, keys, copies=copies).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_id"))
    placed = staged(placed, "numbered")
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"), F.min("_id").alias("_low"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("_range", "_low", F.coalesce(before, F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_id") - F.col("_low") + 1
    return placed.join(starts, "_range").select(*[F.col(f"`{c}`") for c in df.columns], position.alias(name))


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(_holds_map(f.dataType) for f in dtype.fields)


def union_all(frames: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """All rows of all frames by column name; columns a frame lacks are NULL."""
    if not frames:
        raise ConfigError("a union needs at least one input")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.distinct() if distinct else rows


def merge_rows(frames: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """A union, in key order when keys are given."""
    rows = union_all(frames)
    return sort_rows(rows, keys) if keys else rows


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def first_rows(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` first rows by key: each task keeps ``n``, no full sort."""
    return df.orderBy(*[F.col(f"`{require_column(df.columns, k)}`") for k in keys]).limit(n)


def sort_step(df: DataFrame, logic: dict) -> DataFrame:
    """The sort of a description: ``key``/``keys`` with one direction, or ``order_by``; ``copies``."""
    if "ascending" in logic:
        ascending = bool(logic["ascending"])
    else:
        ascending = "desc" not in str(logic.get("order") or "asc").lower()
    keys = logic.get("order_by") or logic.get("keys") or logic.get("key") or []
    keys = [keys] if isinstance(keys, (str, dict)) else list(keys)
    return sort_rows(df, keys, ascending, bool(logic.get("copies", True)))
