"""Equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.errors import ConfigError, UnknownOperation
from tallyline.functions.naming import require_column
from tallyline.session import staged

# The words for each kind of join.
HOW_WORDS = {
    "inner": ("inner",),
    "left": ("left", "left_outer", "leftouter"),
    "right": ("right", "right_outer", "rightouter"),
    "full": ("full", "outer", "full_outer", "fullouter"),
    "left_semi": ("left_semi", "semi", "leftsemi"),
    "left_anti": ("left_anti", "anti", "leftanti"),
}
_HOW = {word: how for how, words in HOW_WORDS.items() for word in words}

Key = str | Sequence[str]


def join_on(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[Key],
    how: str = "inner",
    skewed: bool | None = None,
    tables: Sequence[str] = (),
) -> DataFrame:
    """Join on equal keys; NULL keys never match.

    A key is a name both sides have, or a pair ``(left, right)``. A shared
    name comes out once, filled from whichever side has the row; pairs keep
    both columns. The physical join (broadcast by measured size, or
    sort-merge with skewed partitions split at run time) is Spark's choice.

    Spark splits a frequent key on both sides of an inner join, only on the
    kept side of a left or right join, and not at all in a full join. With
    ``skewed`` an outer join is built from joins that can be split; by default only the full join is.
    These read a side twice: unless ``tables`` names it (``left``, ``right``) as a table that is read as it lies, with
    at most columns computed and rows dropped, it is evaluated once and written to the shared folder first.
    """
    kind = _HOW.get(how.strip().lower())
    if kind is None:
        raise UnknownOperation(f"join type {how!r}")
    if not on:
        raise ConfigError("a join needs at least one key; products of two tables are not built")
    pairs = []
    for key in on:
        names = (key, key) if isinstance(key, str) else tuple(key)[:2]
        pairs.append((require_column(left.columns, names[0]), require_column(right.columns, names[1])))
    if kind in ("left", "right", "full") and (kind == "full" if skewed is None else skewed):
        sides = {"left": left, "right": right}
        once = [df if side in tables else staged(df, "side") for side, df in sides.items()]
        return _outer(*once, pairs, kind)
    return _join(left, right, pairs, kind)


def _join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], kind: str) -> DataFrame:
    if kind in ("left_semi", "left_anti"):
        # Only whether a key is there matters: copies are dropped in the map tasks.
        right = right.select(*dict.fromkeys(b for _, b in pairs)).distinct()
    l, r = left.alias("l"), right.alias("r")
    test = _all(F.col(f"l.`{a}`") == F.col(f"r.`{b}`") for a, b in pairs)
    joined = l.join(r, test, kind)
    if kind in ("left_semi", "left_anti"):
        return joined.select(*[F.col(f"l.`{c}`").alias(c) for c in left.columns])
    shared = {a for a, b in pairs if a == b}
    out = []
    for c in left.columns:
        value = F.col(f"l.`{c}`")
        if c in shared and kind in ("right", "full"):
            # Where only the right side has a row its key is the one to show.
            value = F.coalesce(value, F.col(f"r.`{c}`"))
        out.append(value.alias(c))
    out += [F.col(f"r.`{c}`").alias(c) for c in right.columns if c not in shared]
    return joined.select(*out)


def _outer(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], kind: str) -> DataFrame:
    """An outer join as the matching rows, and the rows of each kept side without a partner."""
    shared = {a for a, b in pairs if a == b}
    rows = _join(left, right, pairs, "inner")
    added = [f for f in right.schema.fields if f.name not in shared]

    def null(field) -> Column:
        return F.lit(None).cast(field.dataType).alias(field.name)

    if kind in ("left", "full"):
        alone = _join(left, right, pairs, "left_anti")
        rows = rows.union(alone.select("*", *[null(f) for f in added]))
    if kind in ("right", "full"):
        alone = _join(right, left, [(b, a) for a, b in pairs], "left_anti")
        keys = [F.col(f"`{f.name}`") if f.name in shared else null(f) for f in left.schema.fields]
        rows = rows.union(alone.select(*keys, *[F.col(f"`{f.name}`") for f in added]))
    return rows


def _all(tests) -> Column:
    combined = None
    for test in tests:
        combined = test if combined is None else combined & test
    return combined


def join_chain(start: DataFrame, *links: tuple[DataFrame, Sequence[Key], str]) -> DataFrame:
    """Joins one after the other: ``(frame, keys, how)`` each."""
    for frame, on, how in links:
        start = join_on(start, frame, on, how)
    return start
