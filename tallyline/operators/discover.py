"""Find the key of a table, and which columns of two tables are the same under other names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import ConfigError
from tallyline.functions.naming import quoted
from tallyline.operators.pairing import assign
from tallyline.operators.reconcile import match_columns, normal_rows
from tallyline.session import staged

# Column sets whose distinct values are estimated in one pass, the estimate's deviation, and how far below
# the number of rows an estimate may be for a set that could still be a key.
SETS, DEVIATION, SLACK = 48, 0.02, 0.9
# Parts of a column's sketch, the least likeness of a match, and how far ahead of the next best it has to be.
PARTS, ALIKE, AHEAD = 256, 0.5, 0.05


def find_key(frame: DataFrame, columns: Sequence[str] | None = None, most: int = 3) -> list[str]:
    """The fewest columns that tell different rows apart, at most ``most``; of several such sets the one of foremost columns.

    Sets grow column by column. One is only looked at if its columns' distinct values could make up the rows
    (their product bounds the set's) and no part of it is known to be a key. Estimates of ``SETS`` sets come from one pass; a
    set that comes near the number of different rows is checked exactly: no value of it may have two of them. If no set
    does, the best estimated one is returned. Copies of whole rows don't matter. NULL is a value. Columns of approximate
    numbers come last, maps are not compared.
    """
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    names = [c for c in (columns or frame.columns) if not isinstance(kinds[c], (T.MapType, T.VariantType))]
    if not names:
        raise ConfigError("a key needs a column")
    place = {c: k + len(names) * isinstance(kinds[c], (T.FloatType, T.DoubleType)) for k, c in enumerate(names)}
    comparable = [f.name for f in frame.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    whole = F.xxhash64(*[x for c in comparable for x in (F.col(quoted(c)), F.col(quoted(c)).isNull())])
    rows = frame.agg(F.approx_count_distinct(whole, DEVIATION)).first()[0]
    # A hash passes over NULL, so each column goes with whether it is there.
    estimate = lambda s: F.approx_count_distinct(F.xxhash64(*[x for c in s for x in (F.col(quoted(c)), F.col(quoted(c)).isNull())]), DEVIATION)
    known: dict[tuple[str, ...], float] = {}
    for size in range(1, min(most, len(names)) + 1):
        bound = lambda s: np.prod([known[(c,)] for c in s])
        sets = [s for s in combinations(names, size) if size == 1 or (bound(s) >= SLACK * rows and min(known[(c,)] for c in s) > 1)]
        for at in range(0, len(sets), SETS):
            part = sets[at : at + SETS]
            found = frame.agg(*[estimate(s).alias(str(k)) for k, s in enumerate(part)]).first()
            known.update({s: float(found[k]) for k, s in enumerate(part)})
        likely = sorted((s for s in sets if known[s] >= SLACK * rows), key=lambda s: (sum(place[c] for c in s), s))
        for s in likely:
            told = frame.groupBy(*[F.col(quoted(c)) for c in s]).agg(F.min(whole).alias("_first"), F.max(whole).alias("_last"))
            if told.filter("_first <> _last").isEmpty():
                return list(s)
    return list(max(known, key=lambda s: (known[s], -len(s), -sum(place[c] for c in s))))


def column_sketches(frame: DataFrame, columns: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each column the least hash of its values in each of ``PARTS`` parts, and the share of rows in each part.

    The values are compared as text, as in a reconciliation. One pass; the tasks hand on a row a column and part.
    """
    texts = normal_rows(frame, {c: c for c in columns})
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(F.col(quoted(c))).alias("h")) for k, c in enumerate(columns)]))
    part = F.pmod(F.col("c.h"), F.lit(PARTS)).cast("int")
    least = texts.select(cells.alias("c")).groupBy(F.col("c.k").alias("k"), part.alias("part")).agg(F.min("c.h").alias("h"), F.count(F.lit(1)).alias("n"))
    marks = np.zeros((len(columns), PARTS), np.int64)
    share = np.zeros((len(columns), PARTS))
    for r in least.collect():
        marks[r.k, r.part], share[r.k, r.part] = r.h, r.n
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1)
    return {c: (marks[k], share[k]) for k, c in enumerate(columns)}


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Half the estimated overlap of two columns' distinct values, half that of how often they occur."""
    held = (a[1] > 0) | (b[1] > 0)
    same = ((a[0] == b[0]) & (a[1] > 0) & (b[1] > 0)).sum() / max(1, held.sum())
    return float(0.5 * same + 0.5 * np.minimum(a[1], b[1]).sum())


def match_by_content(
    expected: DataFrame, produced: DataFrame, mapping: Mapping[str, str] | None = None, by_name: bool = True
) -> dict[str, str | None]:
    """The produced column of each expected one: given, of the same name, or else of the most similar values.

    Columns without a partner by name are sketched in one pass over each table and assigned to each other for
    the greatest total likeness. An expected column without a likeness of ``ALIKE`` has no partner. If another
    free column is as similar, but for ``AHEAD``, that is an error, which an entry of the mapping settles.
    """
    given = dict(mapping or {})
    if by_name:
        matched = match_columns(expected.columns, produced.columns, given)
    else:
        known = match_columns(list(given), produced.columns, given)
        matched = {c: known.get(c) for c in expected.columns}
    open_e = [c for c, other in matched.items() if other is None]
    open_g = [c for c in produced.columns if c not in matched.values()]
    if not open_e or not open_g:
        return matched
    left, right = column_sketches(expected, open_e), column_sketches(produced, open_g)
    like = np.array([[likeness(left[e], right[g]) for g in open_g] for e in open_e])
    for i, j in assign(-like):
        if like[i, j] < ALIKE:
            continue
        # A second column on either side that would do as well.
        others = [open_g[k] for k in range(len(open_g)) if k != j and like[i, k] > like[i, j] - AHEAD]
        rivals = [open_e[k] for k in range(len(open_e)) if k != i and like[k, j] > like[i, j] - AHEAD]
        if others or rivals:
            raise ConfigError(f"{open_e[i]!r} could be any of {[open_g[j], *others]}, and {open_g[j]!r} any of {[open_e[i], *rivals]}")
        matched[open_e[i]] = open_g[j]
    return matched


def matches_of(frame: DataFrame, matched: Mapping[str, str | None]) -> DataFrame:
    """The matching as a table: ``expected`` and ``generated`` column, and the produced table's distinct values in it."""
    pairs = [(e, g) for e, g in matched.items() if g is not None]
    counts = frame.agg(*[F.count_distinct(F.col(quoted(g))).alias(str(k)) for k, (_, g) in enumerate(pairs)])
    told = F.array(*[F.struct(F.lit(e).alias("expected"), F.lit(g).alias("generated"), F.col(str(k)).alias("n_values")) for k, (e, g) in enumerate(pairs)])
    return staged(counts, "matches").select(F.explode(told).alias("m")).select("m.*")
