"""Compare the rows of two ordered tables without a key, past rows that are missing or added.

Rows whose content occurs once on each side are anchors; of these the longest chain that rises on both sides
stays. What lies between two anchors is a gap. In a gap the n-th copies of equal content are
anchors as well, and only what is left of a gap on both sides is aligned row by row.

Positions, anchors and gaps are numbered by range, so no task holds more than ``BUCKET`` rows of a table however
large a gap or a group of copies is. One task sees the runs of anchors, at most ``CHAIN`` of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.errors import ConfigError
from tallyline.functions.naming import quoted
from tallyline.operators.reconcile import match_columns, normal_rows
from tallyline.operators.sets import numbered
from tallyline.session import staged

# Runs of anchors that one task may chain, and rounds that thin out more of them range by range.
CHAIN, THINNING = 1 << 18, 4
# Positions that are numbered together, and positions of a piece of a run.
BUCKET, PIECE = 100_000, 1_024
# Rows of a gap on either side that are aligned by their cells; longer gaps are paired in order.
GAP_ROWS = 128


def heaviest_chain(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the members, ordered by ``first``, that rise in ``second`` and weigh most together.

    Best chains by their last ``second`` form a staircase: a later step is heavier. Each member goes on from the
    heaviest chain below it and removes the steps that it makes useless.
    """
    order = np.argsort(first, kind="stable")
    ends: list[int] = []
    heaviest: list[int] = []
    members: list[int] = []
    before = np.full(len(order), -1)
    for k in order.tolist():
        value, at = int(second[k]), bisect_left(ends, int(second[k]))
        total = int(weight[k]) + (heaviest[at - 1] if at else 0)
        before[k] = members[at - 1] if at else -1
        stop = at
        while stop < len(ends) and heaviest[stop] <= total:
            stop += 1
        ends[at:stop], heaviest[at:stop], members[at:stop] = [value], [total], [k]
    chain = []
    k = members[-1] if members else -1
    while k >= 0:
        chain.append(k)
        k = int(before[k])
    return np.array(chain[::-1], dtype=np.int64)


def _kept_runs(table: pa.Table) -> pa.Table:
    """Of the runs of one range, those of the heaviest chain: ranks ``_lo`` to before ``_hi``."""
    first, second = (table.column(c).to_numpy() for c in ("_re", "_rg"))
    order = np.argsort(first)
    first, second = first[order], second[order]
    until = np.r_[first[1:], table.column("_end")[0].as_py()]
    kept = heaviest_chain(first, second, until - first)
    return pa.table({"_lo": pa.array(first[kept], pa.int64()), "_hi": pa.array(until[kept], pa.int64())})


def rising(pairs: DataFrame) -> DataFrame:
    """The pairs ``_pe``, ``_pg`` of a longest chain that rises in both; either position occurs once.

    Pairs that follow each other on both sides are a run, which a longest chain holds whole or not at all, so runs are chained by
    their lengths. With more than ``CHAIN`` runs, ranges of pairs are thinned out to their own chains first, by turns
    of either side; what still has too many runs is cut to its most frequent offset. The
    chain is then not always the longest, but the comparison built on it is as complete.
    """
    for turn in range(THINNING + 1):
        ranked = staged(numbered(numbered(pairs, ["_pe"], "_re", copies=False), ["_pg"], "_rg", copies=False), "anchors")
        total = ranked.count()
        follows = ranked.select((F.col("_re") + 1).alias("_re"), (F.col("_rg") + 1).alias("_rg"))
        starts = staged(ranked.join(follows, ["_re", "_rg"], "left_anti").select("_re", "_rg"), "runs")
        runs = starts.count()
        if runs <= 1:
            return ranked.select("_pe", "_pg")
        if runs <= CHAIN:
            whole = starts.withColumn("_end", F.lit(total + 1).cast("bigint")).groupBy(F.lit(0).alias("_range"))
            return _inside(ranked, whole.applyInArrow(_kept_runs, "_lo bigint, _hi bigint"), "_re")
        if turn == THINNING:
            break
        here, there = ("_re", "_rg") if turn % 2 == 0 else ("_rg", "_re")
        # A run that crosses the border of a range starts again there.
        borders = ranked.filter(F.col(here) % CHAIN == 0).select("_re", "_rg")
        ranges = starts.union(borders).distinct().select(
            F.floor(F.col(here) / CHAIN).alias("_range"), F.col(here).alias("_re"), F.col(there).alias("_rg")
        )
        ranges = ranges.withColumn("_end", ((F.col("_range") + 1) * CHAIN).cast("bigint"))
        pairs = _inside(ranked, ranges.groupBy("_range").applyInArrow(_kept_runs, "_lo bigint, _hi bigint"), here)
    offset = F.col("_re") - F.col("_rg")
    most = ranked.groupBy(offset.alias("_offset")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_offset").limit(1)
    return ranked.join(F.broadcast(most), offset == F.col("_offset")).select("_pe", "_pg")


def _inside(ranked: DataFrame, runs: DataFrame, rank: str) -> DataFrame:
    """Pairs whose rank lies in one of the runs, which are cut into pieces of ``PIECE`` ranks so that both meet by equality."""
    first, last = F.floor(F.col("_lo") / PIECE), F.floor((F.col("_hi") - 1) / PIECE)
    pieces = staged(runs, "kept-runs").withColumn("_piece", F.explode(F.sequence(first, last)))
    placed = ranked.withColumn("_piece", F.floor(F.col(rank) / PIECE))
    held = (F.col(rank) >= F.col("_lo")) & (F.col(rank) < F.col("_hi"))
    kept = placed.join(pieces, "_piece").filter(held).select("_pe", "_pg")
    return staged(kept, "chain")


def _counted_on(rows: DataFrame, within: list[str], what: Column, name: str) -> DataFrame:
    """Add the running total of ``what`` up to and with each row, in the order of ``_at`` and within the given columns.

    Totals run within buckets of ``BUCKET`` positions and go on from the buckets before.
    """
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / BUCKET)).withColumn("_what", what)
    totals = rows.groupBy(*within, "_bucket").agg(F.sum("_what").alias("_total"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*within, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*within, "_bucket").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("_here", F.sum("_what").over(here)).join(staged(bases, "bases"), [*within, "_bucket"])
    return counted.withColumn(name, F.col("_base") + F.col("_here")).drop("_bucket", "_what", "_base", "_here")


def _without_anchors(rows: DataFrame, anchors: DataFrame, at: str) -> DataFrame:
    """Rows that are no anchors, with the number of anchors before them as ``_gap``."""
    marks = anchors.select(F.col(at).alias("_at"), F.lit(1).alias("_anchor"))
    flagged = rows.drop("_gap").join(marks, "_at", "left").withColumn("_anchor", F.coalesce("_anchor", F.lit(0)))
    counted = _counted_on(flagged, [], F.col("_anchor"), "_gap")
    return counted.filter("_anchor = 0").drop("_anchor")


def _aligned(expected: list[list[str]], produced: list[list[str]]) -> list[tuple[int, int]]:
    """Pairs of positions (-1: none), in order, with the fewest differing cells.

    A row on its own costs half its cells, so rows are paired if any of their cells agree.
    """
    width = len((expected or produced)[0])
    e, g = np.array(expected).reshape(-1, width), np.array(produced).reshape(-1, width)
    pair = 2 * (e[:, None, :] != g[None, :, :]).sum(axis=2)
    # Not worth more than two rows on their own.
    pair[pair >= 2 * width] = 2 * width + 1
    cost = np.zeros((len(e) + 1, len(g) + 1), np.int64)
    cost[:, 0], cost[0, :] = np.arange(len(e) + 1) * width, np.arange(len(g) + 1) * width
    for i in range(1, len(e) + 1):
        for j in range(1, len(g) + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + pair[i - 1, j - 1], cost[i - 1, j] + width, cost[i, j - 1] + width)
    found, i, j = [], len(e), len(g)
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + pair[i - 1, j - 1]:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif i and cost[i, j] == cost[i - 1, j] + width:
            i -= 1
            found.append((i, -1))
        else:
            j -= 1
            found.append((-1, j))
    return found[::-1]


@dataclass
class Alignment:
    """The comparison of two ordered tables; each method is a lazy frame over written ones."""

    columns: list[str]
    anchored: DataFrame
    found: DataFrame

    def summary(self) -> DataFrame:
        """One row: equal, differing and one-sided rows, and the verdict."""
        kinds = {"matched": "equal", "differing": "cells", "only_in_expected": "only_in_expected", "only_in_generated": "only_in_generated"}
        rows = self.anchored.select(F.lit("equal").alias("type")).unionByName(self.found.select("type"))
        told = rows.agg(*[F.count_if(F.col("type") == kind).alias(name) for name, kind in kinds.items()])
        clean = sum((F.col(n) for n in list(kinds)[1:]), F.lit(0)) == 0
        return told.withColumn("verdict", F.when(clean, "PASS").otherwise("FAIL"))

    def differences(self) -> DataFrame:
        """``type``, the structs ``expected`` and ``generated`` (NULL where there is none) and their positions, from 1."""
        return self.found

    def cells(self) -> DataFrame:
        """One row per differing cell: both positions, column, both values."""
        cell = F.explode(
            F.array(*[
                F.struct(F.lit(c).alias("col"), F.col(f"expected.{quoted(c)}").alias("expected"), F.col(f"generated.{quoted(c)}").alias("generated"))
                for c in self.columns
            ])
        )
        pairs = self.found.filter("type = 'cells'").select("expected_at", "generated_at", cell.alias("cell"))
        return pairs.select("expected_at", "generated_at", "cell.*").filter(F.col("expected") != F.col("generated"))


def align_in_order(
    expected: DataFrame,
    produced: DataFrame,
    order: Sequence[str],
    produced_order: Sequence[str] | None = None,
    columns: Mapping[str, str] | None = None,
    ignore: Sequence[str] = (),
) -> Alignment:
    """Align ``produced`` with ``expected`` by the content of their rows in the given orders.

    Columns are matched and values normalised as in ``reconcile``; ``ignore`` leaves expected columns out of the comparison, such
    as a line number. Rows that agree in every cell and follow the chain are equal. Others are told as
    differing if they stand in one gap and agree in some cell, else as being on one side only; so a
    row that has moved is told once on either side.
    """
    if not order:
        raise ConfigError("an alignment needs an order")
    matched = match_columns(expected.columns, produced.columns, columns)
    compared = {c: s for c, s in matched.items() if c not in ignore}
    if not compared:
        raise ConfigError("the expected rows have no columns to compare")
    names = list(compared)
    sides = []
    for frame, by, sources in ((expected, order, {c: c for c in names}), (produced, produced_order or order, compared)):
        placed = normal_rows(numbered(frame, by, "_at"), sources, "_at")
        values = [F.col(quoted(c)) for c in names]
        content = F.unhex(F.md5(F.to_json(F.array(*values))))
        sides.append(staged(placed.select("_at", content.alias("_content"), F.struct(*values).alias("_row")), "side"))
    e, g = sides
    once = [s.groupBy("_content").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias(p)).filter("_n = 1") for s, p in ((e, "_pe"), (g, "_pg"))]
    anchors = rising(staged(once[0].join(once[1], "_content").select("_pe", "_pg"), "pairs"))
    # In a gap, the n-th copies of equal content.
    copies = []
    for side, at in ((e, "_pe"), (g, "_pg")):
        rest = staged(_without_anchors(side.select("_at", "_content"), anchors, at), "gap-rows")
        number = _counted_on(rest, ["_gap", "_content"], F.lit(1), "_copy")
        copies.append(number.select("_gap", "_content", "_copy", F.col("_at").alias(at)))
    more = rising(staged(copies[0].join(copies[1], ["_gap", "_content", "_copy"]).select("_pe", "_pg"), "pairs"))
    anchors = staged(anchors.unionByName(more), "anchored")
    left = []
    for side, at, name in ((e, "_pe", "e"), (g, "_pg", "g")):
        rest = staged(_without_anchors(side.select("_at", "_row"), anchors, at), "gap-rows")
        left.append(_counted_on(rest, ["_gap"], F.lit(1), "_k").select("_gap", "_k", "_at", "_row", F.lit(name).alias("_side")))
    return Alignment(names, anchors, staged(_paired(left[0], left[1], names), "aligned"))


def _paired(e: DataFrame, g: DataFrame, names: list[str]) -> DataFrame:
    """What is left in gaps: short gaps aligned by their cells, others in order."""
    both = staged(e.unionByName(g), "left-over")
    sizes = both.groupBy("_gap").agg(*[F.count_if(F.col("_side") == s).alias(f"_n{s}") for s in "eg"])
    sizes = staged(sizes, "gaps")
    few = (F.col("_ne") <= GAP_ROWS) & (F.col("_ng") <= GAP_ROWS) & (F.col("_ne") > 0) & (F.col("_ng") > 0)
    simple = ~few | ((F.col("_ne") == 1) & (F.col("_ng") == 1))
    sided = both.join(sizes, "_gap")
    side = lambda s: sided.filter(simple & (F.col("_side") == s)).select("_gap", "_k", F.col("_at").alias(f"_a{s}"), F.col("_row").alias(f"_{s}"))
    in_order = side("e").join(side("g"), ["_gap", "_k"], "full")
    agree = F.lit(False)
    for c in names:
        agree = agree | (F.col(f"_e.{quoted(c)}") == F.col(f"_g.{quoted(c)}"))
    row = sided.schema["_row"].dataType
    none = F.lit(None).cast(row)
    part = lambda kind, x, y, at, to: F.struct(
        F.lit(kind).alias("type"), x.alias("expected"), y.alias("generated"), at.alias("expected_at"), to.alias("generated_at")
    )
    e_at, g_at, no_at = F.col("_ae"), F.col("_ag"), F.lit(None).cast("bigint")
    alone = F.array(
        F.when(F.col("_e").isNotNull(), part("only_in_expected", F.col("_e"), none, e_at, no_at)),
        F.when(F.col("_g").isNotNull(), part("only_in_generated", none, F.col("_g"), no_at, g_at)),
    )
    told = F.when(F.coalesce(agree, F.lit(False)), F.array(part("cells", F.col("_e"), F.col("_g"), e_at, g_at))).otherwise(F.array_compact(alone))
    plain = in_order.select(F.explode(told).alias("t")).select("t.*")
    # Many short gaps go to one task together.
    cells = F.array(*[F.col(f"_row.{quoted(c)}") for c in names])
    short = sided.filter(~simple).select("_gap", "_at", "_side", cells.alias("_cells"))
    groups = F.pmod(F.xxhash64("_gap"), F.lit(max(1, -(-sizes.filter(~simple).count() // 256))))

    def align(table: pa.Table) -> pa.Table:
        gaps: dict[int, dict[str, list]] = {}
        for gap, at, side, cells in sorted(zip(*(table.column(c).to_pylist() for c in ("_gap", "_at", "_side", "_cells"))), key=lambda r: r[:2]):
            gaps.setdefault(gap, {"e": [], "g": []})[side].append((at, cells))
        found = []
        for own in gaps.values():
            for i, j in _aligned([c for _, c in own["e"]], [c for _, c in own["g"]]):
                found.append((own["e"][i][0] if i >= 0 else None, own["g"][j][0] if j >= 0 else None))
        return pa.table({"_ae": pa.array([a for a, _ in found], pa.int64()), "_ag": pa.array([b for _, b in found], pa.int64())})

    pairs = staged(short.withColumn("_group", groups).groupBy("_group").applyInArrow(align, "_ae bigint, _ag bigint"), "short-gaps")
    rows = {s: both.filter(F.col("_side") == s).select(F.col("_at").alias(f"_a{s}"), F.col("_row").alias(f"_{s}")) for s in "eg"}
    near = pairs.join(rows["e"], "_ae", "left").join(rows["g"], "_ag", "left")
    kind = F.when(F.col("_ag").isNull(), "only_in_expected").when(F.col("_ae").isNull(), "only_in_generated").otherwise("cells")
    near = near.select(
        kind.alias("type"), F.col("_e").alias("expected"), F.col("_g").alias("generated"), e_at.alias("expected_at"), g_at.alias("generated_at")
    )
    return plain.unionByName(near)
