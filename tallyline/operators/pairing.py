"""Pair left-over rows of a key so that few cells differ.

Keys with few rows a side get the least total there is. For the others rows meet by hashes of all their
cells but one, column after column, and what still has no partner is paired in hash order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.naming import quoted

# Rows of a key and side, copies counted, that are assigned exactly, and rows that one task assigns.
EXACT_ROWS, TASK_ROWS = 48, 20_000
# Entries of the cost matrices that are worked on together.
BATCH_ENTRIES = 1 << 20


def assign_all(cost: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of matrices of one shape, the row each column is paired with, else -1: least total cost, by shortest augmenting paths.

    A matrix has its number in ``rows`` as rows that count, and at least as many columns of finite cost.
    All matrices take each step together, so the work in Python does not grow with their number.
    """
    size, n, m = cost.shape
    u, v = np.zeros((size, n + 1)), np.zeros((size, m + 1))
    owner = np.zeros((size, m + 1), dtype=np.int64)
    back = np.zeros((size, m + 1), dtype=np.int64)
    for row in range(1, n + 1):
        open_ = np.flatnonzero(rows >= row)
        owner[open_, 0] = row
        at = np.zeros(size, dtype=np.int64)
        least, done = np.full((size, m + 1), np.inf), np.zeros((size, m + 1), dtype=bool)
        while open_.size:
            here = np.arange(open_.size)
            done[open_, at[open_]] = True
            own, was, seen = owner[open_, at[open_]], least[open_], done[open_]
            reduced = cost[open_, own - 1] - u[open_, own][:, None] - v[open_, 1:]
            better = ~seen[:, 1:] & (reduced < was[:, 1:])
            was[:, 1:][better] = reduced[better]
            back[open_, 1:] = np.where(better, at[open_][:, None], back[open_, 1:])
            to = np.where(seen, np.inf, was).argmin(axis=1)
            step = was[here, to]
            # The rows that own reached columns differ, so each potential is added to once.
            i, j = np.nonzero(seen)
            u[open_[i], owner[open_[i], j]] += step[i]
            v[open_] -= np.where(seen, step[:, None], 0)
            least[open_] = np.where(seen, was, was - step[:, None])
            at[open_] = to
            open_ = open_[owner[open_, to] != 0]
        open_ = np.flatnonzero(at)
        while open_.size:
            before = back[open_, at[open_]]
            owner[open_, at[open_]] = owner[open_, before]
            at[open_] = before
            open_ = open_[before != 0]
    return owner[:, 1:] - 1


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost, as many as the shorter side has."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in assign(cost.T)]
    owner = assign_all(cost[None], np.array([cost.shape[0]]))[0]
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0)


def _shape(n: np.ndarray) -> np.ndarray:
    """The next power of two: matrices of about the same size are worked on together."""
    return 1 << np.ceil(np.log2(n)).astype(np.int64)


def _partners(key: np.ndarray, side: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The place of the row that each row meets, -1 if none; rows are in the order of key and side (0, 1), ``cells`` a line a column."""
    partner = np.full(len(key), -1)
    n = np.stack([np.bincount(key[side == s], minlength=key[-1] + 1) for s in (0, 1)])
    begin = np.cumsum(n.sum(axis=0)) - n.sum(axis=0)
    begin = np.where(n[0] > n[1], [begin + n[0], begin], [begin, begin + n[0]])
    n = np.sort(n, axis=0)
    both = np.flatnonzero(n[0])
    if not both.size:
        return partner
    shapes, which = np.unique(_shape(n[:, both]), axis=1, return_inverse=True)
    for k, (high, wide) in enumerate(shapes.T):
        members = both[which.ravel() == k]
        for some in np.array_split(members, -(-len(members) * high * wide // BATCH_ENTRIES)):
            i, j = (begin[s, some, None] + np.minimum(np.arange(most), n[s, some, None] - 1) for s, most in ((0, high), (1, wide)))
            cost = np.zeros((len(some), high, wide))
            for column in cells:
                cost += column[i][:, :, None] != column[j][:, None, :]
            cost += np.where(np.arange(wide) < n[1, some, None], 0, np.inf)[:, None, :]
            owner = assign_all(cost, n[0, some])
            b, column = np.nonzero(owner >= 0)
            one, other = i[b, owner[b, column]], j[b, column]
            partner[one], partner[other] = other, one
    return partner


def least_cells(rest: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``type``, ``expected``, ``generated``, ``copies`` of keys with at most ``EXACT_ROWS`` rows a side."""
    flat = rest.select(F.xxhash64(*[F.col(quoted(k)) for k in keys]).alias("_group"), "_side", "_n", F.unhex("_hash").alias("_hash"), "_row")
    groups = max(1, -(-rest.count() // TASK_ROWS))
    form = rest.schema["_row"].dataType
    named, others = ([k for k, c in enumerate(columns) if (c in keys) == inside] for inside in (True, False))

    def pair(table: pa.Table) -> pa.Table:
        rows = table.column("_row").combine_chunks()
        codes = [c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in rows.flatten()]
        key = np.zeros(len(rows), dtype=np.int64)
        for k in named:
            key = np.unique(key * len(rows) + codes[k], return_inverse=True)[1].ravel()
        side = pc.equal(table.column("_side"), "g").to_numpy().astype(np.int64)
        # Rows of a key and side follow each other by their hash, a row as often as it has copies.
        hashes = table.column("_hash").combine_chunks().cast(pa.binary(16))
        hashes = np.frombuffer(hashes.buffers()[1], "S16", len(rows), hashes.offset * 16)
        order = np.lexsort((hashes, side, key))
        at = np.repeat(order, table.column("_n").to_numpy()[order])
        partner = _partners(key[at], side[at], np.array([codes[k][at] for k in others]))
        # Numbers of the rows that meet from 1, 0 where there is none: expected rows and theirs, then what is left of the others.
        met = np.where(partner < 0, 0, at[partner] + 1)
        left, alone = side[at] == 0, (side[at] == 1) & (partner < 0)
        met = np.concatenate([(at[left] + 1) * (len(rows) + 1) + met[left], at[alone] + 1])
        met, copies = np.unique(met, return_counts=True)
        e, g = (rows.take(pa.array(x - 1, mask=x == 0)) for x in np.divmod(met, len(rows) + 1))
        return pa.table({"expected": e, "generated": g, "copies": pa.array(copies, pa.int64())})

    dealt = flat.withColumn("_group", F.pmod("_group", F.lit(groups)))
    made = T.StructType().add("expected", form).add("generated", form).add("copies", T.LongType())
    paired = dealt.groupBy("_group").applyInArrow(pair, made)
    kind = F.when(F.col("generated").isNull(), "only_in_expected").when(F.col("expected").isNull(), "only_in_generated").otherwise("cells")
    return paired.select(kind.alias("type"), "expected", "generated", "copies")


def less_one(column: str, columns: Sequence[str]) -> Column:
    """Hash of a row's cells but one."""
    others = [F.col(f"_row.{quoted(c)}") for c in columns if c != column]
    return F.md5(F.to_json(F.array(*others)) if others else F.lit(""))
