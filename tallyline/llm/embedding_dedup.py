"""Links between near vectors by an epsilon grid order join."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import cut
from tallyline.llm.components import components
from tallyline.llm.simhash import forest

# Rows of a sequence interval: at least, and at most in one task.
LEAST_BLOCK, MOST_BLOCK = 256, 8_192
# Intervals of one level that make one of the next.
FAN = 16
LEAF = 256


def _moments(frame: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the unit vectors; d * d numbers a partition are summed by Spark."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = _vectors(batch.column(0), dim)
            x = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(x))]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["k", "x"]
        )

    rows = frame.select("vec").mapInArrow(of, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(((dim + 1) ** 2))
    for row in rows:
        total[row.k] = row.x
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[dim, dim], 1)
    mean = total[dim, :dim] / n
    return mean, total[:dim, :dim] / n - np.outer(mean, mean)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors, each divided by the power of two of its largest component, which loses no digit of a cosine."""
    x = _matrix(column, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _grid_order(reps: DataFrame, dim: int, eps: float, axes: int) -> tuple[DataFrame, int]:
    """Add the coordinates on the leading principal axes and the cells of width eps.

    The projection shortens distances, so what is far apart there is far apart.
    """
    mean, spread = _moments(reps, dim)
    axes = min(axes, dim)
    lead = np.linalg.eigh(spread)[1][:, ::-1][:, :axes]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("vec"), dim)
            at = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ lead
            lists = lambda m, t: pa.array(list(m), pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists(at, pa.float64()), lists(np.floor(at / eps).astype(np.int32), pa.int32())],
                [*batch.schema.names, "at", "cell"],
            )

    return reps.mapInArrow(of, f"{_ddl(reps)}, at array<double>, cell array<int>"), axes


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def _boxes(frame: DataFrame, axes: int) -> list:
    """Bounds of a group's coordinates, from columns lo0.. and hi0.. or the coordinates themselves."""
    return [F.min(f"lo{k}").alias(f"lo{k}") for k in range(axes)] + [
        F.max(f"hi{k}").alias(f"hi{k}") for k in range(axes)
    ]


def _interval_pairs(blocks: DataFrame, axes: int, eps: float, count: int) -> DataFrame:
    """Pairs ``a`` <= ``b`` of blocks whose boxes come within eps, by recursion over the sequence.

    Level by level: pairs of long intervals are opened into pairs of their parts, and those
    that are provably distant are skipped. A level is a small join on interval numbers.
    """
    levels = [blocks]
    while count > 1:
        up = levels[-1].withColumn("block", F.floor(F.col("block") / FAN)).groupBy("block").agg(*_boxes(blocks, axes))
        levels.append(cut(up, "intervals"))
        count = -(-count // FAN)
    pairs = blocks.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"r.lo{k}") - F.col(f"l.hi{k}"), F.col(f"l.lo{k}") - F.col(f"r.hi{k}"))
        for k in range(axes)
    ]
    distance = sum((g * g for g in gaps), F.lit(0.0))
    for parts in levels[-2::-1]:
        opened = pairs.select(F.explode(F.sequence(F.col("a") * FAN, F.col("a") * FAN + FAN - 1)).alias("a"), "b")
        opened = opened.select("a", F.explode(F.sequence(F.col("b") * FAN, F.col("b") * FAN + FAN - 1)).alias("b"))
        near = (
            opened.filter("a <= b").alias("p")
            .join(parts.alias("l"), F.col("p.a") == F.col("l.block"))
            .join(parts.alias("r"), F.col("p.b") == F.col("r.block"))
            .filter(distance <= eps * eps)
        )
        pairs = cut(near.select("p.a", "p.b"), "interval-pairs")
    return pairs


def _join_intervals(x: np.ndarray, norm: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray,
                    same: bool, weight: np.ndarray, eps: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked weight of each row, and the least row it is linked with; recursion over halves of both intervals."""
    degree = np.zeros(len(x), dtype=np.int64)
    ends: list[np.ndarray] = []
    stack = [(left, right, same)]
    while stack:
        a, b, same = stack.pop()
        if not len(a) or not len(b):
            continue
        gap = np.maximum(0, np.maximum(at[b].min(0) - at[a].max(0), at[a].min(0) - at[b].max(0)))
        if gap @ gap > eps * eps:
            continue
        if max(len(a), len(b)) > LEAF:
            a1, a2 = np.array_split(a, 2)
            if same:
                stack += [(a1, a1, True), (a1, a2, False), (a2, a2, True)]
            else:
                b1, b2 = np.array_split(b, 2)
                stack += [(p, q, False) for p in (a1, a2) for q in (b1, b2)]
            continue
        hit = x[a] @ x[b].T >= least * norm[a][:, None] * norm[b][None, :]
        if same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        degree[a] += hit @ weight[b]
        if not same:
            degree[b] += weight[a] @ hit
        p, q = np.nonzero(hit)
        local = np.unique(np.r_[a, b])
        p, q = np.searchsorted(local, a[p]), np.searchsorted(local, b[q])
        root = forest(len(local), p, q)
        moved = np.nonzero(root != np.arange(len(local)))[0]
        ends.append(np.c_[local[moved], local[root[moved]]])
    pairs = np.concatenate(ends) if ends else np.zeros((0, 2), dtype=np.int64)
    return degree, forest(len(x), pairs[:, 0], pairs[:, 1])


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, axes: int = 6,
    dim: int | None = None,
) -> DataFrame:
    """``id``, ``n_links`` and ``component_id`` of every row.

    Rows link at a cosine of ``cosine`` (over 0) or more, in double precision. Vectors that are null, empty or
    zero, hold null or non-finite components, or have another length than ``dim`` (unset: any) link with nothing;
    others link with vectors of their own length, and lengths are gone through one by one. Repeated rows and equal vectors count one by
    one. A component's id is its smallest id, or null if none of its rows has one. An empty table gives an empty result.

    Equal vectors are one node with a weight. Unit vectors at that cosine are at most
    eps = sqrt(2 - 2 cosine) apart. Nodes are sorted by grid cells of that width on
    the leading principal axes and cut into intervals; interval pairs are opened recursively, first between
    intervals by Spark, then inside a pair by its task; distant ones are skipped by their boxes.
    A task gets two intervals of at most ``MOST_BLOCK`` rows and returns a row a node, never the pairs.
    """
    eps = math.sqrt(2 - 2 * cosine) + 1e-9
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")), "rows")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = rows.filter(F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0))
    lengths = [dim] if dim else [r.n for r in sound.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    found = [_classes(sound.filter(F.size("vec") == n), n, eps, cosine, axes) for n in lengths]
    if not found:
        found = [rows.limit(0).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("found"))]
    classes = functools.reduce(DataFrame.unionByName, found)
    return rows.join(classes, "vec", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _classes(sound: DataFrame, dim: int, eps: float, cosine: float, axes: int) -> DataFrame:
    """``n_links`` and ``component_id`` of the distinct vectors of one length."""
    reps = cut(
        sound.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn(
            "node", F.monotonically_increasing_id()
        ),
        "vectors",
    )
    count = reps.count()
    ordered, axes = _grid_order(reps, dim, eps, axes)
    size = min(MOST_BLOCK, max(LEAST_BLOCK, count // 16))
    parts = max(1, -(-count // size))
    ranged = ordered.repartitionByRange(parts, "cell", "at", "node").sortWithinPartitions("cell", "at", "node")
    ranged = cut(
        ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ordered"
    )
    ranged = ranged.join(_starts(ranged), "part").withColumn(
        "block", F.floor((F.col("before") + F.col("seq") - F.col("low")) / size)
    )
    bounds = [F.min(F.get("at", F.lit(k))).alias(f"lo{k}") for k in range(axes)]
    bounds += [F.max(F.get("at", F.lit(k))).alias(f"hi{k}") for k in range(axes)]
    blocks = cut(ranged.groupBy("block").agg(*bounds), "blocks")
    pairs = _interval_pairs(blocks, axes, eps, max(1, -(-count // size)))
    sides = ranged.select("block", "node", "vec", "at", "cell", "n")
    left = sides.join(pairs, sides["block"] == pairs["a"]).withColumn("side", F.lit(0))
    right = sides.join(pairs.filter("a <> b"), sides["block"] == F.col("b")).withColumn("side", F.lit(1))

    def compare(table: pa.Table) -> pa.Table:
        x = _vectors(table.column("vec").combine_chunks(), dim)
        at = _matrix(table.column("at").combine_chunks(), axes)
        cell = np.floor(at / eps)
        node, side, weight = (table.column(c).to_numpy() for c in ("node", "side", "n"))
        order = np.lexsort([*at.T[::-1], *cell.T[::-1], side])
        x, at, node, side, weight = x[order], at[order], node[order], side[order], weight[order]
        first, second = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        same = len(second) == 0
        norm = np.linalg.norm(x, axis=1)
        degree, root = _join_intervals(x, norm, at, first, first if same else second, same, weight, eps, cosine)
        out = np.nonzero(degree)[0]
        return pa.table({"node": pa.array(node[out]), "links": pa.array(degree[out]), "root": pa.array(node[root[out]])})

    found = cut(
        left.unionByName(right)
        .groupBy("a", "b")
        .applyInArrow(compare, "node long, links long, root long"),
        "linked",
    )
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = cut(
        reps.join(links, "node", "left")
        .join(roots, "node", "left")
        .select("vec", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "roots",
    )
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    # Of written tables, so that the last join shuffles both sides by itself and Spark can split a hot vector.
    return cut(rooted.join(named, "root").select("vec", "n_links", "component_id", F.lit(True).alias("found")), "classes")


def _starts(ordered: DataFrame) -> DataFrame:
    """For each range partition its first id and the rows before it, so that intervals are cut by places in
    the whole sequence, however many partitions it was sorted in; a row a partition."""
    counts = ordered.groupBy("part").agg(F.count("*").alias("rows"), F.min("seq").alias("low"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return cut(counts.select("part", "low", F.coalesce(before, F.lit(0)).alias("before")), "starts")
