"""Blocks of queries against blocks of rows: vectors packed to a row a block, pairs of blocks, running best lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import cut, small_batches

# A block has at most so many rows, and so many bytes of vectors.
BLOCK_ROWS, BLOCK_BYTES = 1_024, 4 << 20
# Blocks that one task reads for one block of queries before it hands on its best.
SLICE_BLOCKS = 16
NO_ID = np.iinfo(np.int64).max


def sound_rows(frame: DataFrame, id_col: str, vector_col: str, zero: bool, **more) -> DataFrame:
    """``uid``, ``id``, ``vec``, ``dim`` and ``more`` columns of rows whose vector is not null and has finite components
    only; ``zero`` tells whether vectors of zeros (or of no components) take part. A written table."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = frame.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"),
        *[c.alias(name) for name, c in more.items()],
    )
    rows = rows.filter(vec.isNotNull() & finite)
    if not zero:
        rows = rows.filter(F.exists(vec, lambda v: v != 0))
    return cut(rows.select(F.monotonically_increasing_id().alias("uid"), "*", F.size(vec).alias("dim")), "vectors")


def matrix(block: dict) -> np.ndarray:
    """The vectors of a block."""
    return numbers(block["vecs"]).astype(np.float64).reshape(block["n"].as_py(), block["dim"].as_py())


def numbers(values: pa.Scalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False)


def ids_of(values: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are null; those sort last."""
    flat = values.values
    return flat.fill_null(NO_ID).to_numpy(), flat.is_null().to_numpy(zero_copy_only=False)


def packed(
    frame: DataFrame, keys: dict[str, str], lists: dict[str, str], name: str, rows: int = BLOCK_ROWS,
    add: Callable[[np.ndarray], dict[str, pa.Array]] | None = None, added: str = "",
) -> DataFrame:
    """One row a block: consecutive rows of a partition with equal ``keys`` (``dim`` is one of them), their ``lists`` columns as
    arrays and their vectors one after the other in ``vecs``; ``add`` works out further columns from a block's vectors."""
    small_batches(frame.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        key, count, room = None, 0, 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = table.column("vec").combine_chunks().flatten().cast(pa.float64())
            columns = {"block": pa.array([base + number], pa.int64()), "n": pa.array([count], pa.int32())}
            columns |= {k: pa.array([v], held[0].schema.field(k).type) for k, v in zip(keys, key)}
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            columns |= {c: one(table.column(c).combine_chunks()) for c in lists}
            columns["vecs"] = one(vectors)
            if add:
                dim = dict(zip(keys, key))["dim"]
                columns |= add(vectors.to_numpy(zero_copy_only=False).reshape(count, dim))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            seen = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            at = 0
            while at < len(seen):
                if seen[at] != key or count == room:
                    if count:
                        yield block()
                        number += 1
                    key, held, count = seen[at], [], 0
                    room = min(rows, max(1, BLOCK_BYTES // (8 * max(1, dict(zip(keys, key))["dim"]))))
                end = at
                while end < len(seen) and seen[end] == key and count + end - at < room:
                    end += 1
                held.append(batch.slice(at, end - at))
                count, at = count + end - at, end
        if count:
            yield block()

    schema = ["block long", "n int", *[f"{k} {t}" for k, t in keys.items()], *[f"{c} array<{t}>" for c, t in lists.items()]]
    schema += ["vecs array<double>", *([added] if added else [])]
    columns = dict.fromkeys([*keys, *lists, "vec"])
    return cut(frame.select(*columns).mapInArrow(of, ", ".join(schema)), name)


def meet(
    pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, begin: Callable[[dict], tuple[Callable, Callable]], schema: str,
    order: str | None = None,
) -> DataFrame:
    """Stream the blocks of ``pairs`` (``chunk``, ``block``) past their chunk of queries.

    ``begin(chunk)`` returns ``take(block)``, called for block after block, and ``finish()``, whose record batch is
    handed on. A task holds one chunk and one Arrow batch of blocks, and hands on at most the best of ``SLICE_BLOCKS`` blocks or so.
    """
    spark = pairs.sparkSession
    small_batches(spark)
    struct = lambda frame: F.struct(*frame.columns)
    # Blocks are numbered by partition and place; their hash deals them evenly.
    total = max(1, blocks.count())
    slices = -(-total // SLICE_BLOCKS)
    pairs = pairs.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)))
    none_q, none_b = F.lit(None).cast(chunks.select(struct(chunks)).schema[0].dataType), F.lit(None).cast(
        blocks.select(struct(blocks)).schema[0].dataType
    )
    rank = F.col(order) if order else F.lit(0.0)
    rows = pairs.select("chunk", "slice", "block", rank.cast("double").alias("first")).join(
        blocks.select(F.col("block").alias("_block"), struct(blocks).alias("b")), F.col("block") == F.col("_block")
    )
    rows = rows.select("chunk", "slice", F.lit(1).alias("kind"), "first", none_q.alias("q"), "b")
    heads = pairs.select("chunk", "slice").distinct().join(
        chunks.select(F.col("block").alias("_block"), struct(chunks).alias("q")), F.col("chunk") == F.col("_block")
    )
    heads = heads.select("chunk", "slice", F.lit(0).alias("kind"), F.lit(0.0).alias("first"), "q", none_b.alias("b"))
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), slices * chunks.count()))
    dealt = heads.unionByName(rows).repartition(tasks, "chunk", "slice").sortWithinPartitions("chunk", "slice", "kind", F.desc("first"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = finish = None
        for batch in batches:
            heads, rows = batch.column("q"), batch.column("b")
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:
                    if finish:
                        yield finish()
                    take, finish = begin(_fields(heads[i]))
                else:
                    take(_fields(rows[i]))
        if finish:
            yield finish()

    return dealt.select("kind", "q", "b").mapInArrow(of, schema)


def _fields(row: pa.StructScalar) -> dict[str, pa.Scalar]:
    return dict(row.items())


def first_of_each(group: np.ndarray, limit: np.ndarray | int, *keys: np.ndarray) -> np.ndarray:
    """Positions of the first ``limit`` rows of each group in the order of the keys."""
    if not len(group):
        return np.zeros(0, np.int64)
    order = np.lexsort([*keys[::-1], group])
    sorted_group = group[order]
    start = np.r_[0, np.nonzero(np.diff(sorted_group))[0] + 1]
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < limit]


class Best:
    """The best rows so far of each query of a chunk: smallest ``key`` first, then smallest id, null ids last."""

    def __init__(self, queries: int, limit: int, kind: type = np.float64):
        self.limit = limit
        self.group = np.zeros(0, np.int64)
        self.key = np.zeros(0, kind)
        self.ids, self.null, self.uids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        # Key of the last row that still counts; the largest there is while there are fewer rows.
        self.worst = np.full(queries, np.inf if kind is np.float64 else NO_ID, kind)

    def add(self, group: np.ndarray, key: np.ndarray, ids: np.ndarray, null: np.ndarray, uids: np.ndarray) -> None:
        self.group, self.key = np.r_[self.group, group], np.r_[self.key, key]
        self.ids, self.null, self.uids = np.r_[self.ids, ids], np.r_[self.null, null], np.r_[self.uids, uids]
        kept = first_of_each(self.group, self.limit, self.key, self.null, self.ids, self.uids)
        for name in ("group", "key", "ids", "null", "uids"):
            setattr(self, name, getattr(self, name)[kept])
        full = np.nonzero(np.bincount(self.group, minlength=len(self.worst)) == self.limit)[0]
        last = np.searchsorted(self.group, full, side="right") - 1
        self.worst[full] = self.key[last]
