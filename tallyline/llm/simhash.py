"""SimHash fingerprints, and their near pairs by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import cut, small_batches
from tallyline.llm.components import components

SEED = 42
# Fingerprints that the shared tree is fitted on; it then serves all of them.
TREE_SAMPLE = 16_384
# Fingerprints a shard should hold, and those that one task may compare.
SHARD_ROWS, TASK_ROWS = 512, 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of all shingle hashes, as an unsigned number; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    count = len(words) - width + 1
    totals = np.zeros((8, 256), dtype=np.int64)
    offsets = np.arange(8) * 256
    for at in range(0, count, 65_536):
        to = min(count, at + 65_536)
        pieces = zip(starts[at:to].tolist(), (ends[at + width - 1 : to + width - 1] - 1).tolist())
        raw = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in pieces]), dtype=np.uint8)
        totals += np.bincount((raw.reshape(-1, 8) + offsets).ravel(), minlength=2048).reshape(8, 256)
    ones = (totals @ _BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed long) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(of, f"id {kind}, fp long")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of its component for each of n members linked by a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _vantage(marks: np.ndarray) -> tuple[np.uint64, int]:
    """Of a few candidates, the vantage point with the widest spread of distances, and their median."""
    some = marks[:: max(1, len(marks) // 1024)]
    points = some[:: max(1, len(some) // 12)]
    far = np.bitwise_count(points[:, None] ^ some[None, :])
    best = int(far.std(axis=1).argmax())
    return points[best], int(np.median(far[best]))


def _sides(marks: np.ndarray, point: np.uint64, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Members within ``reach`` of the inside, and of the outside, of the ball; both for those near its surface."""
    away = np.bitwise_count(marks ^ point).astype(np.int64)
    return away <= radius + reach, away + reach > radius


class Tree:
    """Vantage-point tree over a sample: node k has a point, a radius and two children; ~c is shard c."""

    def __init__(self, sample: np.ndarray, leaf: int, reach: int) -> None:
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.shards, self.reach = 0, reach
        self.root = self._grow(sample, leaf)

    def _grow(self, marks: np.ndarray, leaf: int) -> int:
        if len(marks) > leaf:
            point, radius = _vantage(marks)
            inside, outside = _sides(marks, point, radius, self.reach)
            if max(inside.sum(), outside.sum()) < 0.95 * len(marks):
                own = len(self.nodes)
                self.nodes.append((point, radius, 0, 0))
                self.nodes[own] = (point, radius, self._grow(marks[inside], leaf), self._grow(marks[outside], leaf))
                return own
        self.shards += 1
        return -self.shards

    def shards_of(self, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, members): each member in its own shard and in all that its ball overlaps."""
        stack = [(self.root, np.arange(len(marks)))]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            if node < 0:
                yield -node, own
                continue
            point, radius, left, right = self.nodes[node]
            inside, outside = _sides(marks[own], point, radius, self.reach)
            stack += [(left, own[inside]), (right, own[outside])]


def near_links(marks: np.ndarray, most: int) -> np.ndarray:
    """For each fingerprint the least position it is linked with, directly or over others.

    Splits at vantage points while that shrinks the parts, then compares blocks.
    """
    label = np.arange(len(marks))
    stack = [np.arange(len(marks))]
    while stack:
        own = stack.pop()
        if len(own) > 512:
            inside, outside = _sides(marks[own], *_vantage(marks[own]), (most + 1) // 2)
            if max(inside.sum(), outside.sum()) < 0.9 * len(own):
                stack += [own[inside], own[outside]]
                continue
        for at in range(0, len(own), 512):
            rows = own[at : at + 512]
            for to in range(at, len(own), 512):
                cols = own[to : to + 512]
                a, b = np.nonzero(np.bitwise_count(marks[rows][:, None] ^ marks[cols][None, :]) <= most)
                a, b = rows[a], cols[b]
                new = label[a] != label[b]
                if new.any():
                    label = forest(len(marks), np.r_[np.arange(len(marks)), a[new]], np.r_[label, b[new]])
    return label


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """The first column of small batches in arrays of about ``most`` unsigned numbers."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        size += len(held[-1])
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def near_pairs(marks: DataFrame, most: int = 2) -> DataFrame:
    """Links ``a``, ``b`` that join the distinct fingerprints ``fp`` within ``most`` bits as all pairs would.

    Two marks within ``most`` bits have a point between them within half of that, rounded up,
    of both, so the shard of that point gets both: each mark goes to every shard that a ball of
    that radius overlaps (triangle inequality). The tree is fitted on
    ``TREE_SAMPLE`` marks; all marks go through it. Shards over ``TASK_ROWS`` are compared in pairs of blocks.
    """
    spark = marks.sparkSession
    total = marks.count()
    sample = [r.fp for r in marks.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()]
    points = np.array(sample, dtype=np.int64).view(np.uint64)
    reach = (most + 1) // 2
    tree = spark.sparkContext.broadcast(
        Tree(points, max(8, SHARD_ROWS * len(points) // max(1, total)), reach)
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Many marks go down the tree together: a node costs about the same for one as for a thousand.
        for own in _gathered(batches, 1 << 17):
            for shard, members in tree.value.shards_of(own):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(members), shard, np.int32)), pa.array(own[members].view(np.int64))],
                    ["shard", "fp"],
                )

    dealt = cut(marks.select("fp").mapInArrow(deal, "shard int, fp long"), "shards")
    blocks = cut(dealt.groupBy("shard").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")),
    )

    def compare(table: pa.Table) -> pa.Table:
        own = np.unique(table.column("fp").to_numpy().view(np.uint64))
        label = near_links(own, most)
        linked = np.nonzero(label != np.arange(len(own)))[0]
        a, b = own[linked].view(np.int64), own[label[linked]].view(np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return (
        dealt.join(blocks, "shard")
        .withColumn("block", block)
        .select("shard", "fp", F.explode(pairs).alias("p"))
        .groupBy("shard", "p.i", "p.j")
        .applyInArrow(compare, "a long, b long")
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2
) -> DataFrame:
    """``id``, ``fp`` and ``component_id`` of every row.

    Fingerprints link at ``most`` or fewer differing bits; ``component_id`` is the smallest id reachable.
    Null, empty and blank texts have the fingerprint zero, which links like any other. Rows
    without an id get a component too; its id is null only if none of its rows has one.
    Repeated rows and ids are kept. An empty table gives an empty result.

    Equal fingerprints are one node from the start, so a large group of copies costs one comparison.
    """
    kept = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = cut(kept.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(near_pairs(nodes, most))
    rooted = cut(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "roots",
    )
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    # Of written tables, so that joins shuffle both sides by themselves and Spark can split a hot fingerprint.
    classes = cut(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return kept.join(classes, "fp").select("id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """A signed long as 16 lowercase hex digits of its bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
