"""Place rows in shards by descending a weighted hash tree.

Each level draws one straw a child, longer for heavier children, from a hash
of the row's key and the child's name; the longest wins. A child whose weight grows
can only win rows it did not have, so rows move into the changed
subtree alone, and inside other subtrees nothing moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import cut


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def grid(shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """Shards of weight one, filling racks and regions in turn.

    The shard after a full region opens a region of its own; it then
    takes rows from all others and they exchange none.
    """
    room = racks * per_rack
    return [Shard(k, f"r{k // room}", f"k{k % room // per_rack}") for k in range(shards)]


def _straw(key: Column, name: str, weight: float) -> Column:
    """Length of a child's straw: log of a uniform draw over the weight, at most zero.

    The draw has 52 bits, so each of its values is a double of its own.
    """
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double")
    return F.ln((bits + 1) / F.lit(2.0**52)) / F.lit(float(weight))


def _draw(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The choice of the child with the longest straw; of equal straws the first child wins."""
    straws = {n: _straw(key, n, w) for n, (w, _) in children.items()}
    if len(straws) == 1:
        return next(c for _, c in children.values())
    top = F.greatest(*straws.values())
    chosen = None
    for name, (_, below) in children.items():
        chosen = F.when(straws[name] == top, below) if chosen is None else chosen.when(straws[name] == top, below)
    return chosen


def descend(key: Column, shards: Sequence[Shard]) -> Column:
    """The shard number of a key: region, then rack, then shard; weights add up from below."""
    tree: dict[str, dict[str, list[Shard]]] = {}
    for shard in shards:
        if shard.weight > 0:
            tree.setdefault(shard.region, {}).setdefault(shard.rack, []).append(shard)
    total = lambda rack: sum(s.weight for s in rack)
    regions = {}
    for region, racks in tree.items():
        below = {
            f"{region}/{rack}": (
                total(own),
                _draw(key, {f"{region}/{rack}/{s.number}": (s.weight, F.lit(s.number)) for s in own}),
            )
            for rack, own in racks.items()
        }
        regions[region] = (sum(w for w, _ in below.values()), _draw(key, below))
    return _draw(key, regions)


def place(
    docs: DataFrame, shards: Sequence[Shard], grown: Sequence[Shard], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return ``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    Only the id and the tree decide. A null id is a key of its own; repeated ids share a
    shard and get a slot each. A null text has size 1 and the checksum
    of nothing. An empty table gives no rows; other columns play no part.

    Slots are gapless in a shard without bringing it to one task: rows are
    numbered inside each written part, and parts are put one behind the other by counts.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        descend(F.col(id_col), shards).alias("shard"),
        descend(F.col(id_col), grown).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at"),
    )
    placed = cut(placed, "placed")
    starts = (
        placed.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "start",
            F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("shard", "part", F.coalesce("start", F.lit(0)).alias("start"))
    )
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at"))
    return (
        placed.withColumn("local", local)
        .join(starts, ["shard", "part"])
        .select(
            "id",
            "size",
            "text_crc32",
            "shard",
            (F.col("start") + F.col("local") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
