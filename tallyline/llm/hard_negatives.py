"""Hard negatives of anchors, read from blocks along a Hilbert curve that zone maps cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.blocks import Best, first_of_each, ids_of, matrix, meet, numbers, packed, sound_rows
from tallyline.llm.common import cut

# Components on the curve, and bits of each.
AXES, BITS = 8, 6
CHUNK = 256
LONG = np.iinfo(np.int64)
# Below this, sums of products of whole numbers are exact in doubles.
EXACT = float(1 << 53)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below ``2 ** bits``; bits times columns must be under 64."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    # Undo the turns of the curve from the coarsest bit down, then write the bits of all axes in turn as a Gray code.
    for level in range(bits - 1, 0, -1):
        low, high = (1 << level) - 1, 1 << level
        for axis in range(axes):
            turned = (x[axis] & high) != 0
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    last = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        last ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= last
    place = np.zeros_like(last)
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            place = place << 1 | (x[axis] >> level & 1)
    return place


def _spreads(rows: DataFrame) -> DataFrame:
    """Per length the ``AXES`` components of largest variance, with their least and largest values.

    A row a task and length is summed up; the sums are joined by length.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                vec = batch.filter(pa.array(dims == dim)).column("vec")
                x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), dim)
                new = np.array([x.min(0), x.max(0), x.sum(0), (x * x).sum(0), np.full(dim, len(x))])
                old = held.get(dim)
                held[dim] = new if old is None else np.vstack([np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), old[2:] + new[2:]])
        for dim, sums in held.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "sums": pa.array([sums.ravel()], pa.list_(pa.float64()))})

    def whole(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        sums = np.array(table.column("sums").to_pylist()).reshape(len(table), 5, dim)
        low, high, (total, square, n) = sums[:, 0].min(0), sums[:, 1].max(0), sums[:, 2:].sum(0)
        with np.errstate(all="ignore"):
            spread = np.nan_to_num(square / n - (total / n) ** 2, nan=np.inf)
        axes = np.argsort(-spread, kind="stable")[:AXES]
        one = lambda a, t: pa.array([a], pa.list_(t))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "axes": one(axes.astype(np.int32), pa.int32()),
            "low": one(low[axes], pa.float64()), "high": one(high[axes], pa.float64()),
        })

    partial = rows.select("dim", "vec").mapInArrow(parts, "dim int, sums array<double>")
    return partial.groupBy("dim").applyInArrow(whole, "dim int, axes array<int>, low array<double>, high array<double>")


def _on_curve(rows: DataFrame) -> DataFrame:
    """Rows with their ``place`` on the curve through the components that differ most."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.zeros(batch.num_rows, np.int64)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims[dims > 0]):
                own = np.nonzero(dims == dim)[0]
                part = batch.take(pa.array(own))
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                axes, low, high = (np.array(part.column(c)[0].as_py()) for c in ("axes", "low", "high"))
                with np.errstate(all="ignore"):
                    cells = np.nan_to_num((x[:, axes] - low) / (high - low) * (1 << BITS))
                place[own] = hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(place)], [*batch.schema.names[:-3], "place"])

    joined = rows.join(cut(_spreads(rows), "spreads"), "dim")
    columns = [*rows.columns, "axes", "low", "high"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return joined.select(*columns).mapInArrow(of, f"{ddl}, place long")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; those beyond 64 bits count as the largest or smallest long."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -LONG.max, LONG.max).astype(np.int64)


def _zone(x: np.ndarray) -> dict[str, pa.Array]:
    one = lambda a: pa.array([a], pa.list_(pa.float64()))
    return {"low": one(x.min(axis=0)), "high": one(x.max(axis=0))}


def _bounds(x: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that a row within the block's zone map can have with each query."""
    low, high = numbers(block["low"]), numbers(block["high"])
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    with np.errstate(all="ignore"):
        # Rounding can only matter where sums are beyond exact doubles.
        slack = 1e-9 * (np.abs(x) @ np.maximum(np.abs(low), np.abs(high)))
        least, most = up @ low + down @ high - slack, up @ high + down @ low + slack
    return np.nan_to_num(least, nan=-np.inf), np.nan_to_num(most, nan=np.inf)


class _Asked:
    """The requests of one chunk; ``floor`` is the least score that can still count."""

    def __init__(self, chunk: dict):
        self.x = matrix(chunk)
        self.request, self.own = numbers(chunk["request"]), numbers(chunk["uid"])
        self.low, self.high, self.floor = (numbers(chunk[c]) for c in ("least", "most", "floor"))

    def reach(self, block: dict) -> np.ndarray:
        """Which requests must read the block, and how far up its scores may go."""
        least, most = _bounds(self.x, block)
        most = np.minimum(most, self.high)
        return np.where((most >= np.maximum(self.low, self.floor)) & (least <= self.high), most, -np.inf)


def _choose(pairs: DataFrame, chunks: DataFrame, zones: DataFrame) -> DataFrame:
    """``chunk``, ``block`` and ``reach`` (how far up scores may go for each request, minus infinity where the block cannot
    matter) of the blocks that some request of a chunk may have to read; ``first`` marks a request's most promising ones."""

    def begin(chunk: dict) -> tuple:
        asked, found = _Asked(chunk), {}
        top, which = np.full(len(asked.own), -np.inf), np.full(len(asked.own), -1)

        def take(block: dict) -> None:
            reach = asked.reach(block)
            if (reach > -np.inf).any():
                number = block["block"].as_py()
                found[number] = reach
                better = reach > top
                top[better], which[better] = reach[better], number

        def finish() -> pa.RecordBatch:
            number, first = chunk["block"].as_py(), set(which.tolist())
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([number] * len(found), pa.int64()), "block": pa.array(list(found), pa.int64()),
                "first": pa.array([n in first for n in found], pa.bool_()), "reach": pa.array(list(found.values()), pa.list_(pa.float64())),
            })

        return take, finish

    schema = "chunk long, block long, first boolean, reach array<double>"
    return cut(meet(pairs, chunks, zones, begin, schema), "chosen")


def _floors(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """Per chunk the scores that the last rows that count of its requests have in their most promising blocks: no row
    below them can count. A task hands on a row, and a chunk has a block a request at most."""

    def begin(chunk: dict) -> tuple:
        take, best, _ = _reader(chunk, limit)
        short = np.iinfo(np.int64).max

        def finish() -> pa.RecordBatch:
            floor = np.where(best.worst == short, -np.inf, -best.worst.astype(np.float64))
            return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk["block"].as_py()], pa.int64()), "floors": pa.array([floor], pa.list_(pa.float64()))})

        return take, finish

    found = cut(meet(pairs, chunks, blocks, begin, "chunk long, floors array<double>", order="rank"), "floors")
    none = F.transform(F.get("lists", F.lit(0)), lambda _: F.lit(float("-inf")))
    highest = F.aggregate("lists", none, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return found.groupBy("chunk").agg(F.collect_list("floors").alias("lists")).select("chunk", highest.alias("floor"))


def _reader(chunk: dict, limit: int) -> tuple:
    """``take`` reads a block for a chunk's requests into ``best``."""
    asked = _Asked(chunk)
    best = Best(len(asked.own), limit, np.int64)

    def take(block: dict) -> None:
        reach = asked.reach(block)
        wanted = np.nonzero((reach > -np.inf) & (-reach <= best.worst))[0]
        if not len(wanted):
            return
        (ids, null), uids = ids_of(block["id"]), numbers(block["uid"])
        scores = _products(asked.x[wanted], matrix(block))
        least = np.maximum(np.maximum(asked.low, asked.floor), -best.worst.astype(np.float64))[wanted]
        fits = (scores >= least[:, None]) & (scores <= asked.high[wanted][:, None]) & (asked.own[wanted][:, None] != uids)
        i, j = np.nonzero(fits)
        kept = first_of_each(i, limit, -scores[i, j], null[j], ids[j], uids[j])
        i, j = i[kept], j[kept]
        best.add(wanted[i], -scores[i, j], ids[j], null[j], uids[j])

    return take, best, asked


def _read(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """The best rows of the chosen blocks for each request, most promising blocks first."""

    def begin(chunk: dict) -> tuple:
        take, best, asked = _reader(chunk, limit)

        def finish() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "request": pa.array(asked.request[best.group], pa.int64()), "id": pa.array(best.ids, pa.int64(), mask=best.null),
                "uid": pa.array(best.uids, pa.int64()), "score": pa.array(-best.key, pa.int64()),
            })

        return take, finish

    found = meet(pairs, chunks, blocks, begin, "request long, id long, uid long, score long", order="rank")
    order = Window.partitionBy("request").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    ranked = cut(found, "read").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit)


def _search(requests: DataFrame, blocks: DataFrame, same: bool, limit: int) -> DataFrame:
    """``rank``, ``id``, ``uid`` and ``score`` of the best rows of each request.

    A request (``request``, ``uid`` and ``label`` of its anchor, ``vec``, ``dim``, scores ``least`` to ``most``) asks for
    rows of its own label, or of others. The most promising block of each is read first; the score of its
    last row that counts is the floor under which blocks need not be read.
    """
    lists = {"request": "long", "uid": "long", "least": "double", "most": "double"}
    keys = {"dim": "int", "label": "string"}
    count = -(-max(1, requests.count()) // CHUNK)
    ranged = requests.repartitionByRange(count, "dim", "label", "request").sortWithinPartitions("dim", "label", "request")
    unbounded = F.transform("least", lambda _: F.lit(float("-inf")))
    chunks = packed(ranged, keys, lists, "requests", rows=CHUNK)
    zones = blocks.select("block", "dim", "label", "n", "low", "high")
    c, z = chunks.select(F.col("block").alias("chunk"), "dim", F.col("label").alias("own")), zones.select("block", "dim", "label")
    on = (c["dim"] == z["dim"]) & ((c["own"] == z["label"]) if same else (c["own"] != z["label"]))
    start = chunks.withColumn("floor", unbounded)
    chosen = _choose(c.join(z, on).select("chunk", "block"), start, zones).withColumn("rank", F.array_max("reach"))
    floors = cut(_floors(chosen.filter("first"), start, blocks, limit), "floor")
    bounded = chunks.join(floors.withColumnRenamed("chunk", "block"), "block")
    needed = chosen.join(floors, "chunk").filter(F.exists(F.zip_with("reach", "floor", lambda r, f: (r > float("-inf")) & (r >= f)), lambda x: x))
    return _read(needed.select("chunk", "block", "rank"), bounded, blocks, limit)


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    scale: int = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Components become whole numbers ``floor(scale * x)``, scores are their inner products (as longs; beyond 64 bits the
    largest or smallest long). An anchor's positives are its first rows of the same label, its negatives for a positive the first
    rows of other labels whose score is ``window`` percent of the positive's; higher scores first, ties by smaller id,
    rows without an id last, then by earlier row. Rows with a null label or vector or a null or non-finite component take no
    part; rows meet rows of their own length only. A repeated row is another row, and a repeated anchor asks again. A positive of
    negative score has no negatives. Empty tables give an empty result; extra columns are not read.

    Rows are sorted by length, label and place on a Hilbert curve through the components that vary most, and written
    as Parquet in blocks of a row each, with the least and largest value of every component. What to
    read is chosen from those two columns by interval arithmetic; the vectors of a block are only
    read for anchors that may find something there.
    """
    label = F.col("label") if label is None else label
    rows = sound_rows(
        vectors.withColumn("_label", label.cast("string")).withColumn("_asks", F.coalesce(is_anchor, F.lit(False))).filter("_label is not null"),
        id_col, vector_col, True, label=F.col("_label"), asks=F.col("_asks"),
    )
    # Of the largest doubles, what scaling would make infinite stays the largest double.
    whole = F.transform("vec", lambda v: F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), v * float(scale))))
    rows = cut(_on_curve(rows.withColumn("vec", F.transform(whole, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)))), "curve")
    parts = max(1, -(-rows.count() // 4_096))
    ordered = rows.repartitionByRange(parts, "dim", "label", "place", "uid").sortWithinPartitions("dim", "label", "place", "uid")
    blocks = packed(
        ordered, {"dim": "int", "label": "string"}, {"id": "long", "uid": "long"}, "candidates", add=_zone,
        added="low array<double>, high array<double>",
    )
    anchors = rows.filter("asks").select(F.col("uid").alias("request"), "uid", "id", "label", "vec", "dim")
    open_ends = {"least": F.lit(float("-inf")), "most": F.lit(float("inf"))}
    near = _search(cut(anchors.withColumns(open_ends), "anchors"), blocks, True, positives)
    low, high = window
    near = cut(
        near.select(
            F.monotonically_increasing_id().alias("request"), F.col("request").alias("anchor"), F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            # A score s fits if low * p <= 100 * s <= high * p, in whole numbers.
            F.expr(f"cast(({low} * cast(score as decimal(20,0)) + 99) div 100 as double)").alias("least"),
            F.expr(f"cast(({high} * cast(score as decimal(20,0))) div 100 as double)").alias("most"),
        ).filter("positive_score >= 0"),
        "positives",
    )
    asked = near.join(anchors.select(F.col("uid").alias("anchor"), "uid", "label", "vec", "dim"), "anchor")
    found = _search(cut(asked.select("request", "uid", "label", "vec", "dim", "least", "most"), "windows"), blocks, False, negatives)
    named = near.join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    found = found.select("request", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(named, "request").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
