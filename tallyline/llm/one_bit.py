"""Nearest vectors by randomly rotated one-bit codes, with exact distances for what the codes cannot rule out."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.blocks import Best, ids_of, matrix, meet, numbers, packed, sound_rows
from tallyline.llm.common import cut

# Bits of a code at least; short vectors get more bits than components, which narrows the bounds.
LEAST_BITS = 256
# Width of the error bounds in standard deviations of an estimate.
MARGIN = 4.0
CHUNK = 256
# Pairs that are measured at once.
PAIRS = 1 << 15


@functools.lru_cache(maxsize=4)
def _rotation(dim: int, seed: int) -> np.ndarray:
    """``bits`` x ``dim``: the first columns of a random rotation of ``bits`` dimensions, the same in every task."""
    bits = max(LEAST_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def _codes(x: np.ndarray, seed: int) -> dict[str, pa.Array]:
    """Centre of a block, and of each row its packed signs, distance from the centre and the cosine of code and row."""
    with np.errstate(all="ignore"):
        centre = x.mean(axis=0)
        centre = centre if np.isfinite(centre).all() else np.zeros(x.shape[1])
        rest = x - centre
        norm = np.linalg.norm(rest, axis=1)
        turned = rest @ _rotation(x.shape[1], seed).T
        fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / norm
    fit = np.where(norm > 0, fit, 1.0)
    one = lambda a: pa.array([a], pa.list_(pa.float64()))
    bits = np.packbits(turned >= 0, axis=1)
    return {"centre": one(centre), "norm": one(norm), "fit": one(fit), "bits": pa.array([bits.tobytes()], pa.binary())}


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares added in the order of the components; no overflow in between."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = x - y
        scale = np.frexp(np.abs(gap).max(axis=1, initial=0.0))[1][:, None]
        total = np.cumsum(np.square(np.ldexp(gap, -scale)), axis=1)[:, -1]
        return np.ldexp(np.sqrt(total), scale[:, 0])


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 10,
    margin: float = MARGIN, seed: int = 42,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id`` and ``score`` of the ``top`` nearest rows of every query row.

    Nearness is Euclidean distance in double precision, ties go to the smaller id, then to the earlier row; rows without an id
    come last among ties. A row is never its own neighbour, but a repeated row is. Vectors that are null, empty or zero or hold
    null or non-finite components take no part; vectors meet only those of their own length. Queries with
    fewer candidates get all of them. Empty tables give an empty result; extra columns are not read.

    Rows are packed into blocks where they lie, without a shuffle. A row's code holds the signs of its randomly rotated
    offset from the block's centre, beside two scalars: its length and its cosine with the code. The inner product with a
    query is estimated from the bits, and an error of more than ``margin`` deviations is taken as impossible: a row is measured
    exactly only if its least possible distance is within the worst one kept. All rows are indexed; nothing is fitted.
    """
    rows = sound_rows(vectors.withColumn("_asks", F.coalesce(is_query, F.lit(False))), id_col, vector_col, False, asks=F.col("_asks"))
    lists = {"id": "long", "uid": "long"}
    blocks = packed(
        rows.sortWithinPartitions("dim"), {"dim": "int"}, lists, "codes", add=lambda x: _codes(x, seed),
        added="centre array<double>, norm array<double>, fit array<double>, bits binary",
    )
    asking = rows.filter("asks")
    count = -(-max(1, asking.count()) // CHUNK)
    chunks = packed(asking.repartition(count).sortWithinPartitions("dim"), {"dim": "int"}, lists, "queries", rows=CHUNK)
    pairs = chunks.select(F.col("block").alias("chunk"), "dim").join(blocks.select("block", "dim"), "dim").drop("dim")

    def begin(chunk: dict) -> tuple:
        dim = chunk["dim"].as_py()
        asked, own = matrix(chunk), numbers(chunk["uid"])
        asked_ids, _ = ids_of(chunk["id"])
        best = Best(len(own), top)

        def take(block: dict) -> None:
            x, (ids, null), uids = matrix(block), ids_of(block["id"]), numbers(block["uid"])
            centre, norm, fit = numbers(block["centre"]), numbers(block["norm"]), numbers(block["fit"])
            turn = _rotation(dim, seed)
            count = turn.shape[0]
            signs = np.unpackbits(np.frombuffer(block["bits"].as_py(), np.uint8)).reshape(-1, count) * 2.0 - 1.0

            def measure(i: np.ndarray, j: np.ndarray) -> None:
                for at in range(0, len(i), PAIRS):
                    a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                    best.add(a, distances(x[b], asked[a]), ids[b], null[b], uids[b])

            with np.errstate(all="ignore"):
                gap = asked - centre
                size = np.linalg.norm(gap, axis=1)[:, None]
                inner = ((gap @ turn.T) @ signs.T) / np.sqrt(count) / fit * norm
                spread = norm * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit * (margin / np.sqrt(count - 1)) * size
                middle = norm * norm + size * size - 2 * inner
                least = middle - 2 * spread - 1e-9 * (norm * norm + size * size)
            other = own[:, None] != uids[None, :]
            middle = np.where(other & ~np.isnan(middle), middle, np.inf)
            # The likeliest rows first, so that the bound is near its end value when the others are judged.
            likely = np.zeros(other.shape, bool)
            np.put_along_axis(likely, np.argpartition(middle, min(top, len(uids)) - 1, axis=1)[:, :top], True, axis=1)
            worst = lambda: np.square(best.worst)[:, None]
            measure(*np.nonzero(likely & other & ~(least > worst())))
            measure(*np.nonzero(~likely & other & ~(least > worst() * (1 + 1e-9))))

        def finish() -> pa.RecordBatch:
            lone = [best.ids, best.uids, best.key]
            given = [pa.array(asked_ids[best.group]), pa.array(own[best.group]), *[pa.array(a) for a in lone]]
            given[2] = pa.array(best.ids, mask=best.null)
            return pa.RecordBatch.from_arrays(given, ["query_id", "query_uid", "id", "uid", "score"])

        return take, finish

    found = meet(pairs, chunks, blocks, begin, "query_id long, query_uid long, id long, uid long, score double")
    order = Window.partitionBy("query_uid").orderBy("score", F.col("id").asc_nulls_last(), "uid")
    ranked = cut(found, "nearest").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "id", "score")
