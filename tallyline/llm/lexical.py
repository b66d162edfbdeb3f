"""Ranked lexical search over per-term blocks of similar documents with coordinatewise-maximum summaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.blocks import Best, first_of_each, ids_of
from tallyline.llm.common import cut, small_batches

# Bytes of UTF-8 that belong to terms stay, with A-Z lower-cased; the others become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Items are searched for together while they hold at most so many terms; their vocabulary is sent to all tasks.
TERMS_AT_ONCE = 1 << 20
# Documents that are scored first for each item hold one of its rarest terms: so many at least, if there are.
SEEDS = 300
# Documents of a piece of the index, and of a block of one term's list within it.
PIECE, BLOCK = 8_192, 24
AXES = 16


def _split(text: pa.Scalar) -> list[bytes]:
    data = text.as_py()
    return data.translate(LETTERS).split() if data else []


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(_split(t))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(terms, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    rows = items.select(
        F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")
    )
    return cut(rows.mapInArrow(of, f"item long, item_id {rows.schema['item_id'].dataType.simpleString()}, terms array<binary>"), "items")


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit words, one a term number."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _sketch(terms: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Random projection of each document's terms to ``AXES`` numbers, of length one (or zero)."""
    signs = (_mixed(terms)[:, None] >> np.arange(AXES, dtype=np.uint64) & np.uint64(1)).astype(np.float32) * 2 - 1
    sums = np.zeros((len(start) - 1, AXES), np.float32)
    full = np.nonzero(np.diff(start))[0]
    if len(full):
        sums[full] = np.add.reduceat(signs * weight[:, None].astype(np.float32), start[full])
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(length > 0, length, 1)


def _count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of each document with a term its number of terms, and which terms of the vocabulary it holds how often.

    ``code`` has the signs of the sketch, so that similar documents sort near each other.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, totals, terms, often = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                words = _split(text)
                if words:
                    held = Counter([t for t in words if t in known])
                    rows.append(row)
                    totals.append(len(words))
                    terms.append([known[t] for t in held])
                    often.append(list(held.values()))
            start = np.r_[0, np.cumsum([len(t) for t in terms], dtype=np.int64)]
            flat = lambda lists: np.array([x for one in lists for x in one], np.int64)
            sketch = _sketch(flat(terms), np.sqrt(flat(often)), start)
            code = (sketch > 0) @ (1 << np.arange(AXES))[::-1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(rows, pa.int64())) for c in ("uid", "id")], pa.array(totals, pa.int64()),
                    pa.array(code, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64())),
                ],
                ["uid", "id", "n", "code", "terms", "often"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")
    )
    schema = "uid long, id long, n long, code long, terms array<int>, often array<long>"
    return cut(rows.mapInArrow(of, schema), "forward")


class _Piece:
    """Some documents with the impacts of their terms, by document and by term."""

    def __init__(self, table: pa.Table, weights: np.ndarray, documents: int, length: int):
        column = lambda c: table.column(c).combine_chunks()
        self.uid = column("uid").to_numpy()
        ids = column("id")
        self.id, self.null = ids.fill_null(np.iinfo(np.int64).max).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        lists = column("terms")
        self.terms = lists.flatten().to_numpy().astype(np.int64)
        self.often = column("often").flatten().to_numpy()
        self.start = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
        spread = 10 + 90 * column("n").to_numpy() * documents // length
        self.doc = np.repeat(np.arange(len(self.uid)), np.diff(self.start))
        self.impact = weights[self.terms] * (1_000_000_000 * self.often // (1000 * self.often + 8 * spread[self.doc]))
        order = np.argsort(self.terms, kind="stable")
        held, first = np.unique(self.terms[order], return_index=True)
        self.by_doc, self.by_impact = self.doc[order], self.impact[order]
        self.places = dict(zip(held.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.places.get(term, (0, 0))
        return self.by_doc[low:high], self.by_impact[low:high]

    def scores(self, terms: list[int]) -> np.ndarray:
        total = np.zeros(len(self.uid), np.int64)
        for term in terms:
            docs, impact = self.postings(term)
            total[docs] += impact
        return total


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PIECE:
            yield pa.Table.from_batches(held)
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _over_pieces(frame: DataFrame, work: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """Apply ``work() -> (take, finish)`` to the pieces of each partition; ``take`` yields batches, ``finish`` the last ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, finish = work()
        for table in _pieces(batches):
            yield from take(table)
        yield from finish()

    return frame.mapInArrow(of, schema)


def _found(best: Best) -> pa.RecordBatch:
    lone = [pa.array(best.group, pa.int64()), pa.array(best.uids, pa.int64()), pa.array(best.ids, pa.int64(), mask=best.null)]
    return pa.RecordBatch.from_arrays([*lone, pa.array(-best.key, pa.int64())], ["place", "uid", "id", "score"])


def _search(docs: DataFrame, items: list[list[int]], vocabulary: dict[bytes, int], id_col: str, text_col: str, top: int) -> DataFrame:
    """``place`` of an item in the list, ``uid``, ``id``, ``score``: the best documents of the items, some more among them."""
    spark = docs.sparkSession
    forward = _count_terms(docs, id_col, text_col, vocabulary)
    documents, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(vocabulary), np.int64)
    for row in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        held[row.t] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    length = max(1, length)

    # Any documents' scores bound the last place from below; those with an item's rarest terms bound it well.
    seeds: dict[int, set[int]] = {}
    for place, terms in enumerate(items):
        seen = 0
        for t in sorted((t for t in terms if held[t]), key=lambda t: (held[t], t)):
            seeds.setdefault(place, set()).add(t)
            seen += held[t]
            if seen >= SEEDS:
                break
    shared = spark.sparkContext.broadcast((items, weights, seeds))

    def first_look() -> tuple:
        items, weights, seeds = shared.value
        best, most = Best(len(items), top, np.int64), np.zeros(len(weights), np.int64)

        def take(table: pa.Table) -> Iterator[pa.RecordBatch]:
            piece = _Piece(table, weights, documents, length)
            np.maximum.at(most, piece.terms, piece.impact)
            for place, own in seeds.items():
                docs = [piece.postings(t)[0] for t in own if t in piece.places]
                if docs:
                    docs = np.unique(np.concatenate(docs))
                    score = piece.scores(items[place])[docs]
                    kept = first_of_each(np.zeros(len(docs), np.int64), top, -score)
                    docs, score = docs[kept], score[kept]
                    best.add(np.full(len(docs), place), -score, piece.id[docs], piece.null[docs], piece.uid[docs])
            return iter(())

        def finish() -> Iterator[pa.RecordBatch]:
            known = np.nonzero(most)[0]
            for kind, key, value in ((0, known, most[known]), (1, best.group, -best.key)):
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(key), pa.int32()), "key": pa.array(key, pa.int64()), "value": pa.array(value, pa.int64())})

        return take, finish

    looked = cut(_over_pieces(forward.drop("code"), first_look, "kind int, key long, value long"), "bounds")
    most = np.zeros(len(vocabulary), np.int64)
    for row in looked.filter("kind = 0").groupBy("key").agg(F.max("value").alias("value")).collect():
        most[row.key] = row.value
    floors = np.zeros(len(items), np.int64)
    order = Window.partitionBy("key").orderBy(F.desc("value"))
    for row in looked.filter("kind = 1").withColumn("r", F.row_number().over(order)).filter(F.col("r") == top).collect():
        floors[row.key] = row.value

    # A document that reaches the floor holds a term beyond those whose largest impacts together stay below it.
    wanted: dict[int, list[int]] = {}
    for place, terms in enumerate(items):
        total = 0
        for t in sorted((t for t in terms if most[t]), key=lambda t: (most[t], t)):
            total += int(most[t])
            if total >= floors[place]:
                wanted.setdefault(t, []).append(place)
    sent = spark.sparkContext.broadcast((items, weights, wanted, floors))

    def build() -> tuple:
        items, weights, wanted, _ = sent.value

        def take(table: pa.Table) -> Iterator[pa.RecordBatch]:
            piece = _Piece(table, weights, documents, length)
            sketch = _sketch(piece.terms, piece.impact / 1e6, piece.start)
            rows = [_list_blocks(piece, sketch, t, sorted({c for p in wanted[t] for c in items[p]})) for t in piece.places if t in wanted]
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                arrays = [pa.array([r[0] for r in part], pa.int32())]
                arrays += [pa.array([r[k] for r in part], pa.list_(pa.int64() if k in (1, 5) else pa.int32())) for k in range(1, 6)]
                yield pa.RecordBatch.from_arrays(arrays, ["term", "uid", "size", "block", "coordinate", "summary"])

        return take, lambda: iter(())

    # Similar documents side by side, so that pieces, and lists within them, hold similar ones.
    pieces = max(1, -(-documents // PIECE))
    near = forward.repartitionByRange(pieces, "code", "uid").sortWithinPartitions("code", "uid").drop("code")
    schema = "term int, uid array<long>, size array<int>, block array<int>, coordinate array<int>, summary array<long>"
    index = cut(_over_pieces(near, build, schema), "index")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, _, wanted, floors = sent.value
        for batch in batches:
            for i, term in enumerate(batch.column("term").to_pylist()):
                size, block, coordinate, summary, uid = (
                    batch.column(c)[i].values.to_numpy() for c in ("size", "block", "coordinate", "summary", "uid")
                )
                coordinates, at = np.unique(coordinate, return_inverse=True)
                tops = np.zeros((len(size), len(coordinates)), np.int64)
                tops[block, at] = summary
                of = np.repeat(np.arange(len(size)), size)
                for place in wanted[term]:
                    own = np.isin(coordinates, items[place])
                    opened = tops[:, own].sum(axis=1) >= max(1, floors[place])
                    if opened.any():
                        docs = uid[opened[of]]
                        yield pa.RecordBatch.from_pydict({"uid": pa.array(docs), "place": pa.array(np.full(len(docs), place, np.int32))})

    opened = index.mapInArrow(judge, "uid long, place int").groupBy("uid").agg(F.collect_set("place").alias("places"))
    read = forward.drop("code").join(cut(opened, "opened"), "uid")

    def score() -> tuple:
        items, weights, _, _ = sent.value
        best = Best(len(items), top, np.int64)

        def take(table: pa.Table) -> Iterator[pa.RecordBatch]:
            piece = _Piece(table, weights, documents, length)
            lists = table.column("places").combine_chunks()
            doc = np.repeat(np.arange(len(piece.uid)), lists.value_lengths().to_numpy())
            place = lists.flatten().to_numpy()
            order = np.argsort(place, kind="stable")
            held, first = np.unique(place[order], return_index=True)
            for p, docs in zip(held.tolist(), np.split(doc[order], first[1:])):
                total = piece.scores(items[p])[docs]
                docs, total = docs[total > 0], total[total > 0]
                kept = first_of_each(np.zeros(len(docs), np.int64), top, -total, piece.null[docs], piece.id[docs], piece.uid[docs])
                docs, total = docs[kept], total[kept]
                best.add(np.full(len(docs), p), -total, piece.id[docs], piece.null[docs], piece.uid[docs])
            return iter(())

        return take, lambda: iter([_found(best)])

    return _over_pieces(read, score, "place long, uid long, id long, score long")


def _list_blocks(piece: _Piece, sketch: np.ndarray, term: int, coordinates: list[int]) -> tuple:
    """A term's documents by blocks around evenly spaced leaders, and each block's largest impact on each coordinate."""
    docs, _ = piece.postings(term)
    leaders = docs[:: BLOCK]
    label = np.argmax(sketch[docs] @ sketch[leaders].T, axis=1)
    used, label = np.unique(label, return_inverse=True)
    order = np.argsort(label, kind="stable")
    of = np.full(len(piece.uid), -1)
    of[docs] = label
    tops = np.zeros((len(used), len(coordinates)), np.int64)
    for k, c in enumerate(coordinates):
        held, impact = piece.postings(c)
        block = of[held]
        np.maximum.at(tops[:, k], block[block >= 0], impact[block >= 0])
    block, at = np.nonzero(tops)
    return term, piece.uid[docs[order]], np.bincount(label), block, np.array(coordinates)[at], tops[block, at]


def rank(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", top: int = 10,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``: the ``top`` documents of each item with a score above 0.

    Terms are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased; an item's score
    for a document sums over the item's distinct terms a weight by rarity times a saturating, length-normalised
    count, in whole numbers. Equal scores go to the smaller id, rows without an id last, then to the earlier row. Null and empty texts
    have no terms: as documents they count nowhere, as items they get no rows. Repeated rows count one by one, as
    documents and as items. Whole texts are read, however long. Empty tables give an empty result; extra columns are not read.

    Every list of a term that can lift a document into an item's results is cut into blocks of similar documents;
    a block keeps the largest impact on each coordinate that items with the term ask for. A block is opened for
    an item unless the sum of its summary over the item's terms is below the item's floor, the last place among documents
    that hold its rarest terms. Both bounds are exact, so nothing is lost. Documents of opened blocks are scored whole.
    Items whose terms together are more than ``TERMS_AT_ONCE`` are searched for in several rounds.
    """
    spark = docs.sparkSession
    named = _item_terms(items, item_id_col, item_text_col)
    total = named.agg(F.sum(F.size("terms"))).first()[0] or 0
    rounds = -(-max(1, total) // TERMS_AT_ONCE)
    results = []
    for k in range(rounds):
        # Bounded by TERMS_AT_ONCE or so: the terms of one round's items.
        local = named.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == k).select("item", "terms").collect()
        vocabulary = {t: n for n, t in enumerate(sorted({bytes(t) for r in local for t in r.terms}))}
        if not vocabulary:
            continue
        places = spark.createDataFrame([(p, r.item) for p, r in enumerate(local)], "place long, item long")
        found = _search(docs, [[vocabulary[bytes(t)] for t in r.terms] for r in local], vocabulary, id_col, text_col, top)
        results.append(cut(found, "found").join(places, "place").drop("place"))
    if not results:
        results = [spark.createDataFrame([], "uid long, id long, score long, item long")]
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
