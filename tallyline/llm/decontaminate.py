"""Find training documents that hold test items, verbatim, paraphrased or edited.

Word n-grams of the items seed candidate passages; a Smith-Waterman alignment
of passage and item decides, once for each distinct pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import cut, small_batches

# Words of a seed.
GRAM = 4
# An n-gram that more items hold is no seed, unless the item has none that is rarer.
RARE = 8
# Items whose lengths have as many digits to this base share a margin.
LENGTHS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
# Bits of the filter that items' n-grams are held against: a fixed size, 4 MB.
FILTER_BITS = 25
# Words that a worker remembers.
MEMORY = 300_000
_words = re.compile(r"\w+").findall
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_PROBES = (0, 20, 39)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_hashes = _Hashes()


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; case, punctuation and spacing don't count."""
    return _words((text or "").lower())


def grams_of(words: list[str]) -> np.ndarray:
    """A 64-bit number for each run of GRAM words."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([_hashes[w] for w in words], dtype=np.uint64)
    mixed = sum((h[k : k + n] * _FACTORS[k] for k in range(GRAM)), np.zeros(n, dtype=np.uint64))
    return mixed ^ (mixed >> np.uint64(29))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items of at least GRAM words: ``item``, ``words``, their ``n`` and their distinct ``grams``."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if len(words) >= GRAM:
                    take.append(k)
                    rows.append((" ".join(words), len(words), np.unique(grams_of(words)).view(np.int64)))
            columns = list(zip(*rows)) or [()] * 3
            types = [pa.string(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int32())), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                ["item", "words", "n", "grams"],
            )

    return benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("t")).mapInArrow(
        of, f"item {kind}, words string, n int, grams array<long>"
    )


def _key(words: str) -> Column:
    """128 bits that stand for the words."""
    return F.unhex(F.md5(words))


def _filter(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of the items' n-grams, put together by Spark; at most 2^FILTER_BITS / 64 rows come back."""
    mask = (1 << FILTER_BITS) - 1
    bits = F.array(*[F.shiftrightunsigned("gram", p).bitwiseAND(F.lit(mask)) for p in _PROBES])
    rows = (
        grams.select(F.explode(bits).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .collect()
    )
    found = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in rows:
        found[row.word] = row.bits
    return found.view(np.uint64)


def _seeds(kinds: DataFrame) -> DataFrame:
    """``kind``, ``gram`` and ``size`` (the item's length class): n-grams that few items hold.

    An item without such n-grams keeps those of its own that the fewest items hold, so every item has seeds.
    """
    grams = kinds.select("kind", F.ceil(F.log(float(LENGTHS), F.col("n").cast("double"))).cast("int").alias("size"), F.explode("grams").alias("gram"))
    holders = cut(grams.groupBy("gram").agg(F.count("*").alias("held")), "holders")
    counted = grams.join(holders, "gram")
    rarest = cut(counted.groupBy("kind").agg(F.min("held").alias("fewest")), "rarest")
    return cut(counted.join(rarest, "kind").filter(F.col("held") <= F.greatest(F.lit(RARE), "fewest")).select("kind", "gram", "size"), "seeds")


def _passages(docs: DataFrame, grams: DataFrame, margins: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """Passages around seeds, for each class of items' lengths: words and which seeds; one reading of all texts.

    Seeds within the class's margin of each other share a passage, which reaches that many words further on both sides.
    """
    small_batches(docs.sparkSession)
    filters = {size: _filter(grams.filter(F.col("size") == size)) for size in margins}
    bits = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        mask = np.uint64((1 << FILTER_BITS) - 1)
        for batch in batches:
            take, rows = [], []
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                own = grams_of(words)
                probes = [(own >> np.uint64(p)) & mask for p in _PROBES]
                for size, held in bits.value.items():
                    hit = np.ones(len(own), dtype=bool)
                    for bit in probes:
                        hit &= (held[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
                    at = np.nonzero(hit)[0]
                    if not len(at):
                        continue
                    margin = margins[size]
                    for group in np.split(at, np.nonzero(np.diff(at) > margin)[0] + 1):
                        first = max(0, int(group[0]) - margin)
                        last = min(len(words), int(group[-1]) + GRAM + margin)
                        number += 1
                        take.append(k)
                        rows.append((number, first, " ".join(words[first:last]), np.unique(own[group]).view(np.int64), size))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int32())), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                ["id", "passage", "first", "words", "grams", "size"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        of, f"id {kind}, passage long, first long, words string, grams array<long>, size int"
    )


def align(passage: list[str], item: list[str]) -> tuple[int, int, int]:
    """Best local alignment: score, first word in the passage, and the word after its last.

    Rows of the table are items' words. A gap along a row is a running maximum, so a row is a few vector operations.
    """
    codes = {w: k for k, w in enumerate(dict.fromkeys(item))}
    words = np.array([codes.get(w, -1) for w in passage])
    along = np.arange(len(words) + 1) * -GAP
    score = np.zeros(len(words) + 1, dtype=np.int64)
    start = np.arange(len(words) + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(words == codes[word], MATCH, MISMATCH)
        fresh, origin = np.zeros_like(score), np.arange(len(words) + 1)
        diagonal = score[:-1] + step
        better = diagonal > fresh[1:]
        fresh[1:][better], origin[1:][better] = diagonal[better], start[:-1][better]
        down = score + GAP
        better = down > fresh
        fresh[better], origin[better] = down[better], start[better]
        run = np.maximum.accumulate(fresh + along)
        source = np.maximum.accumulate(np.where(fresh + along == run, np.arange(len(run)), 0))
        score, start = run - along, origin[source]
        end = int(score.argmax())
        if score[end] > best[0]:
            best = (int(score[end]), int(start[end]), end)
    return best


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", least: float = 0.5,
) -> DataFrame:
    """``id``, ``item``, ``score``, ``first_word``, ``end_word``: one row a document and item that it holds.

    ``score`` is the alignment's share of what the whole item would score against itself; ``least`` is the
    lowest that counts. Null and empty texts and items match nothing, as do items of fewer than GRAM
    words. Repeated rows of an id give one row an item, with the best score (of equal ones the
    first place); a null id is an id of its own. Equal items each get their rows. An empty table gives an empty result.

    Seeds are the n-grams that at most ``RARE`` items hold (an item that has none takes its rarest), however often the
    documents hold them. Passages reach as far as the longest item of the seed's length class asks for. Equal passages are aligned once with equal
    items, and only if they share the words that ``least`` takes; the result is joined back to all their documents and
    item ids. Only n-grams of items, found by a filter of fixed size, leave the reading of the texts. A seed that is in
    many passages and many items meets in a join that Spark can split.
    """
    items = cut(_items(benchmark, item_col, item_text_col).withColumn("kind", _key("words")), "items")
    kinds = items.groupBy("kind").agg(F.first("words").alias("item_words"), F.first("grams").alias("grams"), F.first("n").alias("n"))
    seeds = _seeds(kinds)
    # A number for each class of lengths that occurs; there are as many as an item's length has digits.
    longest = kinds.join(seeds.select("kind", "size").distinct(), "kind").groupBy("size").agg(F.max("n").alias("n"))
    margins = {r["size"]: r.n for r in longest.collect()}
    passages = cut(_passages(docs, seeds, margins, id_col, text_col).withColumn("text", _key("words")), "passages")
    firsts = passages.groupBy("text", "size").agg(F.min("passage").alias("passage")).select("passage")
    distinct = cut(
        passages.join(firsts, "passage", "left_semi").select("passage", "text", "words", "grams", "size"), "distinct-passages"
    )
    exploded = distinct.select("passage", "size", F.explode("grams").alias("gram"))
    found = exploded.join(seeds, ["gram", "size"]).select("passage", "kind").distinct()
    pairs = (
        found.join(distinct.select("passage", "text", "words"), "passage")
        .join(kinds.select("kind", "item_words"), "kind")
        .select("text", "kind", "words", "item_words")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for k, (text, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                passage, words = text.split(" "), item.split(" ")
                # No alignment scores more than a match for each word that both have.
                if (Counter(passage) & Counter(words)).total() / len(words) < least:
                    continue
                points, at, end = align(passage, words)
                share = points / (MATCH * len(words))
                if share >= least:
                    take.append(k)
                    rows.append((share, at, end))
            columns = list(zip(*rows)) or [()] * 3
            kept = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept)]
                + [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.int64()))],
                ["text", "kind", "score", "at", "end"],
            )

    scored = pairs.mapInArrow(score, "text binary, kind binary, score double, at long, end long")
    placed = passages.select("text", "id", "first").join(cut(scored, "aligned"), "text").join(items.select("kind", "item"), "kind")
    first, end = F.col("first") + F.col("at"), F.col("first") + F.col("end")
    best = F.max(F.struct("score", (-first).alias("at"), end.alias("end_word"))).alias("b")
    return placed.groupBy("id", "item").agg(best).select(
        "id", "item", F.col("b.score").alias("score"), (-F.col("b.at")).alias("first_word"), "b.end_word"
    )
