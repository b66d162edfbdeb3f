"""Pack token sequences of whole documents: exact complements first, best fit for the rest."""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import cut, small_batches

# Chunks of text whose ids a worker remembers.
MEMORY = 300_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_encoders: dict[str, Encoder] = {}


class Encoder(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of chunks of text between white space.

    The tokenizer never joins text across white space, so a document's ids are those of its chunks.
    Letters up to U+00FF followed by ASCII punctuation go to the tokenizer's model directly, as its own splitting
    would send them; every other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = re.compile(rf"([{_LETTERS}]+)([!-&(-/:;=>?@\[-`{{-~]*)").fullmatch

    def _model(self, part: str) -> bytes:
        if part not in self:
            shown = part if part.isascii() else self.bytes_of.pre_tokenize_str(part)[0][0]
            self[part] = b"".join(t.id.to_bytes(4, "little") for t in self.whole.model.tokenize(shown))
        return self[part]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > MEMORY:
            self.clear()
        if found := self.plain(chunk):
            word, marks = found.group(1).lower(), found.group(2)
            ids = self._model(word)
            if marks:
                # Runs of punctuation that follow letters have no case and are a piece of their own.
                ids += self._model(marks)
        else:
            ids = b"".join(i.to_bytes(4, "little") for i in self.whole.encode(chunk, add_special_tokens=False).ids)
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        chunks = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")
        return b"".join([self[c] for c in chunks.split(" ") if c])


def encoder(path: str) -> Encoder:
    """One encoder a worker process; it keeps its memory from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Every document's pieces, with the partition they were made in and their rank there among equal lengths."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "local"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            take, rows = [], []
            for k, text in enumerate(batch.column(1)):
                data = memoryview(encode(text.as_py() or "") + end)
                for number, at in enumerate(range(0, len(data) // 4, capacity)):
                    own = data[at * 4 : (at + capacity) * 4]
                    length = len(own) // 4
                    take.append(k)
                    rows.append((number, at, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int32())), *map(pa.array, columns, types)], names
            )

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, local long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(of, schema)


class Plan:
    """Patterns of lengths, how often each is used, and the ranks of each length it takes."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._exact()
        self._best_fit()

    def _pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths of a sum, the larger as large as can be."""
        if total < 2:
            return None
        small = np.arange(1, total // 2 + 1)
        good = small[(self.left[small] > 0) & (self.left[total - small] > 0)]
        for x in good[:2].tolist():
            if total - x != x or self.left[x] > 1:
                return total - x, x
        return None

    def _complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill a gap exactly."""
        if gap < 1:
            return None
        if self.left[gap] > 0:
            return (gap,)
        if pair := self._pair(gap):
            return pair
        there = np.nonzero(self.left[:gap])[0]
        if not len(there):
            return None
        # Index of pair sums: which sums two available lengths give.
        mark = np.zeros(2 * (gap + 1), dtype=np.float64)
        mark[there] = 1
        wave = np.fft.rfft(mark)
        sums = np.fft.irfft(wave * wave, len(mark))[: gap + 1] > 0.5
        for x in there[sums[gap - there]][::-1].tolist():
            self.left[x] -= 1
            pair = self._pair(gap - x)
            self.left[x] += 1
            if pair:
                return (x, *pair)
        return None

    def _use(self, pattern: tuple[int, ...]) -> bool:
        """Take a pattern as often as all its lengths last."""
        times = min(int(self.left[n]) // k for n, k in Counter(pattern).items())
        for n in pattern:
            self.left[n] -= times
        if times:
            self.patterns.append((pattern, times))
        return times > 0

    def _exact(self) -> None:
        """From the longest down, consume combinations that fill a sequence exactly; each use exhausts a length."""
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                self.left[length] -= 1
                rest = () if length == self.capacity else self._complement(self.capacity - length)
                self.left[length] += 1
                if rest is None or not self._use((length, *rest)):
                    break

    def _best_fit(self) -> None:
        """What is left, longest first, into the open sequence with the least room that is enough."""
        opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        rooms: list[int] = []

        def put(pattern: tuple[int, ...], times: int) -> None:
            room = self.capacity - sum(pattern)
            if room not in opened:
                opened[room] = []
                bisect.insort(rooms, room)
            opened[room].append((pattern, times))

        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                k = bisect.bisect_left(rooms, length)
                if k == len(rooms):
                    each = self.capacity // length
                    full, rest = divmod(n, each)
                    if full:
                        put((length,) * each, full)
                    if rest:
                        put((length,) * rest, 1)
                    break
                pattern, times = opened[rooms[k]].pop()
                if not opened[rooms[k]]:
                    del opened[rooms.pop(k)]
                used = min(times, n)
                put((*pattern, length), used)
                if times > used:
                    put(pattern, times - used)
                n -= used
            self.left[length] = 0
        self.patterns += [p for room in rooms for p in opened[room]]

    def intervals(self) -> dict[str, np.ndarray]:
        """For each length, runs of ranks: their first rank, first sequence and offset, ordered by (length, rank)."""
        cursor: Counter = Counter()
        rows, sequence = [], 0
        for pattern, times in self.patterns:
            offset = 0
            for n in pattern:
                rows.append((n, cursor[n], sequence, offset))
                cursor[n] += times
                offset += n
            sequence += times
        rows.sort()
        return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T))


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` of every piece.

    A document's ids, then ``end_id``, are cut into pieces of ``capacity`` only where longer; every
    token lands in one place. Null and empty texts have the end id alone. Repeated rows and ids, null ids too, are
    packed one by one. An empty table gives no rows; other columns play no part.

    The plan is made on the driver from the number of pieces of each length, at most
    ``capacity`` numbers however many documents there are, and its size follows from that too. Pieces get
    their rank among equal lengths from counts by partition, so no length comes to one task.
    """
    made = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = made.sparkSession.sparkContext.broadcast(Plan(total, capacity).intervals())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = made.join(starts, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank")
    )
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = plan.value
        key = by["length"] << 48 | by["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, length << 48 | rank, side="right") - 1
            sequence = by["sequence"][k] + rank - by["rank"][k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(by["offset"][k])], names
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
