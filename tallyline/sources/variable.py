"""Records of variable length, each behind a descriptor word: two bytes of length (its own four included) and two of zeros.

A file is read in byte ranges by many tasks, though only a walk from its start tells where records begin. So every
range walks from each place where its first record could begin, and tells the few that lead through it and where its last
record would end. Which of them holds is confirmed by the end of the range before; the table of borders has a row a
range. Records that cross a range are put together from their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.errors import ConfigError
from tallyline.sources.layout import Layout
from tallyline.sources.readers import decode_records

# Bytes of a descriptor, and the longest record it may announce.
DESCRIPTOR, LONGEST = 4, 32_760


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of the files between zero bytes, in order, with the range they come from.

    Every descriptor has zero bytes, so no piece is longer than a record.
    """
    lines = spark.read.option("lineSep", "\x00").text(path)
    meta = ("file_path", "file_block_start", "file_size")
    return lines.select(F.col("value").cast("binary").alias("value"), *[F.col(f"_metadata.{m}").alias(m) for m in meta])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytearray]]:
    """(path, range, file size, bytes) of the ranges that a task reads.

    A zero byte stands behind each piece; behind the last one of a file it may be one that the file does not have.
    """
    now, data = None, bytearray()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("file_path", "file_block_start", "file_size", "value"))
        for path, block, size, value in zip(*columns):
            if now != (path, block, size):
                if now:
                    yield *now, data
                now, data = (path, block, size), bytearray()
            data += value
            data.append(0)
    if now:
        yield *now, data


def walk(data: bytes, start: int) -> int:
    """From a border the next one that this range has no whole descriptor for, or -1 where a descriptor is none."""
    while start + DESCRIPTOR <= len(data):
        length = data[start] << 8 | data[start + 1]
        if length < DESCRIPTOR or length > LONGEST or data[start + 2] or data[start + 3]:
            return -1
        start += length
    return start


def _chains(data: bytes) -> dict[int, int]:
    """Every place where the range's first record could begin, and the border that its descriptors lead to.

    A record that began before the range ends within its first ``LONGEST`` bytes. Chains from different places soon
    meet, and what they share is walked once.
    """
    window, near = min(len(data), LONGEST), 4 * LONGEST
    ends: dict[int, int] = {}
    found = {}
    places = [at for at in range(window) if at + DESCRIPTOR > len(data) or not (data[at + 2] or data[at + 3])]
    for at in places:
        path, now = [], at
        while now not in ends:
            if now >= near:
                ends[now] = walk(data, now)
                break
            path.append(now)
            if now + DESCRIPTOR > len(data):
                ends[now] = now
                break
            length = data[now] << 8 | data[now + 1]
            if length < DESCRIPTOR or length > LONGEST or data[now + 2] or data[now + 3]:
                ends[now] = -1
                break
            now += length
        for place in path:
            ends[place] = ends[now]
        if ends[at] >= 0:
            found[at] = ends[at]
    return found


_SURVEY = pa.schema(
    [("path", pa.string()), *[(c, pa.int64()) for c in ("block", "size", "length")], *[(c, pa.list_(pa.int64())) for c in ("firsts", "ends")]]
    + [("head", pa.binary()), ("tail", pa.binary())]
)


def _survey(pieces: DataFrame) -> list:
    """A row a range: its length, where its first record could begin and the borders that would lead to, its first and last bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, size, data in _ranges(batches):
            chains = {0: walk(data, 0)} if block == 0 else _chains(data)
            row = {"path": path, "block": block, "size": size, "length": len(data), "firsts": list(chains), "ends": list(chains.values())}
            row |= {"head": bytes(data[:DESCRIPTOR]), "tail": bytes(data[-DESCRIPTOR:])}
            yield pa.RecordBatch.from_pylist([row], schema=_SURVEY)

    schema = "path string, block bigint, size bigint, length bigint, firsts array<bigint>, ends array<bigint>, head binary, tail binary"
    return pieces.mapInArrow(of, schema).collect()


def _borders(name: str, ranges: list) -> list[tuple[int, int, int, int]]:
    """A file's ranges as (block, first byte, first border, border behind its last record), as places in the file."""
    size, base, border, table = ranges[0].size, 0, 0, []
    for k, r in enumerate(ranges):
        own = min(r.length, size - base)
        end = border
        if border < base + own:
            end = dict(zip(r.firsts, r.ends)).get(border - base, -1)
            if end < 0:
                raise ConfigError(f"{name}: from byte {border} on the descriptors lead nowhere")
            if end < own:
                # A descriptor that goes on in the next range.
                rest = bytes(r.tail)[len(r.tail) - (r.length - end) :][: own - end]
                word = (rest + b"".join(bytes(n.head) for n in ranges[k + 1 : k + 1 + DESCRIPTOR]))[:DESCRIPTOR]
                length = int.from_bytes(word[:2], "big")
                if len(word) < DESCRIPTOR or word[2:] != b"\0\0" or not DESCRIPTOR <= length <= LONGEST:
                    raise ConfigError(f"{name}: no record begins at byte {base + end}")
                end += length
            end += base
        table.append((r.block, base, border, end))
        base, border = base + own, end
    if border != size:
        raise ConfigError(f"{name}: the last record ends at byte {border} of {size}")
    return table


def record_borders(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(first byte, first border, border behind its last record) of each range, as places in its file.

    One reading of the files; a range's few possible borders come to the driver, which follows them from each file's start.
    """
    ranges: dict[str, list] = {}
    for r in sorted(_survey(_pieces(spark, path)), key=lambda r: (r.path, r.block)):
        ranges.setdefault(r.path, []).append(r)
    return {(name, block): (base, first, end) for name, rows in ranges.items() for block, base, first, end in _borders(name, rows)}


def variable_records(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``at`` (the byte of the file where it begins) and ``record`` (without descriptor) of every record."""
    table = spark.sparkContext.broadcast(record_borders(spark, path))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = ["path", "at", "until", "split", "piece"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, size, data in _ranges(batches):
            base, first, end = table.value[name, block]
            limit = min(base + len(data), size)
            rows: list[tuple] = []
            if first > base:
                # The end of a record that began in an earlier range, or a part of one.
                rows.append((name, base, first, True, bytes(data[: min(first, limit) - base])))
            at = first
            while at < limit:
                whole = at + DESCRIPTOR <= limit
                until = at + (data[at - base] << 8 | data[at - base + 1]) if whole else end
                rows.append((name, at, until, until > limit, bytes(data[at - base : min(until, limit) - base])))
                at = until
                if len(rows) >= 4_096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    read = _pieces(spark, path).mapInArrow(of, "path string, at bigint, until bigint, split boolean, piece binary")
    # A border of a range is crossed by one record at most, so few rows are shuffled.
    joined = (
        read.filter("split")
        .groupBy("path", "until")
        .agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
        .select("path", "at", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["piece"])).alias("piece"))
    )
    rows = read.filter("not split").select("path", "at", "piece").unionByName(joined)
    return rows.select("path", "at", F.expr(f"substring(piece, {DESCRIPTOR + 1})").alias("record"))


def read_variable(spark: SparkSession, path: str, layout: Layout, encoding: str = "Cp037", start_offset: int = 0) -> DataFrame:
    """Fields of variable-length EBCDIC records; a field that begins behind a record's end is empty or NULL."""
    return decode_records(variable_records(spark, path), layout, encoding, start_offset)
