"""Header lines, data lines and trailer lines of text files.

A file has its first ``h`` lines as header and its last ``t`` as trailer. Lines
get an id that counts up inside a split (partition number and position in it).
One pass finds the first id and the number of lines of every split of a file:
two numbers, so nothing is sorted and no text moves. The ids of the edge
lines follow from those; their texts are fetched by a second scan. The small tables are
written to the shared folder, so Spark knows their size when it plans the joins.

The part files of one Spark-written folder are one file, in the order of their
part numbers; any other file stands for itself.

Files whose lines name their record type in a fixed position need a single scan: ``by_mark``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions.fixed import cut, parse_lines
from tallyline.session import pin_split_planning, staged
from tallyline.sources.layout import FieldSpec, Layout

FILE = "_file"
PART = "_part"
_SPLIT_BITS = 33


@dataclass
class Segments:
    """The three kinds of lines, each with columns ``_file`` and ``value``."""

    header: DataFrame
    data: DataFrame
    trailer: DataFrame
    header_count: int
    trailer_count: int

    def header_fields(self, layout: Layout) -> DataFrame:
        """One row per file: the header fields as text; with several lines the last one counts."""
        return parse_lines(_last_line(self.header), layout, keep=(FILE,))

    def trailer_fields(self, layout: Layout) -> DataFrame:
        """One row per file: the trailer fields as text; with several lines the last one counts."""
        return parse_lines(_last_line(self.trailer), layout, keep=(FILE,))


def _last_line(edges: DataFrame) -> DataFrame:
    """Of the few edge lines of each file the last one."""
    return edges.groupBy(FILE).agg(F.max_by("value", "_rank").alias("value"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with the file they come from; line ends may be LF, CR LF or CR."""
    name, part = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    folder = F.substring(part, F.lit(1), F.length(part) - F.length(name) - 1)
    return spark.read.text(path).select(
        "value", F.when(name.startswith("part-"), folder).otherwise(part).alias(FILE), part.alias(PART)
    )


def _whole_file(part: Column) -> Column:
    """``_file`` from ``_part``."""
    return F.regexp_replace(part, "/part-[^/]*$", "")


def part_order(path: Column) -> Column:
    """What sorts the part files of a folder as they were written: part number, file counter, name.

    Spark pads the number to five digits only, so names alone do not sort.
    """
    name = F.substring_index(path, "/", -1)
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint")
    counter = F.regexp_extract(name, r"-c(\d+)[^-]*$", 1).try_cast("bigint")
    return F.struct(number.alias("number"), counter.alias("counter"), name.alias("name"))


def part_key(path: str) -> tuple:
    """The same order for a path held by the driver."""
    name = path.rsplit("/", 1)[-1]
    found = [re.search(p, name) for p in (r"^part-(\d+)", r"-c(\d+)[^-]*$")]
    return (*[int(m.group(1)) if m else -1 for m in found], name)


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(F.length(F.trim("value")) > 0)


def split(lines: DataFrame, header_count: int = 0, trailer_count: int = 0) -> Segments:
    """Cut the lines of every file by count. ``lines`` comes from ``read_lines``."""
    if not header_count and not trailer_count:
        nothing = lines.select(FILE, "value").limit(0)
        return Segments(nothing, drop_blank(lines).select(FILE, "value"), nothing, 0, 0)
    pin_split_planning(lines.sparkSession)
    numbered = lines.withColumn("_id", F.monotonically_increasing_id())
    edges = staged(_edge_ids(numbered, header_count, trailer_count), "edges")
    texts = staged(numbered.select("_id", "value").join(edges, "_id"), "edge-lines")
    data = numbered.join(edges.select("_id").distinct(), "_id", "left_anti").select(FILE, "value")
    header, trailer = (
        texts.filter(F.col("_side") == side).select(FILE, "_rank", "value") for side in "HT"
    )
    return Segments(header, drop_blank(data), trailer, header_count, trailer_count)


def _first(n: Column) -> Column:
    """Rows 0 to n - 1 as ``_k``."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("_k")


def _edge_ids(numbered: DataFrame, header_count: int, trailer_count: int) -> DataFrame:
    """Ids of the first and last lines of each file: ``_file``, ``_side``, ``_rank``, ``_id``.

    Lines of a file in one split have ids in a row. Splits of a file come in the order of
    its parts; a header that ends in a later split than it began takes the rest from there. The rank
    grows towards the end of the file. A line that is both is a header line.
    """
    runs = numbered.groupBy(PART, F.shiftright("_id", _SPLIT_BITS).alias("_split")).agg(
        F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n")
    )
    placed = runs.withColumn(FILE, _whole_file(F.col(PART))).withColumn("_order", part_order(F.col(PART)))
    ahead = Window.partitionBy(FILE).orderBy("_order", "_split")
    behind = Window.partitionBy(FILE).orderBy(F.desc("_order"), F.desc("_split"))
    others = lambda w: F.coalesce(
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    counted = placed.select(
        FILE, "_low", "_n", others(ahead).alias("_before"), others(behind).alias("_after")
    ).filter((F.col("_before") < header_count) | (F.col("_after") < trailer_count))
    heads = F.least(F.col("_n"), F.lit(header_count) - F.col("_before"))
    tops = counted.filter(heads > 0).select("*", heads.alias("_take")).select(
        FILE, "_low", "_before", _first(F.col("_take"))
    )
    header = tops.select(
        FILE, F.lit("H").alias("_side"), (F.col("_before") + F.col("_k") + 1).alias("_rank"), (F.col("_low") + F.col("_k")).alias("_id")
    )
    tails = F.least(F.col("_n"), F.lit(trailer_count) - F.col("_after"))
    # Lines that the header has taken are no trailer.
    tails = F.least(tails, F.col("_n") - F.greatest(F.lit(0), F.least(F.col("_n"), heads)))
    ends = counted.filter(tails > 0).select("*", tails.alias("_take")).select(
        FILE, "_low", "_n", "_after", _first(F.col("_take"))
    )
    trailer = ends.select(
        FILE, F.lit("T").alias("_side"), (-F.col("_after") - F.col("_k") - 1).alias("_rank"), (F.col("_low") + F.col("_n") - 1 - F.col("_k")).alias("_id")
    )
    return header.union(trailer)


def by_mark(lines: DataFrame, header: str = "H", trailer: str = "T", at: int = 1) -> Segments:
    """Cut by the record type written in each line at position ``at``. One scan, no shuffle."""
    width = max(len(header), len(trailer))
    mark = cut(F.col("value"), FieldSpec("mark", start=at, length=width))
    kept = drop_blank(lines)
    return Segments(
        kept.filter(mark == header).select(FILE, F.lit(1).alias("_rank"), "value"),
        kept.filter(~mark.isin(header, trailer)).select(FILE, "value"),
        kept.filter(mark == trailer).select(FILE, F.lit(1).alias("_rank"), "value"),
        1,
        1,
    )


def width_check(lines: DataFrame, record_length: int, by_file: bool = False) -> DataFrame:
    """How many lines are longer or shorter than the record length."""
    size = F.length("value")
    grouped = lines.groupBy(FILE) if by_file else lines.groupBy()
    return grouped.agg(
        F.count_if(size > record_length).alias("too_wide"),
        F.count_if(size < record_length).alias("too_short"),
    )
