"""Inputs of every supported format as DataFrames."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.errors import ConfigError, UnknownOperation
from tallyline.functions.fixed import cast_fields, cut, parse_lines, typed
from tallyline.functions.naming import column_name
from tallyline.functions.packed import decode_binary, decode_packed, decode_text
from tallyline.sources import segments
from tallyline.sources.layout import FieldSpec, Layout
from tallyline.sources.segments import FILE, Segments


@dataclass
class Source:
    """A read input: its rows, and what its header and trailer lines say."""

    data: DataFrame
    header: DataFrame | None = None
    trailer: DataFrame | None = None
    segments: Segments | None = None


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def read_json(spark: SparkSession, path: str | list[str], layout: Layout | None = None) -> DataFrame:
    reader = spark.read.schema(_text_schema(layout)) if layout else spark.read
    frame = normal_names(reader.json(path))
    return cast_fields(frame, layout) if layout else frame


def _text_schema(layout: Layout) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in layout])


def normal_names(df: DataFrame) -> DataFrame:
    """Column names in underscore form."""
    return df.toDF(*[column_name(c) for c in df.columns])


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    layout: Layout | None = None,
    sep: str = ",",
    header: bool = True,
    quote: str = '"',
) -> DataFrame:
    """Delimited text with a line of names.

    Columns are read as text, then cast by the declared types, so a bad value
    is NULL and there is no extra pass to infer types. Without declared fields
    Spark infers them.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("quote", quote)
    if layout is None:
        return normal_names(reader.option("inferSchema", True).csv(path))
    if header:
        # Names decide, as the file may order its columns differently.
        frame = normal_names(reader.csv(path))
    else:
        frame = normal_names(reader.schema(_text_schema(layout)).csv(path))
    return cast_fields(frame, layout)


def read_delimited_segments(
    spark: SparkSession,
    path: str | list[str],
    layout: Layout | None = None,
    header_count: int = 0,
    trailer_count: int = 0,
    sep: str = ",",
    header: bool = True,
    quote: str = '"',
) -> DataFrame:
    """Delimited text between header and trailer lines that are not data.

    With ``header`` the line after the header lines holds the names, the same in
    every file: columns are taken by position, so a file of another order is an error. The
    lines left are parsed where they were read. Columns not declared stay text.
    """
    parted = segments.split(segments.read_lines(spark, path), header_count + int(header), trailer_count)
    if header:
        names = next(csv.reader([_names_line(parted.header, header_count + 1)], delimiter=sep, quotechar=quote))
    elif layout is not None:
        names = layout.columns
    else:
        raise ConfigError("delimited text without names needs declared fields")
    body = parted.data
    schema = T.StructType([T.StructField(column_name(n), T.StringType()) for n in names])
    row = F.from_csv("value", schema.toDDL(), {"sep": sep, "quote": quote})
    frame = body.select(row.alias("r")).select("r.*")
    return cast_fields(frame, layout) if layout is not None else frame


def _names_line(edges: DataFrame, rank: int) -> str:
    """The line of names that all files have; two different ones are looked at, not all."""
    line = F.rtrim(F.col("value"), F.lit("\r"))
    found = edges.filter(F.col("_rank") == rank).select(line.alias("value")).distinct().take(2)
    if not found:
        raise ConfigError(f"no line of names after {rank - 1} header line(s)")
    if len(found) > 1:
        raise ConfigError(f"files differ in their names: {found[0].value!r}, {found[1].value!r}")
    return found[0].value


def read_fixed(
    spark: SparkSession,
    path: str | list[str],
    layout: Layout | None,
    header_count: int = 0,
    trailer_count: int = 0,
    header_layout: Layout | None = None,
    trailer_layout: Layout | None = None,
    marks: tuple[str, str] | None = None,
    keep_file: bool = False,
) -> Source:
    """Positional text files, each with its own header and trailer lines.

    Fields come as trimmed text; ``typed_fixed`` scales the decimals.
    """
    lines = segments.read_lines(spark, path)
    if marks:
        seg = segments.by_mark(lines, *marks)
    else:
        seg = segments.split(lines, header_count, trailer_count)
    keep = (FILE,) if keep_file else ()
    if layout is None or not len(layout):
        data = seg.data.select(*keep, "value")
    else:
        data = parse_lines(seg.data, layout, keep=keep)
    return Source(
        data,
        seg.header_fields(header_layout) if header_layout and seg.header_count else None,
        seg.trailer_fields(trailer_layout) if trailer_layout and seg.trailer_count else None,
        seg,
    )


RAW = "_raw_"


def typed_fixed(df: DataFrame, layout: Layout, keep_raw: bool = False) -> DataFrame:
    """Scale the decimals of a positional input; other fields stay text.

    With ``keep_raw`` the text of each is kept as ``_raw_<name>``: digits that
    do not parse are NULL, and only the text can tell why.
    """
    scaled = {f.column: f for f in layout if f.kind == "decimal" and f.precision}
    out = []
    for name, dtype in df.dtypes:
        f = scaled.get(name)
        if f is None or dtype != "string":
            out.append(F.col(f"`{name}`"))
            continue
        out.append(typed(F.col(f"`{name}`"), f).alias(name))
        if keep_raw:
            out.append(F.col(f"`{name}`").alias(RAW + name))
    return df.select(*out)


def read_ebcdic(
    spark: SparkSession,
    path: str,
    layout: Layout,
    encoding: str = "Cp037",
    start_offset: int = 0,
    end_offset: int = 0,
) -> DataFrame:
    """Fixed-length EBCDIC records.

    Offsets are bytes before and after the fields in each record. The record
    length is the declared one, or that of the layout with both offsets.
    Display fields are decoded text; packed and binary ones become decimals.
    """
    length = layout.record_length or layout.width + start_offset + end_offset
    if length <= 0:
        raise ConfigError("an EBCDIC layout needs a record length")
    return decode_records(_binary_records(spark, path, length), layout, encoding, start_offset)


def _binary_records(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Splittable fixed-length records as a binary column, without a detour through Python."""
    jvm = spark.sparkContext._jvm
    records = spark.sparkContext._jsc.binaryRecords(path, length).rdd()
    encoder = jvm.org.apache.spark.sql.Encoders.BINARY()
    return DataFrame(spark._jsparkSession.createDataset(records, encoder).toDF(), spark).toDF("record")


def decode_records(
    frame: DataFrame,
    layout: Layout,
    encoding: str = "Cp037",
    start_offset: int = 0,
    record: str = "record",
) -> DataFrame:
    """A binary ``record`` column to the fields of a layout (lengths are bytes)."""
    return frame.select(*[_decoded(F.col(record), f, encoding, start_offset) for f in layout])


def _decoded(record: Column, f: FieldSpec, encoding: str, start_offset: int) -> Column:
    part = F.substring(record, f.start + start_offset, f.length)
    if f.usage in ("COMP-3", "PACKED-DECIMAL"):
        value = decode_packed(part, f.precision, min(37, 2 * f.length - 1))
    elif f.usage in ("COMP", "COMP-4", "COMP-5", "BINARY"):
        value = decode_binary(part, f.length, f.precision)
    elif f.usage == "DISPLAY":
        value = F.trim(decode_text(part, encoding))
    else:
        raise UnknownOperation(f"usage {f.usage!r} of field {f.name!r}")
    return value.alias(f.column)


def empty_like(spark: SparkSession, layout: Layout) -> DataFrame:
    """No rows, the declared schema."""
    return spark.createDataFrame([], layout.struct())


def read_count_file(
    spark: SparkSession, path: str, layout: Layout | None = None
) -> DataFrame:
    """The record count that control files declare, one row with ``expected``; several files add up.

    Without a layout the first line of a file is the number. With one, the field named
    like a count holds it, else the first field. One file without a number makes it NULL.
    """
    lines = segments.drop_blank(segments.read_lines(spark, path)).withColumn("_id", F.monotonically_increasing_id())
    first = lines.groupBy(FILE, segments.PART).agg(F.min_by("value", "_id").alias("value"))
    if layout is None or not len(layout):
        number = F.trim("value")
    else:
        number = cut(F.col("value"), count_field(layout) or layout.fields[0], layout.offset)
    counts = first.select(number.try_cast("bigint").alias("n"))
    return counts.agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("expected"))


# What marks the name of a field as a count.
COUNT_WORDS = ("count", "cnt")


def count_field(layout: Layout) -> FieldSpec | None:
    """The first field whose name says it is a count."""
    return next((f for f in layout if any(w in f.name.lower() for w in COUNT_WORDS)), None)
