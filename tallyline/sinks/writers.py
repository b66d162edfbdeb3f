"""File outputs. A data set is a folder of part files; only one-row outputs are single files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.errors import ConfigError, UnknownOperation
from tallyline.functions.packed import encode_text
from tallyline.operators.control import ControlField, control_file
from tallyline.sinks.records import delimited_file, fixed_file
from tallyline.sources.layout import Layout

_MODES = {"overwrite": "overwrite", "append": "append"}


def write_mode(word: str | None) -> str:
    mode = _MODES.get((word or "overwrite").strip().lower())
    if mode is None:
        raise UnknownOperation(f"write mode {word!r}")
    return mode


def write_parquet(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> None:
    """Parquet, optionally in folders by column value.

    Each task writes into the folders of the rows it has. Rows are not
    regrouped by folder first: one value may hold much of the table.
    """
    writer = df.write.mode(write_mode(mode))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(write_mode(mode))
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_delimited(
    df: DataFrame,
    path: str,
    sep: str = ",",
    mode: str = "overwrite",
    header_count: int = 0,
    trailer_count: int = 0,
    header: bool = True,
    quote: str = '"',
) -> None:
    """Delimited text with names; with header or trailer lines one file in parts."""
    if header_count or trailer_count:
        _refuse_append(mode, {"header_count": header_count, "trailer_count": trailer_count})
        lines = delimited_file(df, sep, header_count, trailer_count, quote)
        lines.write.mode(write_mode(mode)).text(path)
        return
    options = {"header": header, "sep": sep, "quote": quote}
    df.write.mode(write_mode(mode)).options(**options).csv(path)


def write_fixed(df: DataFrame, path: str, layout: Layout, mode: str = "overwrite", **records) -> None:
    """Positional lines; ``records`` as for ``fixed_file``."""
    _refuse_append(mode, records)
    fixed_file(df, layout, **records).write.mode(write_mode(mode)).text(path)


def _refuse_append(mode: str, records: dict) -> None:
    """Parts of two writes in one folder would mix, and with them the header of one and the data of the other."""
    if write_mode(mode) == "append" and (records.get("header_count") or records.get("trailer_count")):
        raise ConfigError("a file with header or trailer records cannot be appended to: write each to a folder of its own")


def write_ebcdic(
    df: DataFrame, path: str, layout: Layout, mode: str = "overwrite", encoding: str = "Cp037", form: str = "table", **records
) -> None:
    """Positional records in EBCDIC bytes; ``records`` as for ``fixed_file``.

    ``form``: ``table`` writes a binary Parquet column, ``fixed`` files of records one after the other, ``variable`` files of records
    behind their descriptor words, blanks at a record's end left out.
    """
    from tallyline.sinks import byte_files

    _refuse_append(mode, records)
    lines = fixed_file(df, layout, **records)
    if form == "table":
        lines.select(encode_text(F.col("value"), encoding).alias("record")).write.mode(write_mode(mode)).parquet(path)
    elif form == "fixed":
        byte_files.write_bytes(lines.select(encode_text(F.col("value"), encoding).alias("record")), path, mode)
    elif form == "variable":
        record = byte_files.with_descriptor(encode_text(F.rtrim("value"), encoding))
        byte_files.write_bytes(lines.select(record.alias("record")), path, mode)
    else:
        raise UnknownOperation(f"form {form!r} of an EBCDIC output")


def write_single(lines: DataFrame, folder: str, name: str) -> str:
    """A few lines as one file of the given name.

    Only for records whose number of lines is fixed, such as control files.
    """
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    staging = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(staging)
    source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(folder, name)
    fs = target.getFileSystem(conf)
    part = next(s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(source, "part-*")))
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot move {part} to {target}")
    fs.delete(source, True)
    return f"{folder.rstrip('/')}/{name}"


def write_control(
    df: DataFrame,
    folder: str,
    name: str,
    fields: Sequence[dict | ControlField],
    header: DataFrame | None = None,
    names: bool = False,
    run_date: date | None = None,
) -> str:
    """The control file of a data set; without a name a text folder."""
    lines = control_file(df, fields, header, names, run_date)
    if name:
        return write_single(lines, folder, name)
    lines.coalesce(1).write.mode("overwrite").text(folder)
    return folder


def count_lines(df: DataFrame, fields: Sequence[dict] = ()) -> DataFrame:
    """The companion count: just the number, or a record whose count field holds it."""
    if not fields:
        return df.agg(F.count(F.lit(1)).cast("string").alias("value"))
    named = [f for f in fields if any(w in (f.get("name") or "").lower() for w in ("count", "cnt"))][:1]
    filled = [{**f, "expression": "count(*)" if f in named else "''", "begin": f.get("start")} for f in fields]
    return control_file(df, filled)
