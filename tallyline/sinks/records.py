"""The lines of an output file: header records, data lines, trailer records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.errors import ConfigError
from tallyline.functions.dates import on_run_date
from tallyline.functions.fixed import assemble, format_field, format_lines
from tallyline.functions.naming import find_column, hyphen_safe, quoted
from tallyline.sources.layout import Layout


def _expression(df: DataFrame, text: str, run_date: date | None) -> Column:
    """A header or trailer expression as an aggregate; a plain column is its first value."""
    sql = on_run_date(hyphen_safe(text or "''", df.columns), run_date)
    value = F.expr(sql)
    try:
        df.agg(value)
        return value
    except AnalysisException:
        pass
    first = F.first(value)
    try:
        df.agg(first)
    except AnalysisException as problem:
        raise ConfigError(f"expression {text!r} cannot be read: {problem}") from problem
    return first


def record_lines(
    df: DataFrame,
    header: Layout | None,
    header_count: int,
    trailer: Layout | None,
    trailer_count: int,
    width: int,
    run_date: date | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Header and trailer lines of a data set; every expression in one aggregation.

    A record without fields is a blank line. Numbers and JUSTIFIED RIGHT text
    are right-aligned; decimals with a precision are scaled digits.
    """
    sums = []
    for side, layout in (("h", header), ("t", trailer)):
        for i, f in enumerate(layout or ()):
            sums.append(_expression(df, f.expression, run_date).alias(f"{side}{i}"))
    row = df.agg(*sums) if sums else df.sparkSession.range(1)
    types = {f.name: f.dataType for f in row.schema.fields}

    def line(side: str, layout: Layout | None) -> Column:
        pieces = [
            (f.start - layout.offset, f.length, format_field(F.col(f"{side}{i}"), f, types[f"{side}{i}"]))
            for i, f in enumerate(layout or ())
        ]
        return F.rpad(assemble(pieces), width, " ") if pieces else F.lit(" " * width)

    # Both sides read one and the same frame, so Spark aggregates once for both.
    records = [F.struct(F.lit(0).alias("side"), line("h", header).alias("value"))] * header_count
    records += [F.struct(F.lit(1).alias("side"), line("t", trailer).alias("value"))] * trailer_count
    both = row.select(F.explode(F.array(*records)).alias("r")).select("r.*")
    return both.filter("side = 0").select("value"), both.filter("side = 1").select("value")


def fixed_file(
    df: DataFrame,
    layout: Layout,
    header: Layout | None = None,
    trailer: Layout | None = None,
    header_count: int = 0,
    trailer_count: int = 0,
    map_by: str = "name",
    on_overflow: str = "error",
    run_date: date | None = None,
) -> DataFrame:
    """All lines of a positional file, in order.

    A union keeps its inputs' partitions in sequence and part files are numbered
    by partition, so the part files in the order of their numbers are the file: header first,
    data as ``df`` orders it, trailer last. No shuffle is needed for that.
    """
    lines = format_lines(df, layout, map_by, on_overflow)
    if not header_count and not trailer_count:
        return lines
    top, bottom = record_lines(
        df, header, header_count, trailer, trailer_count, layout.width, run_date
    )
    return _in_order(top, header_count, lines, bottom, trailer_count)


def delimited_file(
    df: DataFrame, sep: str = ",", header_count: int = 0, trailer_count: int = 0, quote: str = '"'
) -> DataFrame:
    """Lines of a delimited file between blank header and trailer lines: names, then rows."""
    blank = sep * (len(df.columns) - 1)
    spark = df.sparkSession
    top = [blank] * header_count + [sep.join(df.columns)]
    # Empty text is written as nothing, as in a file of its own, not as a quoted nothing.
    options = {"sep": sep, "quote": quote, "emptyValue": ""}
    rows = df.select(F.to_csv(F.struct("*"), options).alias("value"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in top])).alias("value"))
    end = spark.range(1).select(
        F.explode(F.array(*[F.lit(blank)] * max(trailer_count, 1))).alias("value")
    )
    return _in_order(names, 1, rows, end, trailer_count)


def _in_order(
    top: DataFrame, header_count: int, lines: DataFrame, bottom: DataFrame, trailer_count: int
) -> DataFrame:
    if header_count:
        lines = top.union(lines)
    return lines.union(bottom) if trailer_count else lines


def output_columns(df: DataFrame, wanted: Sequence[str]) -> list[tuple[str, str | None]]:
    """Wanted names with the column each is taken from; None where there is none.

    A column of that name, else the one column that ends in the longest
    possible tail of the name: ``OUT-DAT-TXN-ID`` is ``INP_DAT_TXN_ID``.
    """
    return [(name, _by_tail(df.columns, name)) for name in wanted]


def _by_tail(columns: Sequence[str], name: str) -> str | None:
    found = find_column(columns, name)
    if found is not None:
        return found
    words = name.replace("-", "_").split("_")
    for i in range(1, len(words)):
        tail = "_".join(words[i:])
        hits = [c for c in columns if c.replace("-", "_") == tail or c.replace("-", "_").endswith("_" + tail)]
        if len(hits) > 1:
            raise ConfigError(f"{name!r} could be any of {hits}")
        if hits:
            return hits[0]
    return None


def pick(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, under their wanted names."""
    return df.select(*[F.col(quoted(c)).alias(n) for n, c in output_columns(df, wanted) if c])
