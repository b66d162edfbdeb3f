"""Counts of events by windows of event time, from files as they arrive, and what arrived too late for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.naming import quoted

START, END, COUNT = "window_start", "window_end", "n"


def arriving(spark: SparkSession, folder: str, schema, files_at_once: int = 0) -> DataFrame:
    """The Parquet files of a folder as a stream, oldest first; ``files_at_once`` bounds a batch (0: no bound)."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", str(files_at_once))
    return reader.parquet(folder)


def _window(time: str, width: str, gap: bool) -> Column:
    return (F.session_window if gap else F.window)(F.col(quoted(time)), width)


def count_windows(
    events: DataFrame, time: str, width: str, keys: Sequence[str] = (), late: str = "0 seconds", gap: bool = False
) -> DataFrame:
    """``window_start``, ``window_end``, the keys, ``n``: rows of each window and key.

    Windows follow one another and are ``width`` long, or with ``gap`` are sessions: rows of a key of which each comes less than
    ``width`` after the one before. Of a stream, a window is told once, when the latest time seen is ``late`` past its end;
    rows that come for it afterwards are not counted (``missed`` tells them). Of a table, all windows are told.
    Rows without a time belong to no window.
    """
    timed = events.filter(F.col(quoted(time)).isNotNull())
    if events.isStreaming:
        timed = timed.withWatermark(time, late)
    named = [F.col(quoted(k)) for k in keys]
    counted = timed.groupBy(_window(time, width, gap).alias("_w"), *named).agg(F.count(F.lit(1)).alias(COUNT))
    return counted.select(F.col("_w.start").alias(START), F.col("_w.end").alias(END), *named, COUNT)


def write_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Handle all that has arrived and stop. The next call goes on behind it, with the windows still open.

    The checkpoint folder has to be one that all executors share; with it each window is written once, whatever is lost.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .start(target)
    )
    query.awaitTermination()


def missed(told: DataFrame, events: DataFrame, time: str, width: str, keys: Sequence[str] = ()) -> DataFrame:
    """``window_start``, ``window_end``, the keys, ``n``: rows that came too late for windows already told.

    ``told``: what was written of windows of one width; ``events``: all rows that have arrived. A window of which
    nothing was told is a missed one only if it ends before the last told window does; the others may be open.
    """
    whole = count_windows(events, time, width, keys).withColumnRenamed(COUNT, "_all")
    last = told.agg(F.max(END).alias("_last"))
    pairs = whole.alias("w").join(
        told.alias("t"), [F.col(f"w.{quoted(c)}").eqNullSafe(F.col(f"t.{quoted(c)}")) for c in (START, END, *keys)], "left"
    )
    late = (F.col("_all") - F.coalesce(F.col(f"t.{COUNT}"), F.lit(0))).alias(COUNT)
    found = pairs.select(*[F.col(f"w.{quoted(c)}").alias(c) for c in (START, END, *keys)], late).filter(F.col(COUNT) > 0)
    limit = last.first()[0]
    return found.filter(F.col(END) <= F.lit(limit)) if limit is not None else found.limit(0)
