"""A watch over deliveries as they arrive: what did not come in time, what came after all, what came twice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyline.functions.dates import expected_calendar
from tallyline.functions.naming import quoted

GAP, LATE, REPEAT = "gap", "late", "repeat"

# Marks of a day, kept for each source.
_IN_TIME, _AFTERWARDS, _TWICE, _GAP_TOLD, _LATE_TOLD, _REPEAT_TOLD = (np.uint8(1 << k) for k in range(6))
_ARRIVED = _IN_TIME | _AFTERWARDS


def watch_deliveries(
    deliveries: DataFrame, source: str, day: str, at: str, first: date, last: date,
    holidays: Iterable[str | dict] | None = None, patience: str = "0 days", disorder: str = "0 seconds",
) -> DataFrame:
    """``source``, ``day``, ``finding`` of a stream of deliveries; each finding is told once, also across stops.

    Every source that was seen owes a delivery for each day of the calendar from ``first`` to ``last``. A day is due
    ``patience`` after its end. ``gap``: nothing had come when it was due; told when the latest arrival of any
    source is ``disorder`` past that, by a timer, so that a source that has gone silent is found too.
    ``late``: a gap for which something came after all. ``repeat``: the source delivered the day more than once, holidays
    included. Deliveries may arrive in any order within ``disorder``; arrivals further behind the latest one are not seen. Rows
    without an arrival time are left out; rows without a day, and of days outside the calendar, only tell that their source
    is there and how late it is. Rows without a source are one source. A later call may lengthen the calendar, for which
    days delivered past it are remembered, but ``first`` has to stay; added days are watched from a source's next delivery on.

    A source's state is a byte a calendar day and eight a day delivered past it, however often it delivers.
    """
    spark = deliveries.sparkSession
    time = F.date_add("day", 1).cast("timestamp") + F.expr(f"INTERVAL {patience}")
    slot = F.datediff("day", F.lit(first))
    size = (last - first).days + 1
    # A row a calendar day.
    expected, due = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64)
    for row in expected_calendar(spark, first, last, holidays).select(slot.alias("k"), F.unix_millis(time).alias("due")).collect():
        expected[row.k], due[row.k] = True, row.due

    rows = deliveries.select(
        F.col(quoted(source)).alias("source"), F.col(quoted(day)).cast("date").alias("day"), F.col(quoted(at)).alias("at")
    )
    # Days before the calendar still move the clock: -1.
    k = F.greatest(F.coalesce(slot, F.lit(-1)), F.lit(-1))
    in_time = F.coalesce(F.col("at") <= time, F.lit(False))
    rows = rows.filter(F.col("at").isNotNull()).select("source", k.alias("k"), in_time.alias("in_time"), "at")

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, past = state.get if state.exists else (b"", b"")
        marks, told = np.zeros(size, dtype=np.uint8), []
        every = np.frombuffer(kept, dtype=np.uint8)
        marks[: len(every)] = every[:size]
        # Days past a calendar that may have grown or shrunk: number and marks.
        later = {int(v) >> 8: np.uint8(v & 255) for v in np.frombuffer(past, dtype=np.int64)}
        later.update((k, every[k]) for k in range(size, len(every)) if every[k])
        for k in [k for k in later if k < size]:
            marks[k] |= later.pop(k)

        def tell(which: np.ndarray, mark: np.uint8, finding: str) -> None:
            new = which & (marks & mark == 0)
            marks[new] |= mark
            told.extend((k, finding) for k in np.nonzero(new)[0])

        if not state.hasTimedOut:
            for batch in batches:
                arrived = batch[batch["k"] >= 0].groupby("k")["in_time"].agg(["size", "any", "all"])
                for k, n, some, whole in arrived.itertuples():
                    old = marks[k] if k < size else later.get(k, np.uint8(0))
                    new = old | (_IN_TIME if some else old) | (old if whole else _AFTERWARDS)
                    new |= _TWICE if n > 1 or old & _ARRIVED else old
                    if k < size:
                        marks[k] = new
                    else:
                        later[k] = new
        tell(marks & _TWICE != 0, _REPEAT_TOLD, REPEAT)
        seen_until = state.getCurrentWatermarkMs()
        # Nothing is known of the clock before the first batch has ended.
        passed = expected & (due < seen_until) if seen_until > 0 else np.zeros(size, dtype=bool)
        missing = passed & (marks & _IN_TIME == 0)
        tell(missing, _GAP_TOLD, GAP)
        tell(missing & (marks & _AFTERWARDS != 0), _LATE_TOLD, LATE)
        past = np.array([(k << 8) | int(mark) for k, mark in later.items()], dtype=np.int64)
        state.update((marks.tobytes(), past.tobytes()))
        ahead = due[expected & ~passed]
        if len(ahead):
            state.setTimeoutTimestamp(int(max(ahead.min(), seen_until + 1)))
        days = [first + pd.Timedelta(days=int(k)) for k, _ in told]
        yield pd.DataFrame({"source": [key[0]] * len(told), "day": days, "finding": [f for _, f in told]})

    kind = rows.schema["source"].dataType.simpleString()
    found = rows.withWatermark("at", disorder).groupBy("source").applyInPandasWithState(
        of, f"source {kind}, day date, finding string", "marks binary, past binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(F.col("source").alias(source), F.col("day").alias(day), "finding")
