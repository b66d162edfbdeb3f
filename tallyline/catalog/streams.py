"""Events as they arrive, against what SQL says of all of them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyline.catalog.registry import register, table
from tallyline.session import scratch_dir
from tallyline.streaming.deliveries import watch_deliveries
from tallyline.streaming.windows import START, arriving, count_windows, missed, write_available


@register(
    """
    WITH rows AS (
      SELECT *, date_trunc('day', ts) AS day, event_id % 40 = 0 AND ts < TIMESTAMP '2024-01-11' AS held FROM events)
    SELECT strftime(day, '%Y-%m-%d') AS day, event_type, held AS late, count(*) AS n FROM rows
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY day, event_type, held
    """
)
def stream_windows(spark, sf_dir):
    """ST: events arrive in three deliveries, some with the last that belong to the first; days are told once, late rows beside."""
    base = scratch_dir(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    third = F.when(F.col("ts") < "2024-01-11", F.when(F.col("event_id") % 40 == 0, 3).otherwise(1))
    third = third.when(F.col("ts") < "2024-01-21", 2).otherwise(3)
    for delivery in (1, 2, 3):
        events.filter(third == delivery).write.mode("append").parquet(f"{base}/in")
        stream = count_windows(arriving(spark, f"{base}/in", events.schema), "ts", "1 day", ["event_type"], "1 hour")
        write_available(stream, f"{base}/out", f"{base}/checkpoint")
    told = spark.read.parquet(f"{base}/out")
    late = missed(told, spark.read.schema(events.schema).parquet(f"{base}/in"), "ts", "1 day", ["event_type"])
    rows = told.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return rows.select(F.date_format(START, "yyyy-MM-dd").alias("day"), "event_type", "late", "n")


_HOLIDAYS = ["1995-01-02", "1995-01-03", "1998-07-04"]


@register(
    """
    WITH d AS (
      SELECT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS day,
             CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + CASE WHEN o_orderkey % 16 = 0 THEN INTERVAL 116 HOUR ELSE INTERVAL 20 HOUR END AS came
      FROM orders),
    cal AS (
      SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day
      EXCEPT SELECT day FROM (VALUES (DATE '1995-01-02'), (DATE '1995-01-03'), (DATE '1998-07-04')) AS h(day)),
    per AS (SELECT source, day, count(*) AS n, min(came) AS first_at FROM d GROUP BY source, day),
    gaps AS (
      SELECT s.source, c.day, p.first_at FROM (SELECT DISTINCT source FROM d) s CROSS JOIN cal c
      LEFT JOIN per p ON p.source = s.source AND p.day = c.day
      WHERE c.day + INTERVAL 3 DAY < (SELECT max(came) - INTERVAL 1 HOUR FROM d)
        AND (p.first_at IS NULL OR p.first_at > c.day + INTERVAL 3 DAY))
    SELECT source, strftime(day, '%Y-%m-%d') AS day, 'gap' AS finding FROM gaps
    UNION ALL SELECT source, strftime(day, '%Y-%m-%d'), 'late' FROM gaps WHERE first_at IS NOT NULL
    UNION ALL SELECT source, strftime(day, '%Y-%m-%d'), 'repeat' FROM per
    WHERE n > 1 AND day BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
    """
)
def stream_deliveries(spark, sf_dir):
    """ST VA22: days that each source delivers, watched in three runs; one in sixteen comes four days later."""
    base = scratch_dir(spark, "watch")
    day = F.col("o_orderdate").cast("date")
    hours = F.when(F.col("o_orderkey") % 16 == 0, F.expr("INTERVAL 116 HOURS")).otherwise(F.expr("INTERVAL 20 HOURS"))
    sent = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), day.alias("day"), (day.cast("timestamp") + hours).alias("at"))
    for low, high in (("0001-01-01", "1997-01-01"), ("1997-01-01", "2000-01-01"), ("2000-01-01", "9999-01-01")):
        sent.filter((F.col("at") >= low) & (F.col("at") < high)).write.mode("append").parquet(f"{base}/in")
        found = watch_deliveries(
            arriving(spark, f"{base}/in", sent.schema), "source", "day", "at", date(1995, 1, 1), date(2001, 12, 31),
            _HOLIDAYS, "2 days", "1 hour",
        )
        write_available(found, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
