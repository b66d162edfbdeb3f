"""Record views of the given tables that several queries share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.catalog.registry import table
from tallyline.functions.fixed import format_lines
from tallyline.session import scratch_dir
from tallyline.sources.layout import FieldSpec, Layout

ORDER_LAYOUT = Layout.of(
    [
        FieldSpec("REC-TYPE", length=1),
        FieldSpec("ORDER-KEY", "long", length=10),
        FieldSpec("CUST-KEY", "long", length=10),
        FieldSpec("STATUS", length=1),
        FieldSpec("TOTAL", "decimal", length=14, precision=2),
        FieldSpec("ORDER-DATE", "date", length=8, format="YYYYMMDD"),
        FieldSpec("PRIORITY", length=15),
    ],
    record_length=60,
)
ORDER_HEADER = Layout.of(
    [
        FieldSpec("REC-TYPE", length=1, expression="'H'"),
        FieldSpec("FILE-DATE", "date", length=8, expression="date_format(min(DELIVERY), 'yyyyMMdd')"),
        FieldSpec("SRC-ID", length=10, expression="'ORDERS'"),
    ],
    record_length=60,
)
ORDER_TRAILER = Layout.of(
    [
        FieldSpec("REC-TYPE", length=1, expression="'T'"),
        FieldSpec("REC-COUNT", "long", length=10, expression="count(*)"),
        FieldSpec("TOTAL-AMT", "decimal", length=18, precision=2, expression="sum(TOTAL)"),
    ],
    record_length=60,
)
# Each order status is delivered on a day of its own.
DELIVERIES = {"F": date(2026, 3, 4), "O": date(2026, 3, 5), "P": date(2026, 3, 6)}
FILE_NODE = {"source_file_name": "ORDERS.DAT", "frequency": "daily"}


def money(value: Column | str, digits: int = 15) -> Column:
    """Two exact decimals of a double column."""
    return (F.col(value) if isinstance(value, str) else value).cast(f"decimal({digits},2)")


def number(value: Column | str) -> Column:
    """An exact result as a double, computed before."""
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the columns of the order record."""
    return table(spark, sf_dir, "orders").select(
        F.lit("D").alias("REC_TYPE"),
        F.col("o_orderkey").alias("ORDER_KEY"),
        F.col("o_custkey").alias("CUST_KEY"),
        F.col("o_orderstatus").alias("STATUS"),
        money("o_totalprice", 14).alias("TOTAL"),
        F.col("o_orderdate").cast("date").alias("ORDER_DATE"),
        F.col("o_orderpriority").alias("PRIORITY"),
    )


def delivery_day(status: Column) -> Column:
    """The day an order is delivered on; any other status comes with the last ones."""
    return F.when(status == "F", "20260304").when(status == "O", "20260305").otherwise("20260306")


def deliver_orders(spark: SparkSession, sf_dir: str, day: Column | None = None) -> str:
    """Write the positional file of each delivery day below a dated folder, in one pass; returns the base folder.

    Header, data and trailer lines of all days are one union, so in each day's folder the part
    with the header has the lowest number and the part with the trailer the highest.
    """
    base = scratch_dir(spark, "deliveries")
    records = order_records(spark, sf_dir)
    orders = records.withColumn("DELIVERY", delivery_day(F.col("STATUS")) if day is None else day)
    ends = orders.groupBy("DELIVERY").agg(F.count(F.lit(1)).alias("REC_COUNT"), F.sum("TOTAL").alias("TOTAL_AMT"))
    ends = ends.select(
        "*", F.lit("H").alias("H"), F.lit("T").alias("T"), F.col("DELIVERY").alias("FILE_DATE"), F.lit("ORDERS").alias("SRC_ID")
    )
    keep = ("DELIVERY",)
    header = format_lines(ends.withColumn("REC_TYPE", F.col("H")), ORDER_HEADER, keep=keep).coalesce(1)
    trailer = format_lines(ends.withColumn("REC_TYPE", F.col("T")), ORDER_TRAILER, keep=keep).coalesce(1)
    lines = header.union(format_lines(orders, ORDER_LAYOUT, keep=keep)).union(trailer)
    lines.write.partitionBy("DELIVERY").text(f"{base}/written")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.globStatus(path(f"{base}/written/DELIVERY=*")):
        target = path(f"{base}/DAILY/{folder.getPath().getName().split('=')[1]}")
        fs.mkdirs(target)
        fs.rename(folder.getPath(), path(target, "ORDERS.DAT"))
    return base


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text the way a positional file delivers them, with defects by kind of event."""
    kind = F.col("event_type")
    cents = money("value", 12)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "view", "").otherwise(kind).alias("KIND"),
        F.when((kind == "click") & (cents < 50), F.concat(cents.cast("string"), F.lit("AB")))
        .when(kind == "signup", "  ")
        .otherwise(cents.cast("string"))
        .alias("AMOUNT"),
        F.when((kind == "error") & (cents > 100), "20240230")
        .when(kind == "error", "2024-01-01")
        .otherwise(F.date_format("ts", "yyyyMMdd"))
        .alias("DAY"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.when(kind == "purchase", "").otherwise("@x.org")).alias("MAIL"),
    )


# The same view for the comparison.
RAW_EVENTS_SQL = """
raw AS (
  SELECT event_id,
         CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS kind,
         CASE WHEN event_type = 'click' AND CAST(value AS DECIMAL(12,2)) < 50
              THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || 'AB'
              WHEN event_type = 'signup' THEN '  '
              ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS amount,
         CASE WHEN event_type = 'error' AND CAST(value AS DECIMAL(12,2)) > 100 THEN '20240230'
              WHEN event_type = 'error' THEN '2024-01-01'
              ELSE strftime(ts, '%Y%m%d') END AS day,
         'user' || CAST(user_id AS VARCHAR) || CASE WHEN event_type = 'purchase' THEN '' ELSE '@x.org' END AS mail
  FROM events
)
"""
