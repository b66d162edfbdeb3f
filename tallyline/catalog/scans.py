"""Sources: positional, delimited, JSON, packed; and the line formats they mirror."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyline.catalog.data import (
    DELIVERIES,
    FILE_NODE,
    ORDER_HEADER,
    ORDER_LAYOUT,
    ORDER_TRAILER,
    RAW_EVENTS_SQL,
    deliver_orders,
    number,
    order_records,
    raw_events,
)
from tallyline.catalog.registry import RUN_DATE, register, table
from tallyline.functions.fixed import cast_fields, format_lines, parse_lines
from tallyline.functions.packed import encode_packed, encode_text
from tallyline.operators.gates import count_gate
from tallyline.session import scratch_dir
from tallyline.sinks import writers
from tallyline.sources import readers, segments
from tallyline.sources.layout import FieldSpec, Layout
from tallyline.sources.paths import input_paths_between
from tallyline.sources.sample import sample_over
from tallyline.sources.segments import FILE

_ORDER_COLUMNS = """
  SELECT 'D' AS REC_TYPE, o_orderkey AS ORDER_KEY, o_custkey AS CUST_KEY, o_orderstatus AS STATUS,
         CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS TOTAL,
         strftime(o_orderdate, '%Y%m%d') AS ORDER_DATE, o_orderpriority AS PRIORITY
  FROM orders
"""
_DELIVERED = """
  SELECT CASE o_orderstatus WHEN 'F' THEN '20260304' WHEN 'O' THEN '20260305' ELSE '20260306' END AS delivery,
         CAST(o_totalprice AS DECIMAL(14,2)) AS total
  FROM orders
"""


def _shown(orders):
    return orders.select(
        *[c for c in ORDER_LAYOUT.columns if c not in ("TOTAL", "ORDER_DATE")],
        number("TOTAL").alias("TOTAL"),
        F.date_format("ORDER_DATE", "yyyyMMdd").alias("ORDER_DATE"),
    )


@register(_ORDER_COLUMNS)
def fixed_round_trip(spark, sf_dir):
    """SC4 SC10 SC12 SK4 SK5: records to lines and back, typed."""
    lines = format_lines(order_records(spark, sf_dir), ORDER_LAYOUT)
    return _shown(parse_lines(lines, ORDER_LAYOUT, as_types=True))


@register(
    """
    SELECT lpad(CAST(c_custkey AS VARCHAR), 10, ' ') || rpad(c_name, 20, ' ')
           || lpad(CAST(c_nationkey AS VARCHAR), 4, ' ')
           || CASE WHEN cents < 0 THEN '-' || lpad(CAST(-cents AS VARCHAR), 11, '0')
                   ELSE lpad(CAST(cents AS VARCHAR), 12, '0') END
           || lpad(c_mktsegment, 12, ' ') || repeat(' ', 6) AS value
    FROM (SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)
    """
)
def fixed_lines(spark, sf_dir):
    """SK4 SK5 SK7: number, text, scaled decimal with sign, JUSTIFIED RIGHT, padding."""
    layout = Layout.of(
        [
            FieldSpec("C-CUSTKEY", "long", length=10),
            FieldSpec("C-NAME", length=20),
            FieldSpec("C-NATIONKEY", "int", length=4),
            FieldSpec("C-ACCTBAL", "decimal", length=12, precision=2),
            FieldSpec("C-MKTSEGMENT", length=12, just_right=True),
        ],
        record_length=64,
    )
    return format_lines(table(spark, sf_dir, "customer"), layout)


@register(
    """
    SELECT o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 12, ' ') || rpad(o_orderstatus, 4, ' ')
           || repeat(' ', 5) || rpad(o_orderpriority, 8, ' ') AS value
    FROM orders
    """
)
def lines_by_position(spark, sf_dir):
    """SK8: columns taken in order, a gap, text cut to its length."""
    layout = Layout.of(
        [FieldSpec("A", "long", 1, 12), FieldSpec("B", "string", 13, 4), FieldSpec("C", "string", 22, 8)]
    )
    orders = table(spark, sf_dir, "orders")
    picked = orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return format_lines(picked, layout, map_by="position", keep=("o_custkey",))


def _delivered(spark, sf_dir, holidays=()):
    base = deliver_orders(spark, sf_dir)
    days = sorted(DELIVERIES.values())
    node = {**FILE_NODE, "source_path": base}
    paths = input_paths_between(node, days[0], days[-1], list(holidays))
    return readers.read_fixed(
        spark, paths, ORDER_LAYOUT, 1, 1, ORDER_HEADER, ORDER_TRAILER, keep_file=True
    )


def _delivery():
    return F.regexp_extract(FILE, r"/DAILY/(\d{8})/", 1).alias("delivery")


@register(
    f"""
    WITH d AS ({_DELIVERED})
    SELECT delivery, 'D' AS segment, count(*) AS n FROM d GROUP BY delivery
    UNION ALL SELECT DISTINCT delivery, 'H', CAST(1 AS BIGINT) FROM d
    UNION ALL SELECT DISTINCT delivery, 'T', CAST(1 AS BIGINT) FROM d
    """
)
def segments_split(spark, sf_dir):
    """SC6 SC16: header, data and trailer lines of several files of different size."""
    seg = _delivered(spark, sf_dir).segments
    parts = [
        frame.groupBy(_delivery()).agg(F.count(F.lit(1)).alias("n")).withColumn("segment", F.lit(mark))
        for mark, frame in (("H", seg.header), ("D", seg.data), ("T", seg.trailer))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(f"WITH d AS ({_DELIVERED}) SELECT delivery, count(*) AS n, CAST(sum(total) AS DOUBLE) AS total FROM d GROUP BY delivery")
def segments_by_mark(spark, sf_dir):
    """SC6: data lines told by the record type written in each line, one scan."""
    base = deliver_orders(spark, sf_dir)
    data = segments.by_mark(segments.read_lines(spark, f"{base}/DAILY/*/*")).data
    orders = parse_lines(data, ORDER_LAYOUT, as_types=True, keep=(FILE,))
    return orders.groupBy(_delivery()).agg(F.count(F.lit(1)).alias("n"), number(F.sum("TOTAL")).alias("total"))


@register(f"WITH d AS ({_DELIVERED}) SELECT DISTINCT delivery, delivery AS file_date, 'ORDERS' AS source FROM d")
def header_meta(spark, sf_dir):
    """SC7: header fields per file."""
    header = _delivered(spark, sf_dir).header
    return header.select(_delivery(), F.col("FILE_DATE").alias("file_date"), F.col("SRC_ID").alias("source"))


@register(
    f"""
    WITH d AS ({_DELIVERED})
    SELECT delivery, count(*) AS rec_count, lpad(CAST(CAST(sum(total) * 100 AS BIGINT) AS VARCHAR), 18, '0') AS total
    FROM d GROUP BY delivery
    """
)
def trailer_meta(spark, sf_dir):
    """SC8 SK6: trailer fields per file."""
    trailer = _delivered(spark, sf_dir).trailer
    return trailer.select(
        _delivery(),
        F.col("REC_COUNT").try_cast("bigint").alias("rec_count"),
        F.col("TOTAL_AMT").alias("total"),
    )


@register(
    f"""
    WITH d AS ({_DELIVERED})
    SELECT delivery, count(*) AS n, CAST(sum(total) AS DOUBLE) AS total
    FROM d WHERE delivery <> '20260305' GROUP BY delivery
    """
)
def dated_deliveries(spark, sf_dir):
    """SC16 CA2: deliveries of a date range, a holiday left out."""
    source = _delivered(spark, sf_dir, [{"active": True, "date": "2026-03-05"}])
    typed = readers.typed_fixed(source.data, ORDER_LAYOUT)
    return typed.groupBy(_delivery()).agg(
        F.count(F.lit(1)).alias("n"), number(F.sum("TOTAL")).alias("total")
    )


_CUSTOMERS = """
  SELECT c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS c_acctbal, c_mktsegment
  FROM customer
"""
_CUSTOMER_FIELDS = Layout.of(
    [
        FieldSpec("c_custkey", "long"),
        FieldSpec("c_name"),
        FieldSpec("c_nationkey", "int"),
        FieldSpec("c_acctbal", "double"),
        FieldSpec("c_mktsegment"),
    ]
)


@register(_CUSTOMERS)
def skip_delimited(spark, sf_dir):
    """SC3 SK3: delimited text between blank header and trailer lines."""
    path = scratch_dir(spark, "delimited")
    writers.write_delimited(table(spark, sf_dir, "customer"), path, ";", header_count=2, trailer_count=1)
    return readers.read_delimited_segments(spark, path, _CUSTOMER_FIELDS, 2, 1, ";")


@register(_CUSTOMERS)
def delimited_scan(spark, sf_dir):
    """SC2 SC23 SK2: delimited text with declared types, own quote character."""
    path = scratch_dir(spark, "delimited")
    writers.write_delimited(table(spark, sf_dir, "customer"), path, "|", quote="'")
    return readers.read_delimited(spark, path, _CUSTOMER_FIELDS, "|", quote="'")


@register(_CUSTOMERS)
def json_scan(spark, sf_dir):
    """SC20 SK20: JSON lines with declared types."""
    path = scratch_dir(spark, "json")
    writers.write_json(table(spark, sf_dir, "customer"), path)
    return readers.read_json(spark, path, _CUSTOMER_FIELDS)


@register("SELECT o_orderstatus, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'")
def partitioned_files(spark, sf_dir):
    """SC1 SK1 SK20: Parquet in folders by value; the filter skips whole folders."""
    path = scratch_dir(spark, "parquet")
    writers.write_parquet(table(spark, sf_dir, "orders"), path, partition_by=["o_orderstatus"])
    rows = readers.read_parquet(spark, path).filter(F.col("o_orderstatus") != "P")
    return rows.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@register(
    f"""
    WITH {RAW_EVENTS_SQL}
    SELECT event_id, strftime(try_strptime(day, '%Y%m%d'), '%Y-%m-%d') AS day,
           CAST(TRY_CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS amount
    FROM raw
    """
)
def typed_fields(spark, sf_dir):
    """SC12: declared types on text, bad values become NULL."""
    layout = Layout.of(
        [
            FieldSpec("DAY", "date", format="YYYYMMDD"),
            FieldSpec("AMOUNT", "decimal", precision=2),
        ]
    )
    typed = cast_fields(raw_events(spark, sf_dir), layout)
    return typed.select(
        "event_id",
        F.date_format("DAY", "yyyy-MM-dd").alias("day"),
        number("AMOUNT").alias("amount"),
    )


@register(
    """
    SELECT count(*) FILTER (length(text) > 500) AS too_wide, count(*) FILTER (length(text) < 500) AS too_short
    FROM documents
    """
)
def width_check(spark, sf_dir):
    """SC11: lines longer and shorter than the record."""
    return segments.width_check(table(spark, sf_dir, "documents").select(F.col("text").alias("value")), 500)


@register(_ORDER_COLUMNS)
def offset_shift(spark, sf_dir):
    """SC9: starts counted through all record groups, record length not declared."""
    shifted = Layout.of([FieldSpec(f.name, f.type, f.start + 120, f.length, f.precision, format=f.format) for f in ORDER_LAYOUT], continued=True)
    lines = format_lines(order_records(spark, sf_dir), ORDER_LAYOUT)
    return _shown(parse_lines(lines, shifted, as_types=True))


@register(
    """
    SELECT p_partkey, p_name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
           CAST(-CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS rebate, CAST(p_size AS DOUBLE) AS size
    FROM part
    """
)
def packed_records(spark, sf_dir):
    """SC13 SC14 SK16: EBCDIC text, COMP-3 with both signs, COMP, from one record of bytes."""
    part = table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(12,2)")
    record = F.concat(
        encode_text(F.rpad("p_name", 30, " ")),
        encode_packed(price, 7, 2),
        encode_packed(-price, 7, 2),
        F.unhex(F.lpad(F.hex(F.col("p_size").cast("bigint")), 8, "0")),
        F.unhex(F.lpad(F.hex("p_partkey"), 16, "0")),
    )
    layout = Layout.of(
        [
            FieldSpec("p_name", length=30),
            FieldSpec("price", "decimal", length=7, precision=2, usage="COMP-3"),
            FieldSpec("rebate", "decimal", length=7, precision=2, usage="COMP-3"),
            FieldSpec("size", "long", length=4, usage="COMP"),
            FieldSpec("p_partkey", "long", length=8, usage="COMP"),
        ]
    )
    decoded = readers.decode_records(part.select(record.alias("record")), layout)
    return decoded.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"),
        "p_name",
        number("price").alias("price"),
        number("rebate").alias("rebate"),
        number("size").alias("size"),
    )


@register("SELECT count(*) AS expected, count(*) AS actual, true AS ok FROM orders")
def count_file_gate(spark, sf_dir):
    """SC19 SK12 VA18: a count file beside the data."""
    orders = table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "count")
    writers.count_lines(orders).write.text(path)
    return count_gate(orders, readers.read_count_file(spark, path))


@register(
    """
    SELECT lpad(CAST((o_orderkey + 1) * 100 % 1000000000000 AS VARCHAR), 12, '0') AS AMOUNT,
           strftime(DATE '2026-03-10' - CAST(o_orderkey % 365 AS INTEGER), '%Y%m%d') AS VALUE_DATE,
           CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS ACTIVE,
           chr(CAST(65 + (o_orderkey + 1) % 26 AS INTEGER)) AS KIND
    FROM orders
    """
)
def sample_rows(spark, sf_dir):
    """SC22: plausible rows from field definitions, one per order."""
    layout = Layout.of(
        [
            FieldSpec("AMOUNT", "decimal", length=12, precision=2),
            FieldSpec("VALUE-DATE", "date", length=8),
            FieldSpec("ACTIVE", "boolean", length=5),
            FieldSpec("KIND", length=1),
        ]
    )
    return sample_over(table(spark, sf_dir, "orders"), "o_orderkey", layout, RUN_DATE)


@register("SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-02-01'")
def path_dates(spark, sf_dir):
    """SC17: a path-date expression as the bound of a scan."""
    from tallyline.functions.dates import partition_value

    run_date = date(1995, 1, 31)
    first = partition_value("date_format(current_date(), 'yyyy-MM')", run_date) + "-01"
    last = partition_value("last_day(current_date())", run_date)
    day = F.date_format("o_orderdate", "yyyyMMdd")
    orders = table(spark, sf_dir, "orders")
    return orders.filter((F.col("o_orderdate") >= F.lit(first)) & (day <= last)).agg(
        F.count(F.lit(1)).alias("n")
    )
