"""Validation, gates, calendar, control records, reconciliation."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tallyline.catalog.data import (
    ORDER_HEADER,
    ORDER_LAYOUT,
    ORDER_TRAILER,
    RAW_EVENTS_SQL,
    deliver_orders,
    money,
    number,
    order_records,
    raw_events,
)
from tallyline.catalog.registry import RUN_DATE, register, table
from tallyline.functions.dates import previous_business_day_of
from tallyline.functions.fixed import format_lines, parse_lines
from tallyline.operators import control, gates, validate
from tallyline.operators.reconcile import reconcile
from tallyline.sinks import incidents
from tallyline.sources import readers
from tallyline.sources.layout import FieldSpec, Layout
from tallyline.sources.segments import FILE

# -- validation ---------------------------------------------------------------

_EVENT_RULES = [
    {"field": "KIND", "data_type": "TEXT", "nullable": False, "max_length": 6, "format": "ALPHA"},
    {"field": "AMOUNT", "data_type": "NUMBER", "max_length": 6, "format": "NUMERIC"},
    {"field": "DAY", "data_type": "DATE", "nullable": False, "date_format": "yyyyMMdd"},
    {"field": "DAY", "format": "REGEX", "pattern": "^[0-9]{8}$"},
    {"field": "MAIL", "data_type": "TEXT", "format": "EMAIL"},
]


def _message(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN '{text}' END"


_EVENT_MESSAGES = ", ".join(
    [
        _message("trim(kind) = ''", "''KIND'' must not be null or empty"),
        _message("length(kind) > 6", "''KIND'' exceeds max length 6"),
        _message(
            "trim(kind) <> '' AND NOT regexp_matches(kind, '^[A-Za-z\\s]+$')",
            "''KIND'' is not a valid alpha value",
        ),
        _message(
            "trim(amount) <> '' AND TRY_CAST(trim(amount) AS DOUBLE) IS NULL",
            "''AMOUNT'' is not a valid number",
        ),
        _message("length(amount) > 6", "''AMOUNT'' exceeds max length 6"),
        _message(
            "trim(amount) <> '' AND NOT regexp_matches(amount, '^\\d+(\\.\\d+)?$')",
            "''AMOUNT'' is not a valid numeric value",
        ),
        _message(
            "try_strptime(day, '%Y%m%d') IS NULL",
            "''DAY'' is not a valid date (expected: yyyyMMdd)",
        ),
        _message(
            "NOT regexp_matches(day, '^[0-9]{8}$')",
            "''DAY'' does not match pattern ''^[0-9]{8}$''",
        ),
        _message(
            "NOT regexp_matches(mail, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')",
            "''MAIL'' is not a valid email value",
        ),
    ]
)
_CHECKED = f"WITH {RAW_EVENTS_SQL}, checked AS (SELECT *, concat_ws('; ', {_EVENT_MESSAGES}) AS errors FROM raw)"


@register(f"{_CHECKED} SELECT event_id, errors, errors = '' AS ok FROM checked")
def validate_flags(spark, sf_dir):
    """VA1-VA8 VA11: every row annotated."""
    rows = validate.annotate(raw_events(spark, sf_dir), _EVENT_RULES)
    return rows.select(
        "event_id", F.col(validate.ERRORS).alias("errors"), F.col(validate.VALID).alias("ok")
    )


@register(f"{_CHECKED} SELECT event_id, kind AS KIND, amount AS AMOUNT, day AS DAY, mail AS MAIL FROM checked WHERE errors = ''")
def validate_drop(spark, sf_dir):
    """VA12: valid rows only, as they came."""
    return validate.shape(raw_events(spark, sf_dir), _EVENT_RULES, "DROP")


@register(f"{_CHECKED} SELECT errors, count(*) AS n FROM checked WHERE errors <> '' GROUP BY errors")
def validate_errors(spark, sf_dir):
    """VA12 VA13: rejected rows, counted by what is wrong with them."""
    _, rejected = validate.split_valid(raw_events(spark, sf_dir), _EVENT_RULES)
    return rejected.groupBy(F.col(validate.ERRORS).alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@register(
    f"""
    WITH {RAW_EVENTS_SQL}
    SELECT event_id, '' AS errors, true AS ok FROM raw
    """
)
def validate_no_rules(spark, sf_dir):
    """VA9 VA10: no rule applies; one for an absent field is skipped on request."""
    rows = validate.annotate(raw_events(spark, sf_dir), [{"field": "NOT-THERE"}], on_missing="skip")
    return rows.select(
        "event_id", F.col(validate.ERRORS).alias("errors"), F.col(validate.VALID).alias("ok")
    )


@register(
    f"""
    WITH {RAW_EVENTS_SQL}
    SELECT event_id, concat_ws('; ',
             CASE WHEN trim(kind) = '' THEN '''KIND'' must not be null or empty' END,
             CASE WHEN trim(kind) <> '' AND kind NOT IN ('click', 'signup', 'purchase') THEN '''KIND'' is not in the list' END,
             CASE WHEN trim(amount) <> '' AND coalesce(TRY_CAST(trim(amount) AS DOUBLE) NOT BETWEEN 1 AND 200, true)
                  THEN '''AMOUNT'' is not in the range 1..200' END,
             CASE WHEN length(mail) NOT BETWEEN 5 AND 12 THEN '''MAIL'' does not have a length in the range 5..12' END,
             CASE WHEN NOT regexp_matches(day, '^2024') THEN '''DAY'' does not match pattern ''^2024''' END) AS errors
    FROM raw
    """
)
def validate_checks(spark, sf_dir):
    """VA14: not_null, in_list, in_range, length, regex."""
    rules = [
        {"field": "KIND", "check": "not_null"},
        {"field": "KIND", "check": "in_list", "params": {"values": ["click", "signup", "purchase"]}},
        {"field": "AMOUNT", "check": "in_range", "params": {"min": 1, "max": 200}},
        {"field": "MAIL", "check": "length", "params": {"min": 5, "max": 12}},
        {"field": "DAY", "check": "regex", "params": {"pattern": "^2024"}},
    ]
    rows = validate.annotate(raw_events(spark, sf_dir), rules)
    return rows.select("event_id", F.col(validate.ERRORS).alias("errors"))


@register(
    """
    SELECT event_id,
           CASE WHEN event_type = 'view' AND try_strptime(stamp, '%Y%m%d %H:%M:%S') IS NULL
                THEN '''STAMP'' is not a valid timestamp (expected: yyyyMMdd HH:mm:ss)' ELSE '' END AS errors
    FROM (SELECT event_id, event_type, strftime(ts, '%Y%m%d ') || CASE WHEN event_type = 'view' THEN '25' ELSE '' END
                 || strftime(ts, '%H:%M:%S') AS stamp FROM events)
    """
)
def validate_timestamps(spark, sf_dir):
    """VA4."""
    stamp = F.concat(
        F.date_format("ts", "yyyyMMdd "),
        F.when(F.col("event_type") == "view", "25").otherwise(""),
        F.date_format("ts", "HH:mm:ss"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", stamp.alias("STAMP"))
    checked = validate.annotate(rows, [{"field": "STAMP", "data_type": "TIMESTAMP"}])
    return checked.select("event_id", F.col(validate.ERRORS).alias("errors"))


@register(
    """
    SELECT ORDER_KEY, concat_ws('; ',
             CASE WHEN STATUS = '' THEN '''STATUS'' must not be null or empty' END,
             CASE WHEN length(PRIORITY) > 8 THEN '''PRIORITY'' exceeds max length 8' END) AS errors
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS ORDER_KEY,
                 CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderstatus END AS STATUS, o_orderpriority AS PRIORITY
          FROM orders)
    """
)
def rules_from_layout(spark, sf_dir):
    """VA15: rules that follow from the field definitions, applied to parsed lines."""
    records = order_records(spark, sf_dir).withColumn(
        "STATUS", F.when(F.col("PRIORITY") != "5-LOW", F.col("STATUS"))
    )
    lines = parse_lines(format_lines(records, ORDER_LAYOUT), ORDER_LAYOUT)
    declared = Layout.of(
        [
            FieldSpec("ORDER-KEY", "long", length=10),
            FieldSpec("STATUS", length=1, nullable=False),
            FieldSpec("TOTAL", "decimal", length=14, precision=2),
            FieldSpec("ORDER-DATE", "date", length=8, format="yyyyMMdd"),
            FieldSpec("PRIORITY", length=8),
        ]
    )
    rows = validate.annotate(lines, declared.rules())
    return rows.select("ORDER_KEY", F.col(validate.ERRORS).alias("errors"))


@register(
    f"""
    {_CHECKED}
    SELECT event_id, CASE WHEN bad_kind OR bad_day THEN 'N' ELSE 'Y' END AS VAL_FLAG, '20260310103045' AS PROC_TS,
           CASE WHEN bad_kind THEN 'E001' WHEN bad_day THEN 'E002' ELSE '0000' END AS ERR_CODE
    FROM (SELECT event_id, trim(kind) = '' AS bad_kind, try_strptime(day, '%Y%m%d') IS NULL AS bad_day FROM checked)
    """
)
def enriched_output(spark, sf_dir):
    """VA24: flag, time and code columns of an output record."""
    rules = [
        {"field": "KIND", "nullable": False},
        {"field": "DAY", "data_type": "date", "code": "E002"},
    ]
    rows = validate.enrich(raw_events(spark, sf_dir), rules, datetime(2026, 3, 10, 10, 30, 45))
    return rows.select("event_id", "VAL_FLAG", "PROC_TS", "ERR_CODE")


# -- gates --------------------------------------------------------------------

_PER_STATUS = """
  SELECT CASE o_orderstatus WHEN 'F' THEN '20260304' WHEN 'O' THEN '20260305' ELSE '20260306' END AS delivery,
         count(*) AS n FROM orders GROUP BY 1
"""


def _deliveries(spark, sf_dir):
    base = deliver_orders(spark, sf_dir)
    return readers.read_fixed(
        spark,
        f"{base}/DAILY/*/*",
        ORDER_LAYOUT,
        1,
        1,
        ORDER_HEADER,
        ORDER_TRAILER,
        keep_file=True,
    )


def _delivery():
    return F.regexp_extract(FILE, r"/DAILY/(\d{8})/", 1)


@register(
    f"SELECT delivery, n - 2 AS expected, n AS actual, false AS ok FROM ({_PER_STATUS})"
)
def count_gate_inclusive(spark, sf_dir):
    """VA17: trailers that count header and trailer lines; these ones do not, so the gate fails."""
    source = _deliveries(spark, sf_dir)
    expected = gates.trailer_count(source.trailer, "REC-COUNT", "inclusive", 1, 1)
    gate = gates.count_gate_by_file(source.data, expected)
    return gate.select(_delivery().alias("delivery"), "expected", "actual", "ok")


@register(f"SELECT delivery, n AS expected, n AS actual, true AS ok FROM ({_PER_STATUS})")
def count_gate_data(spark, sf_dir):
    """VA16 VA17: trailers that count data rows only."""
    source = _deliveries(spark, sf_dir)
    expected = gates.trailer_count(source.trailer, "REC-COUNT", "data")
    gate = gates.count_gate_by_file(source.data, expected)
    return gate.select(_delivery().alias("delivery"), "expected", "actual", "ok")


@register(
    """
    SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN '20260304' WHEN 'O' THEN '20260305' ELSE '20260306' END AS delivery,
           '2026-03-05' AS expected, CASE WHEN o_orderstatus = 'O' THEN 'OK' ELSE 'MISMATCH' END AS status
    FROM orders
    """
)
def previous_day_gate(spark, sf_dir):
    """VA19 VA20: is the header date the business day before the run, past a holiday?"""
    source = _deliveries(spark, sf_dir)
    holidays = [{"active": True, "date": "2026-03-06"}, {"active": False, "date": "2026-03-05"}]
    gate = gates.header_date_gate(source.header, "FILE-DATE", date(2026, 3, 7), holidays)
    return gate.select(
        _delivery().alias("delivery"), F.date_format("expected", "yyyy-MM-dd").alias("expected"), "status"
    )


@register(
    f"""
    WITH {RAW_EVENTS_SQL}
    SELECT event_id, CASE WHEN try_strptime(day, '%Y%m%d') IS NULL AND regexp_matches(day, '^[0-9]{{8}}$') THEN 'INVALID_DATE'
                          WHEN try_strptime(day, '%Y%m%d') IS NULL THEN 'PARSE_ERROR'
                          WHEN day = '20240101' THEN 'OK' ELSE 'MISMATCH' END AS status
    FROM raw
    """
)
def date_status(spark, sf_dir):
    """VA20: an impossible date is told from a wrong format."""
    rows = raw_events(spark, sf_dir)
    status = gates.date_status(F.col("DAY"), F.lit(date(2024, 1, 1)))
    return rows.select("event_id", status.alias("status"))


_HOLIDAYS = ["1995-01-02", "1995-01-03", {"active": True, "date": "1998-07-04"}, {"active": False, "date": "1998-07-05"}]
_HOLIDAY_SQL = "(VALUES (DATE '1995-01-02'), (DATE '1995-01-03'), (DATE '1998-07-04')) AS h(day)"


@register(
    f"""
    SELECT CAST(day AS VARCHAR) AS day FROM (
      SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day
      EXCEPT SELECT day FROM {_HOLIDAY_SQL}
      EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders)
    """
)
def delivery_gaps(spark, sf_dir):
    """VA22 CA2: days of the calendar on which nothing arrived."""
    gaps = gates.delivery_gaps(table(spark, sf_dir, "orders"), "o_orderdate", date(1995, 1, 1), date(2001, 12, 31), _HOLIDAYS)
    return gaps.select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@register(
    """
    SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN '20260304' WHEN 'O' THEN '20260305' ELSE '20260306' END AS delivery,
           'OK' AS status FROM orders
    """
)
def delivery_check(spark, sf_dir):
    """VA22: header dates against the dates of the folders."""
    header = _deliveries(spark, sf_dir).header
    check = gates.delivery_check(header, "FILE-DATE", F.to_date(_delivery(), "yyyyMMdd"))
    return check.select(_delivery().alias("delivery"), "status")


@register(
    f"""
    SELECT DISTINCT CAST(d AS VARCHAR) AS day,
           CAST((SELECT max(c) FROM (VALUES (d - 1), (d - 2), (d - 3)) AS t(c)
                 WHERE c NOT IN (SELECT day FROM {_HOLIDAY_SQL})) AS VARCHAR) AS previous
    FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
    """
)
def prev_business_day(spark, sf_dir):
    """CA1: the day before, holidays skipped, weekends not."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    previous = previous_business_day_of(F.col("d"), _HOLIDAYS)
    text = "yyyy-MM-dd"
    return days.select(F.date_format("d", text).alias("day"), F.date_format(previous, text).alias("previous"))


@register(
    f"""
    {_CHECKED}
    SELECT 'dataflow.events.check.validation' AS alert_key, 4 AS severity, CAST(count(*) AS VARCHAR) AS actual,
           (SELECT string_agg(errors, ' | ' ORDER BY event_id) FROM
             (SELECT event_id, errors FROM checked WHERE errors <> '' ORDER BY event_id LIMIT 5)) AS samples
    FROM checked WHERE errors <> ''
    """
)
def incident_rows(spark, sf_dir):
    """AL1 SO3: the incident of a failed validation, with its first five messages."""
    _, rejected = validate.split_valid(raw_events(spark, sf_dir), _EVENT_RULES)
    rows = incidents.validation_incidents(
        rejected, validate.ERRORS, "events", "check", ["event_id"], datetime(2026, 3, 10)
    )
    return rows.select("alert_key", "severity", "actual", F.array_join("samples", " | ").alias("samples"))


# -- control records ----------------------------------------------------------


@register(
    """
    SELECT count(*) AS REC_COUNT, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS TOTAL_AMT,
           CAST(sum(l_suppkey) AS BIGINT) AS HASH_TOTAL, count(*) FILTER (l_returnflag = 'R') AS ERR_COUNT,
           count(*) FILTER (l_returnflag <> 'R') AS VALID_CNT, 'LINEITEM' AS SOURCE
    FROM lineitem
    """
)
def control_row(spark, sf_dir):
    """CT1 CT6: counts, totals and hash total in one aggregation."""
    items = table(spark, sf_dir, "lineitem").withColumn("PRICE", money("l_extendedprice"))
    row = control.control_row(
        items,
        [
            {"name": "REC-COUNT", "type": "LONG"},
            {"name": "TOTAL-AMT", "type": "DECIMAL", "expression": "sum(PRICE)"},
            {"name": "HASH-TOTAL", "type": "LONG", "expression": "sum(l-suppkey)"},
            {"name": "ERR-COUNT", "type": "LONG", "expression": "count_if(l-returnflag = 'R')"},
            {"name": "VALID-CNT", "type": "LONG", "expression": "count_if(l_returnflag <> 'R')"},
            {"name": "SOURCE", "expression": "'LINEITEM'"},
        ],
    )
    return row.withColumn("TOTAL_AMT", number("TOTAL_AMT"))


@register(
    """
    SELECT rpad('COUNT', 13, ' ') || rpad('FIRST', 8, ' ') || rpad('SOURCE', 8, ' ') || rpad('TOTAL', 22, ' ') || rpad('NAME', 20, ' ') AS value
    UNION ALL
    SELECT lpad(CAST(count(*) AS VARCHAR), 13, '0') || strftime(min(o_orderdate), '%Y%m%d') || lpad('105', 8, ' ')
           || lpad(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS VARCHAR), 22, ' ') || rpad('ORDERS.DAT', 20, ' ')
    FROM orders
    """
)
def control_line(spark, sf_dir):
    """CT2 CT4: zero-filled number, date, JUSTIFIED RIGHT text, decimal, text; a line of names."""
    fields = [
        {"name": "COUNT", "type": "LONG", "length": 13},
        {"name": "FIRST", "type": "DATE", "length": 8, "expression": "min(ORDER-DATE)", "format": "YYYYMMDD"},
        {"name": "SOURCE", "length": 8, "expression": "'105'", "just_right": True},
        {"name": "TOTAL", "type": "DECIMAL", "length": 22, "expression": "sum(TOTAL)"},
        {"name": "NAME", "expression": "'ORDERS.DAT'"},
    ]
    return control.control_file(order_records(spark, sf_dir), fields, names=True)


@register(
    """
    SELECT '  ' || lpad(CAST(count(*) AS VARCHAR), 10, '0') || '   ' || rpad('END', 5, ' ') AS value FROM orders
    """
)
def control_begin(spark, sf_dir):
    """CT3: absolute positions, with a gap and in any order."""
    fields = [
        {"name": "MARK", "length": 5, "begin": 16, "expression": "'END'"},
        {"name": "COUNT", "type": "LONG", "length": 10, "begin": 3},
    ]
    return control.control_file(table(spark, sf_dir, "orders"), fields)


@register(
    """
    SELECT count(*) AS RECORDS, '20260306' AS EFFECTIVE, '20260331' AS MONTH_END, 'ORDERS' AS SOURCE
    FROM orders
    """
)
def control_header_dates(spark, sf_dir):
    """CT5: dates and text of the file's header line."""
    base = deliver_orders(spark, sf_dir, F.lit("20260306"))
    source = readers.read_fixed(
        spark, f"{base}/DAILY/20260306/ORDERS.DAT", ORDER_LAYOUT, 1, 1, ORDER_HEADER
    )
    return control.control_row(
        source.data,
        [
            {"name": "RECORDS", "type": "LONG"},
            {"name": "EFFECTIVE", "expression": "to_date(first(FILE-DATE),'yyyyMMdd')"},
            {"name": "MONTH-END", "expression": "last_day(to_date(first(FILE-DATE),'yyyyMMdd'))"},
            {"name": "SOURCE", "expression": "first(SRC-ID)"},
        ],
        source.header,
    )


@register(
    """
    SELECT CAST(count(*) AS VARCHAR) AS COUNT, strftime(min(o_orderdate), '%Y%m%d') AS FIRST, 'ORDERS.DAT' AS NAME FROM orders
    """
)
def control_read_back(spark, sf_dir):
    """CT7: control text to columns, leading zeros dropped."""
    fields = [
        {"name": "COUNT", "type": "LONG", "length": 13},
        {"name": "FIRST", "type": "DATE", "length": 8, "expression": "min(ORDER-DATE)"},
        {"name": "NAME", "expression": "'ORDERS.DAT'"},
    ]
    lines = control.control_file(order_records(spark, sf_dir), fields)
    return control.read_control_lines(lines, fields)


# -- reconciliation -----------------------------------------------------------


def _expected_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ORDER-ID"),
        F.col("o_orderstatus").alias("STATUS"),
        money("o_totalprice", 14).alias("TOTAL-AMT"),
        F.col("o_orderpriority").alias("PRIORITY"),
    )


def _produced_orders(spark, sf_dir):
    """Orders with rows missing, added, twice, changed, and written another way."""
    orders = table(spark, sf_dir, "orders")
    low = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    cents = money("o_totalprice", 14)
    kept = orders.filter(~low).select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("order_id"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400000), "X")
        .otherwise(F.col("o_orderstatus"))
        .alias("status"),
        F.concat(F.lit(" "), cents.cast("string"), F.lit("0")).alias("Total Amt"),
        F.col("o_orderpriority").alias("priority"),
    )
    twice = kept.filter((F.col("priority") == "1-URGENT") & (F.col("status") == "F"))
    return kept.unionByName(twice)


# Rows with the values as they are compared, copies that agree taken out on both sides.
_RECONCILED = """
WITH e AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status,
         rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR), '0'), '.') AS total, o_orderpriority AS priority
  FROM orders
), kept AS (
  SELECT id, CASE WHEN e.status = 'O' AND o.o_totalprice > 400000 THEN 'X' ELSE e.status END AS status, total, priority
  FROM e JOIN orders o ON e.id = CAST(o.o_orderkey AS VARCHAR)
  WHERE NOT (e.priority = '5-LOW' AND e.status = 'P')
), g AS (
  SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE priority = '1-URGENT' AND status = 'F'
), el AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(chr(1), id, status, total, priority))) AS n
  FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM g)
), gl AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(chr(1), id, status, total, priority))) AS n
  FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM e)
), p AS (
  SELECT el.id AS eid, el.status AS es, el.total AS et, el.priority AS ep,
         gl.id AS gid, gl.status AS gs, gl.total AS gt, gl.priority AS gp
  FROM el FULL JOIN gl ON el.id = gl.id AND el.n = gl.n
)
"""


@register(
    f"""
    {_RECONCILED}
    SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM el) AS matched,
           count(*) FILTER (eid IS NOT NULL AND gid IS NOT NULL) AS differing,
           count(*) FILTER (gid IS NULL) AS only_in_expected, count(*) FILTER (eid IS NULL) AS only_in_generated,
           CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM p
    """
)
def reconcile_summary(spark, sf_dir):
    """RE1 RE2 RE3 RE4 RE6: key and columns found by name, values normalised, totals."""
    return reconcile(_expected_orders(spark, sf_dir), _produced_orders(spark, sf_dir)).summary()


@register(
    f"""
    {_RECONCILED}, c AS (
      SELECT eid AS key, 'STATUS' AS col, es AS expected, gs AS generated FROM p WHERE es <> gs
      UNION ALL SELECT eid, 'TOTAL-AMT', et, gt FROM p WHERE et <> gt
      UNION ALL SELECT eid, 'PRIORITY', ep, gp FROM p WHERE ep <> gp)
    SELECT key, col, expected, generated, count(*) AS copies FROM c GROUP BY ALL
    """
)
def reconcile_cells(spark, sf_dir):
    """RE5: differing cells."""
    return reconcile(_expected_orders(spark, sf_dir), _produced_orders(spark, sf_dir), ["ORDER-ID"]).cells()


@register(
    f"""
    {_RECONCILED}
    SELECT CASE WHEN gid IS NULL THEN 'only_in_expected' WHEN eid IS NULL THEN 'only_in_generated' ELSE 'cells' END AS type,
           coalesce(eid, '') AS expected, coalesce(gid, '') AS generated, count(*) AS copies
    FROM p GROUP BY ALL
    """
)
def reconcile_rows(spark, sf_dir):
    """RE4 RE5: what differs and what is on one side only."""
    found = reconcile(_expected_orders(spark, sf_dir), _produced_orders(spark, sf_dir)).differences()
    blank = F.lit("")
    return found.select(
        "type",
        F.coalesce(F.col("expected.`ORDER-ID`"), blank).alias("expected"),
        F.coalesce(F.col("generated.`ORDER-ID`"), blank).alias("generated"),
        "copies",
    )


_FLAGS = """
WITH e AS (SELECT l_returnflag AS flag, CAST(l_linenumber AS VARCHAR) AS line, l_linestatus AS status FROM lineitem),
g AS (SELECT flag, line, CASE WHEN flag = 'R' AND status = 'F' THEN 'Z' ELSE status END AS status FROM e
      WHERE NOT (flag = 'A' AND line = '7')),
el AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY md5(concat_ws(chr(1), flag, line, status))) AS n
       FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM g)),
gl AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY md5(concat_ws(chr(1), flag, line, status))) AS n
       FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM e))
SELECT coalesce(el.flag || el.line || el.status, '') AS expected, coalesce(gl.flag || gl.line || gl.status, '') AS generated,
       count(*) AS copies
FROM el FULL JOIN gl ON el.flag = gl.flag AND el.n = gl.n GROUP BY ALL
"""


@register(_FLAGS)
def reconcile_copies(spark, sf_dir):
    """RE4: three keys share all line items; copies are paired by counting."""
    expected = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status")
    )
    changed = (F.col("flag") == "R") & (F.col("status") == "F")
    produced = expected.filter(~((F.col("flag") == "A") & (F.col("line") == 7))).withColumn(
        "status", F.when(changed, "Z").otherwise(F.col("status"))
    )
    found = reconcile(expected, produced, ["flag"]).differences()
    text = {s: F.concat(*[F.col(f"{s}.{c}") for c in ("flag", "line", "status")]) for s in ("expected", "generated")}
    return (
        found.groupBy(*[F.coalesce(t, F.lit("")).alias(s) for s, t in text.items()])
        .agg(F.sum("copies").alias("copies"))
        .select("expected", "generated", "copies")
    )
