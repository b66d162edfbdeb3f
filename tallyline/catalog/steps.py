"""Filters, joins, aggregates, column arithmetic, sorts and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.data import ORDER_LAYOUT, money, number, order_records
from tallyline.catalog.registry import register, table
from tallyline.functions.fixed import format_lines, parse_lines
from tallyline.operators import aggregates, filters, joins, project, sets
from tallyline.session import scratch_dir
from tallyline.sources.layout import FieldSpec, Layout

# -- filters ------------------------------------------------------------------


@register(
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_totalprice > 250000 AND o_orderstatus <> 'F' AND o_custkey <= 700 AND o_custkey >= 3
      AND o_totalprice < 400000.5
    """
)
def filter_compare(spark, sf_dir):
    """FI1 FI4: comparisons under several spellings, joined by AND; all reach the scan."""
    rows = filters.filter_rows(
        table(spark, sf_dir, "orders"),
        [
            {"field": "o-totalprice", "operation": ">", "value": 250000},
            {"field": "o_orderstatus", "operation": "not_equals", "value": "F"},
            {"field": "o_custkey", "op": "le", "value": 700},
            {"field": "o_custkey", "op": "greater_equal", "value": "3"},
            {"field": "o_totalprice", "op": "lt", "value": 400000.5},
        ],
    )
    return rows.select("o_orderkey", "o_custkey")


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
def filter_equal(spark, sf_dir):
    """FI1: equality is the default operation."""
    rows = filters.filter_rows(
        table(spark, sf_dir, "orders"),
        [{"field": "o_orderstatus", "value": "P"}, {"field": "o_orderpriority", "op": "equals", "value": "5-LOW"}],
    )
    return rows.select("o_orderkey")


@register("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def filter_in(spark, sf_dir):
    """FI2."""
    rows = filters.filter_rows(
        table(spark, sf_dir, "events"), [{"field": "event_type", "op": "in_list", "value": ["click", "view"]}]
    )
    return rows.select("event_id")


_NULLED = "(SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events)"


def _with_nulls(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))


@register(f"SELECT event_id, kind FROM {_NULLED} WHERE kind NOT IN ('click', 'view')")
def filter_not_in(spark, sf_dir):
    """FI3: NULL is not "not in"."""
    test = [{"field": "kind", "op": "not_in", "value": ["click", "view"]}]
    return filters.filter_rows(_with_nulls(spark, sf_dir), test).select("event_id", "kind")


@register(
    f"""
    SELECT event_id, 'null' AS side FROM {_NULLED} WHERE kind IS NULL
    UNION ALL SELECT event_id, 'value' FROM {_NULLED} WHERE kind IS NOT NULL
    """
)
def filter_null(spark, sf_dir):
    """FI6: is_null and is_not_null."""
    rows = _with_nulls(spark, sf_dir)
    absent = filters.filter_rows(rows, [{"field": "kind", "op": "is_null"}])
    present = filters.filter_rows(rows, [{"field": "kind", "op": "is_not_null"}])
    return absent.select("event_id", F.lit("null").alias("side")).union(
        present.select("event_id", F.lit("value").alias("side"))
    )


@register("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'bolt')")
def filter_contains(spark, sf_dir):
    """FI6."""
    rows = filters.filter_rows(
        table(spark, sf_dir, "part"), [{"field": "p_name", "op": "contains", "value": "bolt"}]
    )
    return rows.select("p_partkey", "p_name")


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity - l_linenumber > 30 AND l_returnflag = 'R'")
def filter_condition(spark, sf_dir):
    """FI7: a condition in SQL with hyphen names."""
    rows = filters.filter_rows(
        table(spark, sf_dir, "lineitem"), "l-quantity - l-linenumber > 30 and l-returnflag = 'R'"
    )
    return rows.select("l_orderkey", "l_linenumber")


@register(
    """
    SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'n/a'
                          ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS v FROM events)
    WHERE TRY_CAST(v AS DECIMAL(18,2)) > 40
    """
)
def filter_text_number(spark, sf_dir):
    """FI1: text compared with a number; text that is none matches nothing."""
    text = F.when(F.col("event_type") == "click", "n/a").otherwise(money("value").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("v"))
    return filters.filter_rows(rows, [{"field": "v", "op": ">", "value": 40}]).select("event_id")


@register(f"SELECT event_id, kind FROM {_NULLED} WHERE kind IN ('purchase', 'signup')")
def split_valid(spark, sf_dir):
    """FI5 FI8: the rows of the list."""
    valid, _ = filters.split_members(_with_nulls(spark, sf_dir), "kind", ["purchase", "signup"])
    return valid.select("event_id", "kind")


@register(f"SELECT event_id, kind FROM {_NULLED} WHERE kind IS NULL OR kind NOT IN ('purchase', 'signup')")
def split_reject(spark, sf_dir):
    """FI5 FI8: all others, NULL among them."""
    logic = {"else_branch": True, "field": "kind", "value_list": ["purchase", "signup"]}
    return filters.filter_step(_with_nulls(spark, sf_dir), logic).select("event_id", "kind")


# -- joins --------------------------------------------------------------------


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@register("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    """JO1: a pair of names; both key columns stay."""
    joined = joins.join_on(_orders(spark, sf_dir), _customers(spark, sf_dir), [["o_custkey", "c_custkey"]])
    return joined.select("o_orderkey", "o_custkey", "c_custkey", "c_name")


@register(
    """
    SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l
    JOIN (SELECT o_orderkey AS l_orderkey, 'A' AS l_returnflag, o_orderstatus FROM orders) o
      ON l.l_orderkey = o.l_orderkey AND l.l_returnflag = o.l_returnflag
    """
)
def join_shared_names(spark, sf_dir):
    """JO1 JO5: two keys that have the same name on both sides; each comes out once."""
    flagged = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit("A").alias("l_returnflag"), "o_orderstatus"
    )
    joined = joins.join_on(table(spark, sf_dir, "lineitem"), flagged, ["l_orderkey", "l-returnflag"])
    return joined.select("l_orderkey", "l_linenumber", "o_orderstatus")


_NAMED = "(SELECT c_custkey, c_name FROM customer)"


def _named(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", "c_name")


def _ordered(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", "o_custkey")


_ORDERED = "(SELECT o_orderkey, o_custkey FROM orders)"


def _outer(how):
    def run(spark, sf_dir):
        left, right = _ordered(spark, sf_dir), _named(spark, sf_dir)
        joined = joins.join_on(left, right, [["o_custkey", "c_custkey"]], how, tables=("left", "right"))
        text = [F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "c_custkey")]
        return joined.select(*text, "c_name")

    return run


def _outer_sql(how):
    return f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
           CAST(c_custkey AS VARCHAR) AS c_custkey, c_name
    FROM {_ORDERED} {how} JOIN {_NAMED} ON o_custkey = c_custkey
    """


for _how in ("left", "right", "full"):
    _run = _outer(_how)
    _run.__name__ = f"join_{_how}"
    _run.__doc__ = "JO2."
    register(_outer_sql(_how.upper()))(_run)


@register(
    f"""
    SELECT coalesce(o.key, c.key) AS key, CAST(o_orderkey AS VARCHAR) AS o_orderkey, c_name
    FROM (SELECT o_custkey AS key, o_orderkey FROM {_ORDERED}) o
    FULL JOIN (SELECT c_custkey AS key, c_name FROM {_NAMED}) c ON o.key = c.key
    """
)
def join_full_shared(spark, sf_dir):
    """JO2 JO5: full outer join on a shared name; the key comes from whichever side has it."""
    left = _ordered(spark, sf_dir).withColumnRenamed("o_custkey", "key")
    right = _named(spark, sf_dir).withColumnRenamed("c_custkey", "key")
    joined = joins.join_on(left, right, ["key"], "outer", tables=("left", "right"))
    return joined.select("key", F.col("o_orderkey").cast("string").alias("o_orderkey"), "c_name")


@register(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_ORDERED})")
def join_semi(spark, sf_dir):
    """JO3."""
    pair = [["c_custkey", "o_custkey"]]
    joined = joins.join_on(_customers(spark, sf_dir), _ordered(spark, sf_dir), pair, "left_semi")
    return joined.select("c_custkey", "c_name")


@register(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {_ORDERED})")
def join_anti(spark, sf_dir):
    """JO3."""
    pair = [["c_custkey", "o_custkey"]]
    joined = joins.join_on(_customers(spark, sf_dir), _ordered(spark, sf_dir), pair, "left_anti")
    return joined.select("c_custkey", "c_name")


@register(
    """
    SELECT n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name
    """
)
def join_chain(spark, sf_dir):
    """JO6 AG1 AG2: item to order to customer to nation, then totals."""
    joined = joins.join_chain(
        table(spark, sf_dir, "lineitem"),
        (_orders(spark, sf_dir), [["l_orderkey", "o_orderkey"]], "inner"),
        (_customers(spark, sf_dir), [["o_custkey", "c_custkey"]], "inner"),
        (table(spark, sf_dir, "nation"), [["c_nationkey", "n_nationkey"]], "inner"),
    )
    totals = joined.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).alias("amount")
    )
    return totals.select("n_name", "n", number("amount").alias("amount"))


# -- aggregates ---------------------------------------------------------------


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_suppkey",
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
        money("l_extendedprice").alias("PRICE"),
        money("l_quantity").alias("QTY"),
    )


@register(
    """
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS sum_PRICE,
           count(*) AS rows_all, count(l_linenumber) AS count_l_linenumber,
           CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS mean_qty,
           CAST(min(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS low,
           CAST(max(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS high
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """
)
def agg_basic(spark, sf_dir):
    """AG1 AG2 AG3 AG9: sum, count, avg, min, max per group."""
    totals = aggregates.aggregate(
        _items(spark, sf_dir),
        ["l-returnflag", "l_linestatus"],
        [
            {"field": "PRICE", "operation": "sum"},
            {"field": "*", "op": "count", "alias": "rows_all"},
            {"field": "l-linenumber", "op": "count"},
            {"field": "QTY", "op": "sum", "alias": "qty"},
            {"field": "PRICE", "op": "min", "alias": "low"},
            {"field": "PRICE", "op": "max", "alias": "high"},
        ],
    )
    return totals.select(
        "l_returnflag",
        "l_linestatus",
        number("sum_PRICE").alias("sum_PRICE"),
        "rows_all",
        "count_l_linenumber",
        (number("qty") / F.col("rows_all")).alias("mean_qty"),
        number("low").alias("low"),
        number("high").alias("high"),
    )


@register("SELECT l_suppkey, avg(l_linenumber) AS mean_line FROM lineitem GROUP BY l_suppkey")
def agg_avg(spark, sf_dir):
    """AG3: average."""
    return aggregates.aggregate(
        _items(spark, sf_dir), ["l_suppkey"], [{"field": "l_linenumber", "op": "avg", "alias": "mean_line"}]
    )


@register(
    """
    SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(15,2)) ELSE 0 END) AS DOUBLE) AS returned,
           count(*) FILTER (l_returnflag = 'A') AS accepted,
           avg(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS mean_open
    FROM lineitem GROUP BY l_suppkey
    """
)
def agg_conditional(spark, sf_dir):
    """AG4 AG5 AG6: aggregates under a condition, hyphen names included."""
    totals = aggregates.aggregate(
        _items(spark, sf_dir),
        ["l_suppkey"],
        [
            {"field": "PRICE", "op": "add", "alias": "returned", "condition": "l-returnflag = 'R'"},
            {"field": "*", "op": "tallying", "alias": "accepted", "condition": "l_returnflag = 'A'"},
            {"field": "l_linenumber", "op": "avg", "alias": "mean_open", "condition": "l_linestatus = 'O'"},
        ],
    )
    return totals.select("l_suppkey", number("returned").alias("returned"), "accepted", "mean_open")


@register(
    """
    SELECT l_suppkey,
           CAST(min(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(15,2)) END) AS DOUBLE) AS low,
           CAST(max(CASE WHEN l_quantity > 25 THEN CAST(l_extendedprice AS DECIMAL(15,2)) END) AS DOUBLE) AS high
    FROM lineitem GROUP BY l_suppkey
    """
)
def agg_min_max_cond(spark, sf_dir):
    """AG7: min and max under a condition, one of them any SQL test."""
    totals = aggregates.aggregate(
        _items(spark, sf_dir),
        ["l_suppkey"],
        [
            {"field": "PRICE", "op": "min", "alias": "low", "condition": "l_returnflag = 'R'"},
            {"field": "PRICE", "op": "max", "alias": "high", "condition": "QTY > 25"},
        ],
    )
    return totals.select("l_suppkey", number("low").alias("low"), number("high").alias("high"))


@register(
    """
    SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS total,
           max(l_linenumber) AS lines FROM lineitem
    """
)
def agg_global(spark, sf_dir):
    """AG1 AG2: without groups."""
    totals = aggregates.aggregate(
        _items(spark, sf_dir),
        [],
        [
            {"field": "*", "op": "count", "alias": "n"},
            {"field": "PRICE", "op": "sum", "alias": "total"},
            {"field": "l_linenumber", "op": "max", "alias": "lines"},
        ],
    )
    return totals.select("n", number("total").alias("total"), "lines")


@register(
    """
    SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) - CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS NET_AMT,
           CAST(max(l_linenumber) AS BIGINT) AS TOP_LINE
    FROM lineitem GROUP BY l_returnflag
    """
)
def agg_expressions(spark, sf_dir):
    """AG14: output name to SQL aggregate."""
    totals = aggregates.aggregate(
        _items(spark, sf_dir), ["l_returnflag"], {"NET-AMT": "sum(PRICE - QTY)", "TOP-LINE": "max(l-linenumber)"}
    )
    return totals.select(
        "l_returnflag", number("NET_AMT").alias("NET_AMT"), F.col("TOP_LINE").cast("bigint").alias("TOP_LINE")
    )


_TXN = Layout.of(
    [
        FieldSpec("TXN-ID", "long", length=12),
        FieldSpec("ACCT-NO", "long", length=10),
        FieldSpec("TXN-TYPE", length=2),
        FieldSpec("TXN-AMT", "decimal", length=12, precision=2),
    ]
)


def _transactions(spark, sf_dir):
    """Line items delivered as a positional transaction file, and read from it."""
    items = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "DR").when(F.col("l_returnflag") == "A", "CR").otherwise("XX")
    records = items.select(
        F.col("l_orderkey").alias("TXN_ID"),
        F.col("l_suppkey").alias("ACCT_NO"),
        kind.alias("TXN_TYPE"),
        money("l_extendedprice", 12).alias("TXN_AMT"),
    )
    path = scratch_dir(spark, "transactions")
    format_lines(records, _TXN).write.text(path)
    return parse_lines(spark.read.text(path), _TXN, as_types=True)


@register(
    """
    SELECT l_suppkey AS ACCT_NO, CAST(dr AS DOUBLE) AS SUM_TOTAL_DEBIT, CAST(cr AS DOUBLE) AS SUM_TOTAL_CREDIT,
           CAST(cr - dr AS DOUBLE) AS SUM_NET
    FROM (SELECT l_suppkey,
                 sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END) AS dr,
                 sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END) AS cr
          FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY l_suppkey)
    """
)
def debit_credit_net(spark, sf_dir):
    """AG10 SC4 SK4: positional lines, valid types, two conditional sums, net."""
    totals, _ = aggregates.debit_credit(_transactions(spark, sf_dir), ["ACCT-NO"], "TXN-TYPE", "TXN-AMT")
    sums = ("SUM_TOTAL_DEBIT", "SUM_TOTAL_CREDIT", "SUM_NET")
    return totals.select("ACCT_NO", *[number(c).alias(c) for c in sums])


@register(
    """
    SELECT l_suppkey AS ACCT_NO, 'XX' AS TXN_TYPE, count(*) AS n
    FROM lineitem WHERE l_returnflag NOT IN ('R', 'A') GROUP BY l_suppkey
    """
)
def debit_credit_rejects(spark, sf_dir):
    """AG10 FI8: the rejected transactions, counted per account."""
    _, rejected = aggregates.debit_credit(_transactions(spark, sf_dir), ["ACCT-NO"], "TXN-TYPE", "TXN-AMT")
    return rejected.groupBy("ACCT_NO", "TXN_TYPE").agg(F.count(F.lit(1)).alias("n"))


@register(
    """
    SELECT CUST_KEY, CAST(sum(t) AS DOUBLE) AS TOTAL
    FROM (SELECT o_custkey AS CUST_KEY, CAST(o_totalprice AS DECIMAL(14,2)) AS t FROM orders) GROUP BY CUST_KEY
    """
)
def sum_fields(spark, sf_dir):
    """AG11: equal keys become one record, in key order."""
    summed = aggregates.sum_fields(order_records(spark, sf_dir), ["CUST-KEY"], ["TOTAL"])
    return summed.select("CUST_KEY", number("TOTAL").alias("TOTAL"))


@register(
    """
    SELECT (SELECT count(*) FROM customer) AS CUSTOMERS, count(*) AS TRANSACTIONS,
           CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS GRAND_TOTAL, '20260310' AS RUN_DATE
    FROM orders
    """
)
def global_summary(spark, sf_dir):
    """AG12: counters of two data sets in one row."""
    customers = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    totals = order_records(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("TRANSACTIONS"), F.sum("TOTAL").alias("GRAND_TOTAL")
    )
    return totals.select(
        customers.scalar().alias("CUSTOMERS"),
        "TRANSACTIONS",
        number("GRAND_TOTAL").alias("GRAND_TOTAL"),
        F.lit("20260310").alias("RUN_DATE"),
    )


@register("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_step(spark, sf_dir):
    """AG13."""
    return sets.distinct_rows(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


# -- columns ------------------------------------------------------------------


@register("SELECT o_orderpriority AS PRIORITY_CD, o_orderkey AS o_orderkey FROM orders")
def project_columns(spark, sf_dir):
    """PR1 PR15: select and reorder under hyphen names."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "PRIORITY_CD")
    return project.select_step(orders, {"columns": ["PRIORITY-CD", "o-orderkey"]})


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def project_all(spark, sf_dir):
    """PR2: the bare star."""
    return project.select_step(table(spark, sf_dir, "nation"), {"columns": "*"})


@register(
    """
    SELECT o_orderkey, 16 AS WS_N, 'OK' AS WS_CODE, 'two words' AS WS_TEXT, o_orderstatus AS WS_STATUS,
           'as is' AS WS_LIT, 0 AS WS_ZERO FROM orders
    """
)
def move_literals(spark, sf_dir):
    """PR4 PR10: number, bare word, quoted text, column, given literal, initial value."""
    moved = project.compute(
        table(spark, sf_dir, "orders"),
        [
            {"target": "WS-N", "expression": "16", "operation": "move"},
            {"target": "WS-CODE", "expression": "OK"},
            {"target": "WS-TEXT", "expression": "'two words'"},
            {"target": "WS-STATUS", "expression": "o-orderstatus"},
            {"target": "WS-LIT", "literal": True, "value": "as is"},
            {"target": "WS-ZERO", "operation": "initialize"},
        ],
    )
    return moved.select("o_orderkey", "WS_N", "WS_CODE", "WS_TEXT", "WS_STATUS", "WS_LIT", "WS_ZERO")


@register(
    """
    SELECT l_orderkey, l_suppkey, CAST(price AS DOUBLE) AS PRICE, CAST(price + qty + 5 AS DOUBLE) AS WS_SUM,
           CAST(price + qty + 5 + qty AS DOUBLE) AS WS_AGAIN, CAST(-qty AS DOUBLE) AS WS_LESS,
           CAST(price * qty AS DOUBLE) AS WS_PRODUCT
    FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(15,2)) AS price, CAST(l_quantity AS DECIMAL(15,2)) AS qty FROM lineitem)
    """
)
def working_storage(spark, sf_dir):
    """PR5 PR6 PR7: variables that do not exist yet start at 0 or 1; targets feed later steps."""
    rows = project.compute(
        _items(spark, sf_dir),
        [
            {"target": "WS-SUM", "expression": "PRICE + QTY + 5", "operation": "add"},
            {"target": "WS-AGAIN", "expression": "WS-SUM", "operation": "move"},
            {"target": "WS-AGAIN", "expression": "WS-AGAIN + QTY", "operation": "add"},
            {"target": "WS-LESS", "expression": "QTY", "operation": "subtract"},
            {"target": "WS-PRODUCT", "expression": "PRICE * QTY", "operation": "multiply"},
        ],
    )
    shown = ("PRICE", "WS_SUM", "WS_AGAIN", "WS_LESS", "WS_PRODUCT")
    return rows.select("l_orderkey", "l_suppkey", *[number(c).alias(c) for c in shown])


@register(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity - 1, 0) AS RATIO, CAST(0 AS DOUBLE) / l_quantity AS FRESH
    FROM lineitem
    """
)
def divide_zero(spark, sf_dir):
    """PR8: a zero divisor gives NULL, a missing target starts at 0."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        (F.col("l_quantity") - 1).alias("DIVISOR"),
        F.col("l_extendedprice").alias("RATIO"),
    )
    divided = project.compute(
        rows,
        [
            {"target": "RATIO", "expression": "DIVISOR", "operation": "divide"},
            {"target": "FRESH", "expression": "l-quantity", "operation": "divide"},
        ],
    )
    return divided.select("l_orderkey", "l_linenumber", "RATIO", "FRESH")


@register(
    """
    SELECT l_orderkey, l_linenumber, l_suppkey - l_linenumber AS MINUS, l_suppkey * 2 - (l_linenumber + -5) AS MIXED
    FROM lineitem
    """
)
def compute_expr(spark, sf_dir):
    """PR9 PR14: hyphens in names, minus with and without blanks, a negative number."""
    rows = project.compute(
        table(spark, sf_dir, "lineitem"),
        [
            {"target": "MINUS", "expression": "l-suppkey-l-linenumber", "operation": "compute"},
            {"target": "MIXED", "expression": "l_suppkey*2 - (l-linenumber + -5)", "operation": "formula"},
        ],
    )
    return rows.select("l_orderkey", "l_linenumber", "MINUS", "MIXED")


@register(
    """
    SELECT p_partkey, p_brand || '/' || p_type AS LABEL, split_part(p_name, ' ', 1) AS COLOUR,
           substring(p_brand, 1, 5) AS PREFIX, p_name || ' - ' || p_type AS TITLE
    FROM part
    """
)
def string_unstring(spark, sf_dir):
    """PR11 PR12: concatenation with a delimiter or literal operands, first piece, substring."""
    rows = project.compute(
        table(spark, sf_dir, "part"),
        [
            {"target": "LABEL", "expression": "p-brand p-type DELIMITED BY SIZE", "operation": "string", "delimiter": "/"},
            {"target": "COLOUR", "expression": "p-name", "operation": "unstring", "delimiter": " "},
            {"output_field": "PREFIX", "operation": "UNSTRING", "operands": ["p_brand", "0", "5"]},
            {"output_field": "TITLE", "operation": "STRING", "operands": ["p_name", "' - '", "p_type"]},
        ],
    )
    return rows.select("p_partkey", "LABEL", "COLOUR", "PREFIX", "TITLE")


@register(
    """
    SELECT doc_id, length(regexp_replace(text, '[aeiou]+', '_', 'g')) AS n_replaced,
           md5(regexp_replace(text, '[0-9]', '#', 'g')) AS masked,
           CAST(len(regexp_extract_all(text, 'the')) AS INTEGER) AS n_the
    FROM documents
    """
)
def inspect(spark, sf_dir):
    """PR13 PR17: replace a pattern in whole texts, count a pattern."""
    rows = project.compute(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        [
            {"target": "VOWELS", "expression": "text", "operation": "inspect", "before": "[aeiou]+", "after": "_"},
            {"target": "MASKED", "expression": "text", "operation": "inspect", "before": "[0-9]", "after": "#"},
            {"target": "N-THE", "expression": "text", "operation": "inspect", "count": "the"},
        ],
    )
    return rows.select(
        "doc_id",
        F.length("VOWELS").cast("bigint").alias("n_replaced"),
        F.md5("MASKED").alias("masked"),
        F.col("N_THE").alias("n_the"),
    )


@register(
    """
    SELECT l_orderkey, l_linenumber,
           CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2)), 2) AS DOUBLE) AS DISC
    FROM lineitem
    """
)
def rounded(spark, sf_dir):
    """PR18: ROUNDED is half up at the given digits."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", money("l_extendedprice").alias("PRICE"), money("l_discount").alias("RATE")
    )
    product = {"target": "DISC", "expression": "PRICE * RATE", "operation": "compute", "rounded": True, "precision": 2}
    out = project.compute(rows, [product])
    return out.select("l_orderkey", "l_linenumber", number("DISC").alias("DISC"))


@register("SELECT o_orderkey, upper(o_orderpriority) AS LOUD FROM orders")
def with_and_drop(spark, sf_dir):
    """PR16: withColumn and drop."""
    rows = project.with_column(table(spark, sf_dir, "orders"), "LOUD", "upper(o-orderpriority)")
    return project.drop_columns(
        rows, ["o-custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    )


# -- sets ---------------------------------------------------------------------


@register(
    """
    SELECT 'c' AS src, c_custkey AS k, c_name AS name, CAST(NULL AS VARCHAR) AS brand FROM customer
    UNION ALL SELECT 's', s_suppkey, s_name, NULL FROM supplier
    UNION ALL SELECT 'p', p_partkey, NULL, p_brand FROM part
    """
)
def union_three(spark, sf_dir):
    """UN1: by name over all inputs, missing columns NULL."""
    return sets.union_all(
        [
            table(spark, sf_dir, "customer").select(F.lit("c").alias("src"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name")),
            table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("src"), F.col("s_suppkey").alias("k")),
            table(spark, sf_dir, "part").select(F.lit("p").alias("src"), F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand")),
        ]
    )


@register("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct(spark, sf_dir):
    """UN3."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return sets.union_all([orders, customers], distinct=True)


@register("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def merge_sorted(spark, sf_dir):
    """UN2: merge in key order."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return sets.merge_rows([suppliers, customers], ["k"])


@register("SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders")
def sort_multi(spark, sf_dir):
    """SO1 SO2: a direction per key."""
    logic = {"order_by": [{"column": "o_orderstatus", "direction": "asc"}, {"column": "o-totalprice", "direction": "desc"}]}
    return sets.sort_step(table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey"), logic)


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def first_rows(spark, sf_dir):
    """SO3: the first few by key."""
    return sets.first_rows(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 5).select(
        "o_orderkey", "o_totalprice"
    )
