"""Reconciliation without a key, with repeated keys, with unknown keys and unknown column names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.data import money
from tallyline.catalog.registry import register, table
from tallyline.operators import discover
from tallyline.operators.align import align_in_order
from tallyline.operators.reconcile import reconcile
from tallyline.session import staged

_COLUMNS = ("o_custkey", "o_orderstatus", "price", "o_orderpriority")


def _ordered(spark, sf_dir):
    """Orders as records that follow each other."""
    orders = table(spark, sf_dir, "orders").withColumn("price", money("o_totalprice", 14))
    return orders.select("o_orderkey", F.lit(0).alias("turn"), *_COLUMNS)


def _edited(spark, sf_dir):
    """The same with records missing, added and changed here and there."""
    orders = _ordered(spark, sf_dir)
    new = {"o_custkey": F.lit(-1), "o_orderstatus": F.lit("N"), "price": F.lit("0.01").cast("decimal(14,2)"), "o_orderpriority": F.lit("NEW")}
    added = orders.filter(F.col("o_orderkey") % 991 == 5).select(
        "o_orderkey", F.lit(1).alias("turn"), *[new[c].cast(orders.schema[c].dataType).alias(c) for c in _COLUMNS]
    )
    status = F.when(F.col("o_orderkey") % 983 == 7, "X").otherwise(F.col("o_orderstatus"))
    kept = orders.filter(F.col("o_orderkey") % 997 != 3).withColumn("o_orderstatus", status)
    return kept.unionByName(added)


_EDITS = """
WITH e AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS expected_at FROM orders
), made AS (
  SELECT o_orderkey, 0 AS turn FROM orders WHERE o_orderkey % 997 <> 3 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 991 = 5
), g AS (
  SELECT *, row_number() OVER (ORDER BY o_orderkey, turn) AS generated_at FROM made
), p AS (
  SELECT e.o_orderkey, expected_at, generated_at FROM e LEFT JOIN g ON e.o_orderkey = g.o_orderkey AND turn = 0
)
"""


@register(
    f"""
    {_EDITS}
    SELECT 'only_in_expected' AS type, expected_at, NULL AS generated_at FROM p WHERE generated_at IS NULL
    UNION ALL SELECT 'only_in_generated', NULL, generated_at FROM g WHERE turn = 1
    UNION ALL SELECT 'cells', expected_at, generated_at FROM p WHERE generated_at IS NOT NULL AND o_orderkey % 983 = 7
    """
)
def reconcile_aligned(spark, sf_dir):
    """RE4: records without a key, past missing and added ones."""
    found = align_in_order(_ordered(spark, sf_dir), _edited(spark, sf_dir), ["o_orderkey", "turn"], ignore=["o_orderkey", "turn"])
    return found.differences().select("type", "expected_at", "generated_at")


@register(
    f"""
    {_EDITS}
    SELECT count(*) FILTER (generated_at IS NOT NULL AND o_orderkey % 983 <> 7) AS matched,
           count(*) FILTER (generated_at IS NOT NULL AND o_orderkey % 983 = 7) AS differing,
           count(*) FILTER (generated_at IS NULL) AS only_in_expected, (SELECT count(*) FROM g WHERE turn = 1) AS only_in_generated,
           'FAIL' AS verdict
    FROM p
    """
)
def reconcile_aligned_summary(spark, sf_dir):
    """RE4 RE6: totals of an alignment."""
    found = align_in_order(_ordered(spark, sf_dir), _edited(spark, sf_dir), ["o_orderkey", "turn"], ignore=["o_orderkey", "turn"])
    return found.summary()


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", money("l_extendedprice", 14).alias("price"), "l_returnflag", "l_shipdate", "l_linenumber"
    )


def _changed_lines(spark, sf_dir):
    first, third = F.col("l_linenumber") == 1, F.col("l_linenumber") == 3
    return (
        _lines(spark, sf_dir)
        .withColumn("l_returnflag", F.when(first, "X").otherwise(F.col("l_returnflag")))
        .withColumn("price", F.when(third, F.col("price") + F.lit("0.01").cast("decimal(14,2)")).otherwise(F.col("price")))
    )


_CHANGED_LINES = """
WITH l AS (SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS price FROM lineitem),
cells AS (
  SELECT l_orderkey, l_linenumber, 'l_returnflag' AS col, l_returnflag AS expected, 'X' AS generated FROM l WHERE l_linenumber = 1
  UNION ALL
  SELECT l_orderkey, l_linenumber, 'price', rtrim(rtrim(CAST(price AS VARCHAR), '0'), '.'),
         rtrim(rtrim(CAST(CAST(price + 0.01 AS DECIMAL(14,2)) AS VARCHAR), '0'), '.') FROM l WHERE l_linenumber = 3
)
"""


@register(f"{_CHANGED_LINES} SELECT CAST(l_orderkey AS VARCHAR) AS key, col, expected, generated, count(*) AS copies FROM cells GROUP BY ALL")
def reconcile_closest(spark, sf_dir):
    """RE4 RE5: lines of an order are paired with the lines they differ from in the fewest cells."""
    e, g = (lines(spark, sf_dir).drop("l_linenumber") for lines in (_lines, _changed_lines))
    cells = reconcile(e, g, ["l_orderkey"]).cells(closest=True)
    return cells.groupBy("key", "col", "expected", "generated").agg(F.sum("copies").alias("copies"))


@register(
    """
    WITH t AS (SELECT l_partkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT 'l_partkey,l_returnflag,l_linestatus' AS key_columns, l_partkey || '|' || l_returnflag || '|' || l_linestatus AS key, 'n' AS col,
           CAST(n AS VARCHAR) AS expected, CAST(n + 1 AS VARCHAR) AS generated
    FROM t WHERE l_returnflag = 'N' AND l_linestatus = 'O'
    """
)
def reconcile_found_key(spark, sf_dir):
    """RE3: a key of several columns is found, and rows are paired by it."""
    expected = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("last_line")
    )
    open_ = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    key = discover.find_key(staged(expected, "totals"))
    cells = reconcile(expected, expected.withColumn("n", F.col("n") + open_.cast("int")), key).cells()
    return cells.select(F.lit(",".join(key)).alias("key_columns"), "key", "col", "expected", "generated")


_RENAMED = {"c_custkey": "kunde", "c_name": "bezeichnung", "c_nationkey": "land", "c_acctbal": "saldo", "c_mktsegment": "markt"}


@register(
    "\n    UNION ALL ".join(f"SELECT '{e}' AS expected, '{g}' AS generated, count(DISTINCT {e}) AS n_values FROM customer" for e, g in _RENAMED.items())
)
def reconcile_renamed(spark, sf_dir):
    """RE2: columns of other names are matched by their values."""
    expected = table(spark, sf_dir, "customer").select(*_RENAMED)
    produced = expected.select(*[F.col(e).alias(g) for e, g in reversed(_RENAMED.items())])
    return discover.matches_of(produced, discover.match_by_content(expected, produced))
