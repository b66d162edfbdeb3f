"""Whole descriptions: read, check, transform, write; what was written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.data import DELIVERIES, ORDER_HEADER, ORDER_LAYOUT, ORDER_TRAILER, deliver_orders, number
from tallyline.catalog.registry import register
from tallyline.plans.flow import Flow
from tallyline.session import scratch_dir
from tallyline.sources.layout import Layout
from tallyline.sources.segments import read_lines


def _entries(layout: Layout, shift: int = 0) -> list[dict]:
    return [
        {
            "name": f.name,
            "type": f.type.upper(),
            "start": f.start + shift,
            "length": f.length,
            "precision": f.precision,
            "format": f.format,
            "expression": f.expression,
        }
        for f in layout
    ]


def _describe(sf_dir: str, base: str, out: str) -> dict:
    """All orders in one delivery: checked, large ones totalled per customer, named."""
    return {
        "Inputs": {
            "ORDERS": {
                "name": "ORDERS",
                "format": "FIXED",
                "source_path": base,
                "source_file_name": "ORDERS.DAT",
                "frequency": "DAILY",
                "record_length": 60,
                "header_count": 1,
                "trailer_count": 1,
                # Positions run on through the record groups: data from 61, trailer from 121.
                "fields": _entries(ORDER_LAYOUT, 60),
                "header_fields": _entries(ORDER_HEADER),
                "trailer_fields": _entries(ORDER_TRAILER, 120),
            },
            "CUSTOMERS": {"format": "parquet", "path": f"{sf_dir}/customer.parquet"},
        },
        "Transformations": {
            "steps": [
                {
                    "id": "NAMED",
                    "type": "join",
                    "source_inputs": ["SUMS", "CUSTOMERS"],
                    "logic": {"left": "SUMS", "right": "CUSTOMERS", "on": [["CUST-NUM", "c-custkey"]]},
                },
                {
                    "id": "CHECKED",
                    "type": "validate",
                    "source_inputs": ["ORDERS"],
                    "logic": {
                        "fail_mode": "DROP",
                        "abort_on_invalid": False,
                        "rules": [
                            {"field": "ORDER-KEY", "data_type": "NUMBER", "nullable": False},
                            {"field": "ORDER-DATE", "data_type": "DATE", "date_format": "YYYYMMDD"},
                            {"field": "PRIORITY", "data_type": "TEXT", "format": "REGEX", "pattern": "^[1-4]"},
                        ],
                        "record_count_check": True,
                        "record_count_trailer_field": "REC-COUNT",
                        "count_basis": "data",
                        "validated_path": f"{out}/valid",
                        "error_path": f"{out}/error",
                        "error_dataset_name": "REJECTED.DAT",
                        "ctrl_file_create": True,
                        "ctrl_file_name": "ORDERS.CTL",
                        "ctrl_file_fields": [
                            {"name": "RECORDS", "type": "LONG", "length": 10},
                            {"name": "DAY", "length": 8, "expression": "to_date(first(FILE-DATE),'yyyyMMdd')"},
                            {"name": "SOURCE", "length": 10, "expression": "'ORDERS'", "just_right": True},
                        ],
                    },
                },
                {
                    "id": "LARGE",
                    "type": "filter",
                    "source_inputs": ["CHECKED"],
                    "logic": {"conditions": [{"field": "TOTAL", "operation": ">", "value": 250000}]},
                },
                {
                    "id": "SUMS",
                    "type": "aggregate",
                    "source_inputs": ["LARGE"],
                    "logic": {
                        "group_by": ["CUST-KEY"],
                        "aggregations": [
                            {"field": "TOTAL", "operation": "sum", "alias": "SUM_TOTAL"},
                            {"field": "*", "operation": "count", "alias": "N_ORDERS"},
                            {"field": "CUST-KEY", "operation": "max", "alias": "CUST_NUM"},
                        ],
                    },
                },
            ]
        },
        "Outputs": {
            "TOTALS": {"format": "parquet", "path": f"{out}/totals", "source_inputs": ["NAMED"],
                       "output_columns": ["CUST-KEY", "c-name", "SUM-TOTAL", "N-ORDERS"]},
            "CHECKED-FILE": {
                "format": "fixed",
                "path": f"{out}/checked",
                "target_file_name": "CHECKED",
                "source_inputs": ["CHECKED"],
                "record_length": 40,
                "header_count": 1,
                "trailer_count": 1,
                "fields": [
                    {"name": "OUT-ORDER-KEY", "type": "LONG", "length": 12},
                    {"name": "OUT-TOTAL", "type": "DECIMAL", "length": 14, "precision": 2},
                    {"name": "OUT-PRIORITY", "type": "STRING", "length": 14},
                ],
                "header_fields": [{"name": "A", "length": 6, "expression": "'START'"}],
                "trailer_fields": [
                    {"name": "B", "length": 4, "expression": "'END'"},
                    {"name": "N", "type": "LONG", "length": 10, "expression": "count(*)"},
                ],
            },
        },
    }


def _run(spark, sf_dir, *outputs: str) -> str:
    """Run the description with some of its outputs; returns the folder they lie in."""
    base, out = deliver_orders(spark, sf_dir, F.lit("20260304")), scratch_dir(spark, "flow")
    config = _describe(sf_dir, base, out)
    config["Outputs"] = {name: config["Outputs"][name] for name in outputs}
    Flow(spark, config, DELIVERIES["F"], name="orders").run()
    return out


_DELIVERED = """
  SELECT *, CAST(o_totalprice AS DECIMAL(14,2)) AS total FROM orders
"""


@register(
    f"""
    SELECT CAST(o_custkey AS VARCHAR) AS CUST_KEY, c_name, CAST(sum(total) AS DOUBLE) AS SUM_TOTAL, count(*) AS N_ORDERS
    FROM ({_DELIVERED}) JOIN customer ON o_custkey = c_custkey
    WHERE regexp_matches(o_orderpriority, '^[1-4]') AND total > 250000
    GROUP BY o_custkey, c_name
    """
)
def order_flow(spark, sf_dir):
    """PL1-PL6 SC9 VA12 VA17 SK1 SK9: one description end to end; steps listed out of order."""
    out = _run(spark, sf_dir, "TOTALS")
    rows = spark.read.parquet(f"{out}/totals")
    return rows.select(
        "CUST-KEY", F.col("c-name").alias("c_name"), number("SUM-TOTAL").alias("SUM_TOTAL"), F.col("N-ORDERS").alias("N_ORDERS")
    ).withColumnRenamed("CUST-KEY", "CUST_KEY")


@register(
    f"""
    SELECT 'D' || lpad(CAST(o_orderkey AS VARCHAR), 10, ' ') || lpad(CAST(o_custkey AS VARCHAR), 10, ' ')
           || o_orderstatus || lpad(CAST(CAST(total * 100 AS BIGINT) AS VARCHAR), 14, '0')
           || strftime(o_orderdate, '%Y%m%d') || rpad(o_orderpriority, 15, ' ') || ' ' AS value
    FROM ({_DELIVERED}) WHERE NOT regexp_matches(o_orderpriority, '^[1-4]')
    """
)
def rejected_file(spark, sf_dir):
    """SK11 VA12: rejected rows in the layout of their input."""
    out = _run(spark, sf_dir)
    return read_lines(spark, f"{out}/error/REJECTED.DAT").select("value")


@register(
    f"""
    WITH kept AS (SELECT * FROM ({_DELIVERED}) WHERE regexp_matches(o_orderpriority, '^[1-4]'))
    SELECT rpad('START', 40, ' ') AS value
    UNION ALL SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, ' ') || lpad(CAST(CAST(total * 100 AS BIGINT) AS VARCHAR), 14, '0')
                     || rpad(o_orderpriority, 14, ' ') FROM kept
    UNION ALL SELECT rpad('END ' || lpad(CAST(count(*) AS VARCHAR), 10, ' '), 40, ' ') FROM kept
    """
)
def checked_file(spark, sf_dir):
    """SK4-SK10: a positional output between its header and trailer record, columns found by name tails."""
    out = _run(spark, sf_dir, "CHECKED-FILE")
    return read_lines(spark, f"{out}/checked/CHECKED.DAT").select("value")


@register(
    f"""
    SELECT lpad(CAST(count(*) AS VARCHAR), 10, '0') || '20260304' || '    ORDERS' AS value
    FROM ({_DELIVERED}) WHERE regexp_matches(o_orderpriority, '^[1-4]')
    """
)
def control_beside_output(spark, sf_dir):
    """SK13 CT2 CT5: the control file written beside the curated output."""
    out = _run(spark, sf_dir, "CHECKED-FILE")
    return read_lines(spark, f"{out}/checked/ORDERS.CTL").select("value")


class _Lost(Exception):
    """Stands for a driver that went away between two steps."""


@register(
    """
    WITH sums AS (
      SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS total, count(*) AS n FROM orders GROUP BY o_custkey),
    named AS (SELECT c_nationkey, total, n FROM sums JOIN customer ON o_custkey = c_custkey)
    SELECT n_name, CAST(sum(total) AS DOUBLE) AS TOTAL, CAST(sum(n) AS BIGINT) AS ORDERS, 2 AS steps_made_again
    FROM named JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
    """
)
def flow_resumed(spark, sf_dir):
    """PL3: a run that ended after two of four steps goes on with the third; its rows are those of an unbroken run."""
    base = scratch_dir(spark, "resumed")
    table = lambda name: {"format": "parquet", "path": f"{sf_dir}/{name}.parquet"}
    total = lambda field, alias: {"field": field, "operation": "sum", "alias": alias}
    config = {
        "Inputs": {"ORDERS": table("orders"), "CUSTOMERS": table("customer"), "NATIONS": table("nation")},
        "Transformations": {
            "steps": [
                {"id": "SUMS", "type": "aggregate", "source_inputs": ["MONEY"],
                 "logic": {"group_by": ["o_custkey"], "aggregations": [
                     total("TOTAL", "TOTAL"), {"field": "*", "operation": "count", "alias": "N"}]}},
                {"id": "MONEY", "type": "withcolumn", "source_inputs": ["ORDERS"],
                 "logic": {"column": "TOTAL", "expression": "cast(o_totalprice as decimal(14,2))"}},
                {"id": "NAMED", "type": "join",
                 "logic": {"left": "SUMS", "right": "CUSTOMERS", "on": [["o_custkey", "c_custkey"]]}},
                {"id": "PLACED", "type": "join",
                 "logic": {"left": "NAMED", "right": "NATIONS", "on": [["c_nationkey", "n_nationkey"]]}},
                {"id": "NATIONAL", "type": "aggregate", "source_inputs": ["PLACED"],
                 "logic": {"group_by": ["n_name"], "aggregations": [total("TOTAL", "TOTAL"), total("N", "ORDERS")]}},
            ]
        },
        "Outputs": {"NATIONAL": {"format": "parquet", "path": f"{base}/out"}},
    }

    class Watched(Flow):
        """Tells which kept steps it made, and ends before one of them if told to."""

        made_now: list[str]

        def _do(self, step):
            if step["id"] == self.ends_before:
                raise _Lost(step["id"])
            self.made_now.append(step["id"])
            return super()._do(step)

    def attempt(ends_before: str) -> list[str]:
        flow = Watched(spark, config, DELIVERIES["F"], name="national")
        flow.made_now, flow.ends_before = [], ends_before
        try:
            flow.run(journal=f"{base}/journal")
        except _Lost:
            pass
        return [s for s in flow.made_now if s != "MONEY"]

    attempt("PLACED")
    again = attempt("")
    rows = spark.read.parquet(f"{base}/out")
    return rows.select("n_name", number("TOTAL").alias("TOTAL"), "ORDERS", F.lit(len(again)).alias("steps_made_again"))
