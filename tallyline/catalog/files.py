"""Files in both directions, whole descriptions of every step type, and what is refused."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import functions as F

from tallyline.catalog.data import ORDER_HEADER, ORDER_LAYOUT, ORDER_TRAILER, deliver_orders, money, number, order_records
from tallyline.catalog.registry import RUN_DATE, register, table
from tallyline.errors import ConfigError, GateFailed, MissingInput, UnknownColumn, UnknownOperation
from tallyline.functions.packed import encode_packed, encode_text
from tallyline.operators import gates
from tallyline.operators.aggregates import aggregate
from tallyline.operators.project import select_step
from tallyline.operators.reconcile import reconcile_in_order
from tallyline.plans import checked
from tallyline.plans.flow import Flow
from tallyline.plans.steps import Context
from tallyline.session import scratch_dir
from tallyline.sinks import byte_files, writers
from tallyline.sources import paths, readers, segments, variable
from tallyline.sources.layout import FieldSpec, Layout


@register("SELECT rpad(c_name, 30, '.') AS value FROM customer")
def blank_lines(spark, sf_dir):
    """SC5: line ends of CR LF and lines of blanks only are no data."""
    path = scratch_dir(spark, "lines")
    lines = F.array(F.rpad("c_name", 30, "."), F.lit(""), F.lit("   "))
    table(spark, sf_dir, "customer").select(F.explode(lines).alias("value")).write.option("lineSep", "\r\n").text(path)
    return segments.split(segments.read_lines(spark, path)).data.select("value")


_PACKED = Layout.of(
    [
        FieldSpec("p_name", length=40),
        FieldSpec("price", "decimal", length=7, precision=2, usage="COMP-3"),
        FieldSpec("p_partkey", "long", length=8, usage="COMP"),
    ]
)


@register("SELECT p_partkey, p_name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price FROM part")
def ebcdic_file(spark, sf_dir):
    """SC13 SC14: a file of EBCDIC records, one byte after each that is no field."""
    path = scratch_dir(spark, "ebcdic")
    record = F.concat(
        encode_text(F.rpad("p_name", 40, " ")),
        encode_packed(money("p_retailprice", 12), 7, 2),
        F.unhex(F.lpad(F.hex("p_partkey"), 16, "0")),
    )
    # Text output writes bytes as they are, and its line end is the byte between records.
    table(spark, sf_dir, "part").select(record.cast("string").alias("value")).write.text(path)
    found = readers.read_ebcdic(spark, path, _PACKED, end_offset=1)
    return found.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", number("price").alias("price"))


@register(
    """
    SELECT 'START' AS kind, CAST(0 AS BIGINT) AS total, CAST(1 AS BIGINT) AS n
    UNION ALL SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2)) * 100) AS BIGINT), count(*) FROM orders GROUP BY 1
    UNION ALL SELECT 'END', count(*), CAST(1 AS BIGINT) FROM orders
    """
)
def ebcdic_output(spark, sf_dir):
    """SK16: an EBCDIC output with its header and trailer record, decoded again."""
    path = scratch_dir(spark, "ebcdic")
    layout = Layout.of([FieldSpec("STATUS", length=5), FieldSpec("TOTAL", "decimal", length=15, precision=2)], 20)
    ends = [
        Layout.of([FieldSpec("MARK", length=5, expression=f"'{mark}'"), FieldSpec("N", "long", length=15, expression=n)], 20)
        for mark, n in (("START", "0"), ("END", "count(*)"))
    ]
    writers.write_ebcdic(
        order_records(spark, sf_dir), path, layout, header=ends[0], trailer=ends[1], header_count=1, trailer_count=1
    )
    texts = readers.decode_records(
        spark.read.parquet(path), Layout.of([FieldSpec("KIND", length=5), FieldSpec("NUMBER", length=15)])
    )
    return texts.groupBy(F.trim("KIND").alias("kind")).agg(
        F.sum(F.trim("NUMBER").cast("bigint")).alias("total"), F.count(F.lit(1)).alias("n")
    )


_VARIABLE = Layout.of(
    [
        FieldSpec("price", "decimal", length=7, precision=2, usage="COMP-3"),
        FieldSpec("p_partkey", "long", length=8, usage="COMP"),
        FieldSpec("p_name", length=60),
    ]
)


@register("SELECT p_partkey, trim(p_name) AS p_name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price FROM part")
def ebcdic_variable(spark, sf_dir):
    """SC13 SK16: records of variable length written as bytes and read back in ranges."""
    path = scratch_dir(spark, "variable")
    record = F.concat(
        encode_packed(money("p_retailprice", 12), 7, 2), F.unhex(F.lpad(F.hex("p_partkey"), 16, "0")), encode_text(F.rtrim("p_name"))
    )
    byte_files.write_bytes(table(spark, sf_dir, "part").select(byte_files.with_descriptor(record).alias("record")), path)
    found = variable.read_variable(spark, path, _VARIABLE)
    return found.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", number("price").alias("price"))


_COUNT_FIELDS = [
    {"name": "FILE-ID", "type": "STRING", "start": 1, "length": 8},
    {"name": "REC-COUNT", "type": "LONG", "start": 9, "length": 12},
]


@register(
    """
    SELECT count(*) AS expected, count(*) FILTER (o_orderstatus <> 'P') AS actual,
           count(*) = count(*) FILTER (o_orderstatus <> 'P') AS ok FROM orders
    """
)
def count_file_fields(spark, sf_dir):
    """SC19 SK12 VA18: a count file with declared fields, held against rows of which some are missing."""
    orders = table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "count")
    writers.count_lines(orders, _COUNT_FIELDS).write.text(path)
    expected = readers.read_count_file(spark, path, Layout.of(_COUNT_FIELDS))
    return gates.count_gate(orders.filter(F.col("o_orderstatus") != "P"), expected)


@register(
    """
    WITH e AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderstatus AS status FROM orders),
    g AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS status
          FROM orders)
    SELECT CAST(place AS VARCHAR) AS key, e.status AS expected, g.status AS generated FROM e JOIN g USING (place) WHERE e.status <> g.status
    """
)
def reconcile_by_position(spark, sf_dir):
    """RE4: rows without a key, the n-th with the n-th in a given order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("status"))
    changed = orders.withColumn("status", F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.col("status")))
    found = reconcile_in_order(orders, changed, ["o_orderkey"])
    return found.cells().select("key", "expected", "generated")


def _one_delivery(spark, sf_dir) -> str:
    return f"{deliver_orders(spark, sf_dir, F.lit('20260309'))}/DAILY/20260309/ORDERS.DAT"


@register("SELECT count(*) AS n, count(*) > 1 AS as_announced, false AS inclusive FROM orders")
def trailer_count_by_name(spark, sf_dir):
    """VA16: the count field of a trailer is found by its name; what differs is only told."""
    path = _one_delivery(spark, sf_dir)
    source = readers.read_fixed(spark, path, ORDER_LAYOUT, 1, 1, ORDER_HEADER, ORDER_TRAILER)
    counted = source.data.agg(F.count(F.lit(1)).alias("n"))
    n, node = counted.first().n, {"header_count": 1, "trailer_count": 1}
    told = {basis: checked.warn_of_count(n, {"count_basis": basis}, "orders", node, source.trailer) for basis in ("data", "inclusive")}
    return counted.select("n", F.lit(told["data"]).alias("as_announced"), F.lit(told["inclusive"]).alias("inclusive"))


@register("SELECT o_orderstatus AS STATUS, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def empty_input(spark, sf_dir):
    """SC21: an absent input has its declared schema and no rows, which adds nothing to others."""
    nothing = readers.empty_like(spark, ORDER_LAYOUT)
    orders = order_records(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in nothing.schema])
    rows = nothing.unionByName(orders)
    return rows.groupBy("STATUS").agg(F.count(F.lit(1)).alias("n"), number(F.sum("TOTAL")).alias("total"))


_STEPS = [
    {"id": "TALL", "type": "withColumn", "source_inputs": ["ORDERS"], "logic": {"column": "CENTS", "expression": "cast(o_totalprice * 100 as bigint)"}},
    {"id": "SLIM", "type": "drop", "source_inputs": ["TALL"], "logic": {"columns": ["o_orderdate", "o_orderpriority"]}},
    {"id": "KEYS", "type": "select", "source_inputs": ["SLIM"], "logic": {"columns": ["o_custkey", "o_orderstatus"]}},
    {"id": "NAMES", "type": "select", "source_inputs": ["CUSTOMERS"], "logic": {"expressions": [
        {"target": "o_custkey", "expression": "c_custkey", "operation": "move"},
        {"target": "o_orderstatus", "expression": "'-'"}]}},
    {"id": "BOTH", "type": "union", "source_inputs": ["KEYS", "NAMES"]},
    {"id": "ONCE", "type": "distinct", "source_inputs": ["BOTH"]},
    {"id": "SORTED", "type": "sort", "source_inputs": ["ONCE"], "logic": {"keys": ["o_custkey", "o_orderstatus"]}},
    {"id": "MERGED", "type": "custom", "source_inputs": ["SORTED", "KEYS"], "logic": {"operation": "merge", "on": ["o_custkey"]}},
    {"id": "COUNTS", "type": "ctrl_file", "source_inputs": ["MERGED"], "logic": {"ctrl_file_fields": [
        {"name": "ROWS", "type": "LONG"}, {"name": "STATES", "type": "LONG", "expression": "count(distinct o_orderstatus)"}]}},
]


def _steps_flow(spark, sf_dir) -> Flow:
    inputs = {name: {"format": "parquet", "path": f"{sf_dir}/{name[:-1].lower()}{end}.parquet"} for name, end in (("ORDERS", "s"), ("CUSTOMERS", ""))}
    outputs = {"COUNTS": {"format": "json", "path": scratch_dir(spark, "counts")}}
    return Flow(spark, {"Inputs": inputs, "Outputs": outputs, "Transformations": {"steps": _STEPS}}, RUN_DATE)


_MERGED_SQL = """
  (SELECT DISTINCT o_custkey, o_orderstatus FROM orders UNION ALL SELECT c_custkey, '-' FROM customer UNION ALL
   SELECT o_custkey, o_orderstatus FROM orders)
"""


@register(f"SELECT count(*) AS ROWS, count(DISTINCT o_orderstatus) AS STATES FROM {_MERGED_SQL}")
def flow_step_types(spark, sf_dir):
    """PL2 PR15 PR16 UN1 UN2 UN3 SO1 CT1: withColumn, drop, select, union, distinct, sort, merge and control steps in one description."""
    flow = _steps_flow(spark, sf_dir)
    flow.run()
    return spark.read.json(flow.config["Outputs"]["COUNTS"]["path"]).select("ROWS", "STATES")


@register(f"SELECT o_orderstatus, count(*) AS n, true AS nothing_written FROM {_MERGED_SQL} GROUP BY 1")
def flow_dry_run(spark, sf_dir):
    """PL3: a dry run makes the plans of all steps and writes no output."""
    flow = _steps_flow(spark, sf_dir)
    made = flow.run(dry_run=True, keep=True)["MERGED"]
    nothing = not gates.file_exists(spark, flow.config["Outputs"]["COUNTS"]["path"])
    return made.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("nothing_written", F.lit(nothing))


@register(
    """
    WITH d AS (SELECT strftime(max(o_orderdate), '%Y%m%d') AS day FROM orders)
    SELECT 's3a://bucket/x' AS reader, '/base/cur/i/DAILY/' || day AS curated, '/base/efs/i/DAILY/' || day AS shared,
           '/base/out' AS plain, 'val/i/WEEKLY/' || day AS valid, 'err/i/WEEKLY/' || day AS error
    FROM d
    """
)
def output_paths(spark, sf_dir):
    """SC18 SK17 SK18: paths of outputs, rejected and valid rows on the day of the last order."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("date").alias("day"))
    day = last.first().day
    settings = {
        "curated_bucket_prefix": "cur", "efs_output_prefix": "efs", "validation_bucket_prefix": "val", "error_bucket_prefix": "err",
    }
    node = {"dataset_name": "X", "frequency": "daily"}
    found = {
        "reader": paths.reader_path("s3://bucket/x"),
        "curated": paths.output_path(node, day, "/base", "i", settings),
        "shared": paths.output_path({**node, "target_storage": "EFS"}, day, "/base", "i", settings),
        "plain": paths.output_path({"path": "out"}, day, "/base"),
    }
    checked_paths = paths.validation_paths({"dataset_name": "V", "frequency": "weekly"}, day, "i", settings)
    found |= {k: checked_paths[k] for k in ("valid", "error")}
    return last.select(*[F.lit(v).alias(k) for k, v in found.items()])


def _outcome(action: Callable[[], object]) -> str:
    """What an action that must be refused is refused with."""
    try:
        action()
    except (ConfigError, GateFailed, MissingInput, UnknownColumn, UnknownOperation) as problem:
        return type(problem).__name__
    return "none"


@register(
    """
    SELECT case_name, outcome, n FROM (SELECT count(*) AS n FROM orders),
    (VALUES ('unknown format', 'UnknownOperation'), ('columns and expressions', 'ConfigError'), ('unknown aggregate', 'UnknownOperation'),
            ('no previous file', 'GateFailed'), ('missing input', 'MissingInput'), ('known aggregate', 'none')) AS t(case_name, outcome)
    """
)
def refused(spark, sf_dir):
    """SC15 PR3 AG8 VA21 VA23: what a description cannot ask for, and inputs that are not there."""
    orders = table(spark, sf_dir, "orders")
    flow = lambda node: Flow(spark, {"Inputs": {"A": node}, "Outputs": {}}, RUN_DATE)
    nowhere = scratch_dir(spark, "nowhere")
    context = Context(run_date=RUN_DATE, run_time=datetime(2026, 3, 10))
    logic = {"previous_day_check": True, "last_run_file_path": nowhere, "last_run_file_name": "X.DAT"}
    cases = {
        "unknown format": lambda: flow({"format": "tape", "path": f"{sf_dir}/orders.parquet"}).build(),
        "columns and expressions": lambda: select_step(orders, {"columns": ["o_orderkey"], "expressions": [{"target": "X", "expression": "1"}]}),
        "unknown aggregate": lambda: aggregate(orders, [], [{"field": "o_totalprice", "op": "median"}]),
        "no previous file": lambda: checked.check_previous_file(orders, logic, {"id": "S"}, "A", {}, context),
        "missing input": lambda: flow({"format": "parquet", "path": nowhere}).build(),
        "known aggregate": lambda: aggregate(orders, [], [{"field": "o_totalprice", "op": "max"}]),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("case_name"), F.lit(_outcome(a)).alias("outcome")) for k, a in cases.items()])
    return orders.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(rows).alias("r")).select("r.*", "n")


_TEXTS = ["NaN", "Infinity", "12D", "12f", "1e5", "7.", ".5"]


@register(
    """
    SELECT text, count(*) AS n, text IN ('7.', '.5') AS valid
    FROM (SELECT o_orderkey % 7 AS k FROM orders) JOIN
         (VALUES (0, 'NaN'), (1, 'Infinity'), (2, '12D'), (3, '12f'), (4, '1e5'), (5, '7.'), (6, '.5')) AS t(k2, text) ON k = k2
    GROUP BY text
    """
)
def validate_number_texts(spark, sf_dir):
    """VA2: texts that a cast to double would take for amounts."""
    from tallyline.operators.validate import VALID, annotate

    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.pmod("o_orderkey", F.lit(len(_TEXTS))) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(text.alias("AMOUNT"))
    checked_rows = annotate(rows, [{"field": "AMOUNT", "data_type": "DECIMAL"}])
    return checked_rows.groupBy(F.col("AMOUNT").alias("text"), F.col(VALID).alias("valid")).agg(F.count(F.lit(1)).alias("n"))
