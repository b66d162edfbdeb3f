"""What a validate step does when the flow runs: gates, rejected rows, valid rows, control file."""

from __future__ import annotations

import logging
from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyline.errors import ConfigError, GateFailed, InvalidRows
from tallyline.functions.dates import previous_business_day
from tallyline.functions.naming import quoted
from tallyline.operators import gates
from tallyline.operators.validate import ERRORS, VALID, annotate, fail_mode
from tallyline.plans.steps import Context, step_alias
from tallyline.session import scratch_dir
from tallyline.sinks import incidents, writers
from tallyline.sources import paths, segments
from tallyline.sources.layout import Layout, positions_continued
from tallyline.sources.readers import COUNT_WORDS, RAW


LOG = logging.getLogger(__name__)
_AT = "_at_"


def report(spark, context: Context, step: str, kind: str, **what) -> None:
    """Append an incident if the run has a table for them."""
    if context.incidents:
        row = incidents.incident(spark, context.flow, step, kind, context.run_time, **what)
        incidents.record(row, context.incidents)


def run_validate(
    df: DataFrame, columns: list[str], logic: dict, step: dict, context: Context, in_order: bool = False
) -> DataFrame:
    """A validate step with all it has to do; returns what it hands on, in the given columns.

    The rows are read and checked once: annotated rows go to a table in the shared folder,
    counted by the same write, and every file of the step and the steps after it are made
    from that table. Rows that came in a sorted order (``in_order``) are sorted by it again when they are read.
    """
    found = [context.input_node(n) for n in step.get("source_inputs") or []]
    name, node = next((f for f in found if f), ("", {}))
    label, mode = step_alias(step), fail_mode(logic.get("fail_mode") or logic.get("mode"))
    if logic.get("previous_day_check") or logic.get("last_run_check"):
        check_previous_file(df, logic, step, name, node, context)

    seen = Observation()
    counters = [F.count(F.lit(1)).alias("total"), F.count_if(~F.col(VALID)).alias("invalid")]
    annotated = annotate(df, logic.get("rules") or [], logic.get("on_missing", "raise"))
    if in_order:
        annotated = annotated.withColumn(_AT, F.monotonically_increasing_id())
    path = scratch_dir(df.sparkSession, "checked")
    annotated.observe(seen, *counters).write.partitionBy(VALID).parquet(path)
    annotated = df.sparkSession.read.schema(annotated.schema).parquet(path)
    if in_order:
        annotated = annotated.orderBy(_AT).drop(_AT)
    counts = seen.get

    if logic.get("record_count_check") and logic.get("record_count_trailer_field"):
        check_record_count(df.sparkSession, counts["total"], logic, label, name, node, context)
    elif name in context.sources:
        warn_of_count(counts["total"], logic, label, node, context.sources[name].trailer)
    write_checked(annotated, counts["invalid"], logic, label, name, node, context)
    if mode == "FLAG":
        return annotated.select(*columns, ERRORS, VALID)
    rows = annotated.filter(F.col(VALID)) if mode == "DROP" else annotated
    return rows.select(*columns)


def check_previous_file(df, logic, step, name, node, context) -> None:
    """The last delivery must exist and, if a header field is named, carry its own date."""
    spark, label = df.sparkSession, step_alias(step)
    holidays = context.settings.get("usa_holidays")
    day = previous_business_day(context.run_date, holidays)
    folder = paths.text_of(logic, "last_run_file_path") or paths.text_of(logic, "previous_day_file_path")
    file = paths.text_of(logic, "last_run_file_name")
    delivered = paths.text_of(node, "dataset_name") or paths.text_of(node, "source_file_name")
    if logic.get("previous_day_check"):
        # This form names the output of a previous run; what must exist is the previous input.
        file = file or delivered
    file = file or paths.text_of(logic, "previous_day_file_name") or delivered
    frequency = paths.text_of(logic, "last_run_frequency") or paths.text_of(logic, "previous_day_frequency")
    partition = paths.text_of(logic, "partition_column")
    if folder:
        when = partition or f"{day:%Y%m%d}"
        path = paths.dated(folder, file, frequency, when, context.run_date)
    else:
        path = paths.input_path_on(node, day, None, context.interface, context.settings)
    path = paths.reader_path(path)
    if not gates.file_exists(spark, path):
        report(spark, context, label, "last_run_file_missing", expected=path, actual="FILE_MISSING")
        raise GateFailed(f"{label}: no previous file at {path}")
    field = paths.text_of(logic, "previous_day_header_date_field")
    if field:
        check_header_date(spark, path, node, field, label, context)


def check_header_date(spark, path: str, node: dict, field: str, label: str, context: Context) -> None:
    """Compare the header date of a previous delivery with the previous business day."""
    layout = Layout.of(
        node.get("header_fields") or [],
        int(node.get("record_length") or 0),
        continued=positions_continued(node, "header_fields"),
    )
    spec = next((f for f in layout if f.name == field or f.column == field.replace("-", "_")), None)
    if spec is None:
        raise ConfigError(f"{label}: {field!r} is no header field")
    lines = segments.split(segments.read_lines(spark, path), int(node.get("header_count") or 1), 0)
    gate = gates.header_date_gate(
        lines.header_fields(layout),
        spec.column,
        context.run_date,
        context.settings.get("usa_holidays"),
        spec.format or "yyyyMMdd",
    )
    found = gate.agg(
        F.count(F.lit(1)).alias("headers"),
        F.count_if(~F.col("ok")).alias("bad"),
        F.min(F.when(~F.col("ok"), F.concat_ws(":", "status", "actual"))).alias("actual"),
        F.min("expected").alias("expected"),
    ).first()
    if found.bad or not found.headers:
        actual = found.actual if found.bad else "EMPTY_FILE"
        report(spark, context, label, "prev_day_check_failed", expected=found.expected, actual=actual)
        raise GateFailed(f"{label}: header date of {path}: expected {found.expected}, found {actual}")


def check_record_count(spark, actual: int, logic, label, name, node, context) -> None:
    """The trailer's record count against the rows read."""
    source = context.sources.get(name)
    if source is None or source.trailer is None:
        raise ConfigError(f"{label}: input {name!r} has no trailer fields")
    announced = gates.trailer_count(
        source.trailer,
        logic["record_count_trailer_field"],
        logic.get("count_basis") or "inclusive",
        int(node.get("header_count") or 0),
        int(node.get("trailer_count") or 0),
    )
    expected = gates.announced_total(announced).first().expected
    if expected != actual:
        report(spark, context, label, "record_count_check_failed", expected=expected, actual=actual)
        raise GateFailed(f"{label}: trailer announces {expected} rows, read {actual}")


def warn_of_count(actual: int, logic, label, node, trailer: DataFrame | None) -> bool | None:
    """Compare with the trailer field that is named like a count, if there is one; a difference is only logged."""
    field = next((c for c in trailer.columns if any(w in c.lower() for w in COUNT_WORDS)), None) if trailer is not None else None
    if field is None:
        return None
    lines = [int(node.get(key) or 0) for key in ("header_count", "trailer_count")]
    announced = gates.trailer_count(trailer, field, logic.get("count_basis") or "inclusive", *lines)
    expected = gates.announced_total(announced).first().expected
    if expected != actual:
        LOG.warning("%s: trailer field %s announces %s rows, read %s", label, field, expected, actual)
    return expected == actual


def write_checked(annotated: DataFrame, invalid: int, logic, label, name, node, context) -> None:
    """Rejected rows first; then, unless they end the run, valid rows and the control file."""
    where = paths.validation_paths(logic, context.run_date, context.interface, context.settings)
    layout = None
    if node.get("fields") and str(node.get("format") or "").lower() == "fixed":
        layout = Layout.of(
            node["fields"], int(node.get("record_length") or 0), continued=positions_continued(node, "fields")
        )
    if invalid:
        rejected = annotated.filter(~F.col(VALID))
        if where["error"]:
            _write_rows(rejected, where["error"], where["error_name"], layout)
        # The first messages in their own order, so that every run shows the same.
        samples = [r[0] for r in rejected.select(ERRORS).orderBy(ERRORS).limit(incidents.SAMPLES).collect()]
        report(annotated.sparkSession, context, label, "validation", expected=0, actual=invalid, samples=samples)
        if logic.get("abort_on_invalid", True):
            raise InvalidRows(label, invalid, samples)

    valid = annotated.filter(F.col(VALID)).drop(ERRORS, VALID)
    if where["valid"]:
        _write_rows(valid, where["valid"], where["valid_name"], layout)
    if logic.get("ctrl_file_create") and logic.get("ctrl_file_fields"):
        folder = paths.text_of(logic, "ctrl_output_path") or where["valid"]
        if not folder:
            raise ConfigError(f"{label}: no folder for the control file")
        writers.write_control(
            valid,
            paths.reader_path(folder),
            paths.text_of(logic, "ctrl_file_name"),
            logic["ctrl_file_fields"],
            context.header_of([name]),
            bool(logic.get("ctrl_include_header")),
            context.run_date,
        )


def _write_rows(df: DataFrame, folder: str, name: str, layout: Layout | None) -> None:
    """Rows in the layout of their input, else delimited under a name, else appended as Parquet."""
    folder = paths.reader_path(folder)
    kept = {c for c in df.columns if c.startswith(RAW)}
    if name and layout is not None:
        # Decimals go out as the text they came in with, whatever it was.
        text = [replace(f, type="string", just_right=False) if RAW + f.column in kept else f for f in layout]
        source = {c: RAW + c if RAW + c in kept else c for c in df.columns if c not in kept}
        shown = df.select(*[F.col(quoted(s)).alias(c) for c, s in source.items()])
        written = replace(layout, fields=tuple(text))
        writers.write_fixed(shown, paths.join(folder, name), written, on_overflow="truncate")
    elif name:
        writers.write_delimited(df.drop(*kept), paths.join(folder, name), "|")
    else:
        writers.write_parquet(df.drop(*kept), folder, "append")
