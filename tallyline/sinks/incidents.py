"""Findings of failed checks as rows of a table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.errors import UnknownOperation

# Severity codes, and what each kind of incident is rated.
SEVERITY = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
KINDS = {
    "validation": "HIGH",
    "last_run_file_missing": "CRITICAL",
    "input_file_missing": "CRITICAL",
    "prev_day_check_failed": "CRITICAL",
    "record_count_check_failed": "CRITICAL",
}
SAMPLES = 5
SCHEMA = (
    "alert_key string, severity int, flow string, step string, kind string, "
    "expected string, actual string, samples array<string>, at timestamp"
)


def alert_key(flow: str, step: str, kind: str) -> str:
    return f"dataflow.{flow}.{step}.{kind}"


def incident(
    spark: SparkSession,
    flow: str,
    step: str,
    kind: str,
    at: datetime,
    expected: object = None,
    actual: object = None,
    samples: Sequence[str] = (),
    severity: str | None = None,
) -> DataFrame:
    """One incident as a row; at most five samples are kept."""
    if kind not in KINDS:
        raise UnknownOperation(f"incident kind {kind!r}")
    level = (severity or KINDS[kind]).upper()
    if level not in SEVERITY:
        raise UnknownOperation(f"severity {severity!r}")
    text = lambda v: None if v is None else str(v)
    row = (
        alert_key(flow, step, kind),
        SEVERITY[level],
        flow,
        step,
        kind,
        text(expected),
        text(actual),
        list(samples)[:SAMPLES],
        at,
    )
    return spark.createDataFrame([row], SCHEMA)


def validation_incidents(
    rejected: DataFrame, errors: str, flow: str, step: str, order: Sequence[str], at: datetime
) -> DataFrame:
    """The incident of a validated data set as a plan: no row if nothing was rejected.

    Samples are the first messages by ``order``; only five rows per task are kept.
    """
    samples = rejected.orderBy(*order).limit(SAMPLES).agg(F.collect_list(errors).alias("samples"))
    return (
        rejected.agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 0")
        .select(
            F.lit(alert_key(flow, step, "validation")).alias("alert_key"),
            F.lit(SEVERITY["HIGH"]).alias("severity"),
            F.lit(flow).alias("flow"),
            F.lit(step).alias("step"),
            F.lit("validation").alias("kind"),
            F.lit("0").alias("expected"),
            F.col("n").cast("string").alias("actual"),
            samples.scalar().alias("samples"),
            F.lit(at).alias("at"),
        )
    )


def record(rows: DataFrame, path: str) -> None:
    """Append incidents to their table."""
    rows.write.mode("append").parquet(path)
