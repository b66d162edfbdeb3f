"""Session settings, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallyline.errors import ConfigError

# Runtime settings the plans of this package rely on. AQE splits skewed join
# partitions even where that costs one more shuffle downstream.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # The EBCDIC code pages are outside the short list decode() accepts by default.
    "spark.sql.legacy.javaCharsets": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    pin_split_planning(spark)
    return spark


def build_session(app: str = "tallyline", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; cluster sizing stays with the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PLAN_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def pin_split_planning(spark: SparkSession) -> None:
    """Fix the number the file-split size is derived from.

    Left unset it is the number of cores seen at planning time, which changes
    when executors come and go. Two scans of the same files must cut them into
    the same splits for their line ids to agree (see ``sources.segments``).
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int, target: int = 256 << 20) -> Iterator[int]:
    """Shuffle partitions for an amount of data, for the jobs started inside; yields their number.

    AQE merges partitions that turn out small, but never splits an even plan
    that started with too few. The session gets its own setting back at the end.
    """
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, -(-input_bytes // target))
    spark.conf.set(key, str(partitions))
    try:
        yield partitions
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


# Scratch folders handed out inside a ``scratch_scope``, innermost last.
_scopes: list[list[str]] = []


def _scratch_root(spark: SparkSession) -> str:
    """One folder per application below ``spark.checkpoint.dir``, else below the warehouse.

    Executors on other machines have to reach it, so a warehouse in a local folder, as it is where
    nothing is set, only serves a session that runs on one machine. The file system deletes the folder when the application ends.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        parent = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        if not spark.sparkContext._jsc.sc().isLocal() and file_system(spark, parent)[0].getScheme() == "file":
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{parent.rstrip('/')}/tallyline-{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, reachable from all executors."""
    root = _scratch_root(spark)
    fs, target = file_system(spark, root)
    if not fs.exists(target):
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: evaluated once, of a size Spark knows."""
    path = scratch_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside; frames that read them end with it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            fs, target = file_system(spark, path)
            fs.delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames made from them end with it."""
    fs, target = file_system(spark, _scratch_root(spark))
    fs.delete(target, True)
