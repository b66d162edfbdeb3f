"""What several operators share: written cuts, row structs, Arrow batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import scratch_dir

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cut(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and safe from lost executors."""
    spark = frame.sparkSession
    path = scratch_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: few rows and few bytes to an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def row_struct(frame: DataFrame, name: str = "row") -> Column:
    """All columns of a frame as one, so that no extra column can clash with a working one."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias(name)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does the same on texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
