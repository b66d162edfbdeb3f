"""From raw documents to packed training sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontaminate, line_dedup, packing, quality, simhash
from tallyline.llm.common import cut
from tallyline.llm.queries import tokenizer_path, training_labels
from tallyline.session import scratch_dir, tune

KEY = "_key_of_stage"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that the quality classifier keeps."""
    scored = quality.score_quality(_keyed(docs), training_labels(spark, sf_dir), also=(KEY,))
    return _having(docs, scored.filter("kept").select(KEY).distinct(), "left_semi")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; ``n_chars`` follows the text."""
    kept = line_dedup.drop_shared_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints: the smallest id, rows without one last; of
    its rows that differ the one of least hash, and of equal rows one."""
    # A null id sorts first in a struct; here it comes last.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(f"{KEY}.hash").alias("hash"))
    keyed = _keyed(docs).select(order.alias("place"), "text")
    groups = simhash.near_groups(keyed, "place").filter(F.col("id") == F.col("component_id"))
    chosen = groups.groupBy("id").agg(F.count("*").alias("copies"))
    chosen = cut(chosen.select(F.struct(F.col("id.id").alias("id"), F.col("id.hash").alias("hash")).alias(KEY), "copies"), "chosen")
    once = _having(docs, chosen.filter("copies = 1").select(KEY), "left_semi")
    repeated = _having(docs, chosen.filter("copies > 1").select(KEY), "left_semi")
    return once.unionByName(repeated.distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(_keyed(docs), benchmark, KEY)
    return _having(docs, found.select(F.col("id").alias(KEY)).distinct(), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


def _keyed(docs: DataFrame) -> DataFrame:
    """Add what rows are told apart by: an id may repeat, so a hash of all columns goes with it."""
    return docs.withColumn(KEY, _key(docs))


def _key(docs: DataFrame) -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))


def _having(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    named = keys.select(F.col(f"{KEY}.id").alias("_id_of_stage"), F.col(f"{KEY}.hash").alias("_hash_of_stage"))
    key = _key(docs)
    same = key["id"].eqNullSafe(F.col("_id_of_stage")) & (key["hash"] == F.col("_hash_of_stage"))
    return docs.join(named, same, how)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

# Tokenizers, trained classifiers and alignments are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
