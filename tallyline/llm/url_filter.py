"""Judge urls by pattern rules that are found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import ascii_lower, row_struct

ALLOW, BLOCK = "allow", "block"
# A rule list is held by the driver; up to this many entries its index goes to every executor.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """A regular expression over host and path, searched in ``host + path``.

    ``literals``: tokens (maximal runs of A-Z, a-z, 0-9) that every fitting url
    has; none means that each url has to be tried. Of the rules that fit,
    the one of the highest ``weight`` decides, of equal ones the later.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    weight: int
    listed: bool = True


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains if the path starts with ``path``; longer rules win."""
    text = host + path
    whole = [m.group() for m in re.finditer(r"[A-Za-z0-9]+", text) if m.end() < len(text)]
    return Rule(text, verdict, r"^(?:[^/]*\.)?" + re.escape(text), tuple(whole), len(text))


def word_rule(verdict: str, words: str) -> Rule:
    """Fits hosts that hold the words, joined by hyphens, as a label; yields to every prefix rule."""
    pattern = r"^(?:[^/]*\.)?" + re.escape(words) + r"\.[^/]*(?:/|$)"
    return Rule(words, verdict, pattern, tuple(re.findall(r"[A-Za-z0-9]+", words)), 0, listed=False)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = url.isNull()
    return F.when(none, "").otherwise(ascii_lower(host)), F.when(none, "").otherwise(path)


def _local(spark: SparkSession, rows: list[tuple], types: dict[str, pa.DataType]) -> DataFrame:
    """A small table whose size the optimiser knows."""
    columns = list(zip(*rows)) or [()] * len(types)
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(types.items(), columns)}))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """Return ``row`` (the input row), ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` names the listed rule that decided; a rule that is not listed, or
    none, leaves it null. Where no rule fits the verdict is ``default``. Null or malformed
    urls have an empty host and path, which only rules without literals can fit.
    Every row gets its own result, repeated ones too; an empty table gives none.

    How often each literal occurs is counted over all urls, and each rule is filed
    under its rarest one. Tokens of the urls then meet that index, and
    only rules found there run their expression. One shuffle, of a row a url, since the
    best rule of a url is reduced where its tokens were exploded. The index has a
    row a rule and is broadcast up to ``BROADCAST_RULES`` rules; beyond, Spark chooses the join.
    """
    spark = pages.sparkSession
    ordered = sorted(enumerate(rules), key=lambda r: (r[1].weight, r[0]))
    ranked = _local(
        spark,
        [(k, r.name, r.verdict, r.listed) for k, (_, r) in enumerate(ordered)],
        {"rank": pa.int64(), "name": pa.string(), "verdict": pa.string(), "listed": pa.bool_()},
    )
    literals = _local(
        spark,
        [(k, r.pattern, word) for k, (_, r) in enumerate(ordered) for word in set(r.literals) or {""}],
        {"rank": pa.int64(), "pattern": pa.string(), "token": pa.string()},
    )
    host, path = split_url(F.col(url_col))
    base = pages.select(row_struct(pages), host.alias("host"), path.alias("path")).withColumn(
        "uid", F.monotonically_increasing_id()
    )
    parts = F.array_distinct(F.split(F.concat("host", "path"), "[^A-Za-z0-9]+"))
    tokens = F.array_union(F.array(F.lit("")), parts)
    counts = (
        base.select(F.explode(tokens).alias("token"))
        .join(literals.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    index = (
        literals.join(counts, "token", "left")
        .groupBy("rank", "pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("rank", "pattern", F.col("rarest.token").alias("token"))
    )
    if len(rules) <= BROADCAST_RULES:
        index, ranked = F.broadcast(index), F.broadcast(ranked)
    fits = F.expr("concat(host, path) RLIKE pattern")
    best = (
        base.select("row", "uid", "host", "path", F.explode(tokens).alias("token"))
        .join(index, "token", "left")
        .groupBy("uid", "row", "host", "path")
        .agg(F.max(F.when(fits, F.col("rank"))).alias("rank"))
    )
    return best.join(ranked, "rank", "left").select(
        "row",
        "host",
        "path",
        F.when(F.col("listed"), F.col("name")).alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
