"""Drop lines that many documents share.

Lines are exploded with their position, normalised and hashed; documents are
counted per hash; the lines of a frequent hash go, except in one document; what
stays is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import SPACES, ascii_lower, cut, row_struct


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(key: Column) -> list[Column]:
    """Two 64-bit hashes ``h1`` and ``h2`` of the key's bytes under different seeds: a hash of several columns
    hands each one's result on as the seed of the next, so the key has to come last."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def _without(lines: Column, positions: Column) -> Column:
    """Join the runs of lines between dropped positions (ascending, distinct), in time linear in both."""
    before = lambda i: F.coalesce(F.get(positions, i - 1) + 1, F.lit(0))
    until = lambda i: F.coalesce(F.get(positions, i), F.size(lines))
    runs = F.transform(
        F.sequence(F.lit(0), F.size(positions)),
        lambda i: F.slice(lines, before(i) + 1, until(i) - before(i)),
    )
    return F.array_join(F.flatten(runs), "\n")


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Return ``row`` (the input row), ``n_lines``, ``n_dropped`` and ``kept`` (the text that is left).

    A key of at least ``min_chars`` code points that ``min_docs`` different ids
    hold loses its lines everywhere but in the largest id. A null or empty text is one empty
    line and gives an empty text. Rows without an id count as one document that is
    never the largest. Repeated rows of an id are one document and all keep
    their lines if it is the largest. An empty table gives an empty result;
    columns beside id and text are handed on inside ``row``.

    Keys are compared by 128 bits of hash. The text is shuffled once, to meet
    its dropped positions; everything else moves 40 bytes a line. Frequent keys
    are counted with map-side combination, and joined in a way that Spark can split.
    """
    base = docs.select(
        row_struct(docs), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    ).withColumn("th", F.xxhash64("t"))
    keys = F.transform(F.split("t", "\n", -1), line_key)
    hashed = F.transform(
        keys,
        lambda k, i: F.when(
            F.length(k) >= min_chars,
            F.struct(i.alias("pos"), *line_hashes(k)),
        ),
    )
    lines = cut(
        base.select("id", "th", F.explode(F.array_compact(hashed)).alias("x")).select("id", "th", "x.*"), "lines"
    )
    # Written, so that the join below shuffles both sides by itself and Spark can split a hot key.
    frequent = cut(
        lines.groupBy("h1", "h2", "id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= min_docs),
        "frequent",
    )
    dropped = (
        lines.join(frequent, ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("id2"), F.col("th").alias("th2"))
        .agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    )
    found = base.join(
        dropped, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left"
    ).withColumn("ls", F.split("t", "\n", -1))
    return found.select(
        "row",
        F.size("ls").cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("positions").isNull(), F.col("t")).otherwise(_without(F.col("ls"), F.col("positions"))).alias("kept"),
    )
