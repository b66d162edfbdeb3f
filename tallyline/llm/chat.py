"""Render a dialogue once for each participant, who speaks as the assistant in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.errors import ConfigError
from tallyline.llm.common import cut

# Messages of one rendered part.
PART = 512
OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"


def _clean(text: Column) -> Column:
    """Text that cannot be taken for the format's own marks."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _ranked(turns: DataFrame) -> DataFrame:
    """Add ``at``, the place of a message in its dialogue, from 0.

    Messages are dealt by ranges of (dialogue, turn, ...), so a long dialogue spreads over tasks; places
    inside a range are moved on by the counts of the ranges before.
    """
    order = ["conv", "turn", "role", "body", "tie"]
    tied = turns.withColumn("tie", F.monotonically_increasing_id())
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(
        tied.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "turns"
    )
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("conv", "part", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    return (
        dealt.withColumn("local", local)
        .alias("d")
        .join(starts.alias("s"), F.col("d.conv").eqNullSafe(F.col("s.conv")) & (F.col("d.part") == F.col("s.part")))
        .select("d.conv", "d.role", "d.body", (F.col("s.before") + F.col("d.local")).alias("at"))
    )


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    context: int = 0,
) -> DataFrame:
    """``conv``, ``speaker``, ``part``, ``rendered``, ``mask``, ``n_turns``, ``n_trained``.

    For every speaker but the system, the whole dialogue with that speaker as ``assistant`` and each other one
    as ``user name=...``; system messages stay. ``mask`` lists the spans of ``rendered`` to train on, as
    structs of first character and the one after the last: the speaker's own texts with their closing mark. Messages go by turn (null first),
    then speaker, then text. A null speaker is named ``unknown``, a null text is empty, a null dialogue id is one
    dialogue. Repeated messages stay. Marks inside names and texts are broken up. A dialogue of system messages only has no
    participant and no rows; an empty table gives none.

    A dialogue of more than ``PART`` messages is rendered in parts of that many, numbered from 0, for each of
    its speakers, so no task holds a dialogue of unbounded length. ``context`` messages (at most ``PART``) before a part are
    shown again in front of it, and before them the dialogue's first message if that is the system's; these neither count
    nor are trained on.
    """
    if not 0 <= context <= PART:
        raise ConfigError(f"a context of {context} messages for parts of {PART}")
    said = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        _clean(F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))).alias("role"),
        _clean(F.coalesce(F.col(text_col), F.lit(""))).alias("body"),
    )
    ranked = cut(_ranked(said), "ranked")
    speakers = ranked.filter(F.col("role") != SYSTEM).select("conv", F.col("role").alias("speaker")).distinct()
    own, next_ = F.floor(F.col("at") / PART), F.floor((F.col("at") + context) / PART)
    placed = ranked.withColumn("part", F.explode(F.array_distinct(F.array(own, next_))))
    begins = F.col("part") * PART
    parts = (
        placed.groupBy("conv", "part")
        .agg(F.array_sort(F.collect_list(F.struct("at", "role", "body"))).alias("messages"))
        # Behind a dialogue's end there is nothing but what was shown before.
        .filter(F.exists("messages", lambda m: m["at"] >= begins))
    )
    if context:
        first = ranked.filter((F.col("at") == 0) & (F.col("role") == SYSTEM)).select(
            F.col("conv").alias("first_of"), F.array(F.struct("at", "role", "body")).alias("first")
        )
        later = F.col("first").isNotNull() & (F.get("messages", F.lit(0))["at"] > 0)
        parts = parts.join(first, F.col("conv").eqNullSafe(F.col("first_of")), "left").select(
            "conv", "part", F.when(later, F.concat("first", "messages")).otherwise(F.col("messages")).alias("messages")
        )
    views = parts.alias("p").join(speakers.alias("s"), F.col("p.conv").eqNullSafe(F.col("s.conv"))).select(
        "p.conv", "s.speaker", "p.part", "p.messages"
    )
    head = lambda m: F.when(m["role"] == F.col("speaker"), "assistant").when(
        m["role"] == SYSTEM, SYSTEM
    ).otherwise(F.concat(F.lit("user name="), m["role"]))
    shown = views.withColumn(
        "shown",
        F.transform(
            "messages",
            lambda m: F.struct(
                F.concat(F.lit(OPEN), head(m), F.lit("\n")).alias("head"),
                F.concat(m["body"], F.lit(CLOSE)).alias("body"),
                ((m["role"] == F.col("speaker")) & (m["at"] >= begins)).alias("own"),
                (m["at"] >= begins).alias("counted"),
            ),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(done: Column, m: Column) -> Column:
        first = done["at"] + F.length(m["head"])
        end = first + F.length(m["body"])
        span = F.array(F.struct(first.alias("start"), end.alias("end")))
        return F.struct(
            (end + 1).alias("at"), F.when(m["own"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans")
        )

    return shown.select(
        "conv",
        "speaker",
        F.col("part").cast("long").alias("part"),
        F.array_join(F.transform("shown", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("shown", start, step)["spans"].alias("mask"),
        F.size(F.filter("shown", lambda m: m["counted"])).cast("long").alias("n_turns"),
        F.size(F.filter("shown", lambda m: m["own"])).cast("long").alias("n_trained"),
    )
