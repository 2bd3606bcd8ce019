"""Chat formatting by perspective rotation.

Every participant of a conversation gets the dialogue from their side: their turns are the
assistant's, the others are users with their names, system turns stay. The mask lists the
character spans that the participant is trained on: their texts with the end mark.

A turn is ``<|im_start|>role`` or ``<|im_start|>user name=NAME``, a line feed, the text and
``<|im_end|>`` with a line feed. Marks inside a text are broken up (``<|`` becomes ``< |``).

A conversation is rendered whole up to ``PART_BYTES`` and cut into parts only above it: a turn
counts its text, its speaker's name and ``TURN_BYTES`` for the marks, and its part is the sum of
the turns before it over ``PART_BYTES``. So no row grows with the table, and a conversation with
a third of all rows is many parts. Every participant of the conversation gets every part, also
those where they don't speak. A part after the first begins with the system turn in force, the
last one before it. The order of a conversation that is cut is found by a range partition and sums
per partition; rows that are equal in it are equal in all that is rendered, so the parts don't
depend on the layout of the files.

Defined cases: a null role is a participant named ``unknown``; a null text is empty; turns
go by turn number (null first), then role, then text; a conversation of system turns alone
has no participants and gives no row; a null conv_id is a conversation; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.llm.common import stage

PART_BYTES, TURN_BYTES = 1 << 19, 64


def parts(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Turns with the columns conv_id, part, turn, speaker and text."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    speaker = F.coalesce(F.col("role"), F.lit("unknown"))
    rows = conversations.select("conv_id", "turn", speaker.alias("speaker"), text.alias("text"))
    rows = rows.withColumn("bytes", F.octet_length("text") + F.octet_length("speaker") + F.lit(TURN_BYTES).cast("long"))
    large = rows.groupBy("conv_id").agg(F.sum("bytes").alias("all")).filter(F.col("all") > part_bytes)
    large, same = _same_part(stage(large.select("conv_id")), ("conv_id",))
    whole = F.lit(0).cast("long").alias("part")
    columns = ["conv_id", "turn", "speaker", "text"]
    if not large.limit(1).count():
        return rows.select(*columns, whole)
    cut = _cut(rows.join(large, same, "left_semi"), part_bytes)
    return rows.join(large, same, "left_anti").select(*columns, whole).unionByName(cut)


def _cut(rows: DataFrame, part_bytes: int) -> DataFrame:
    """The rows with their part: the bytes before them in their conversation, by ``part_bytes``.

    A tie-breaker spreads equal rows over partitions; which of them is first makes no difference.
    """
    order = ["turn", "speaker", "text", "tie"]
    tied = stage(rows.withColumn("tie", F.monotonically_increasing_id()))
    ranged = stage(tied.repartitionByRange("conv_id", *order).withColumn("slot", F.spark_partition_id()))
    slots = ranged.groupBy("conv_id", "slot").agg(F.sum("bytes").alias("held"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("slot")) - F.col("held")
    slots, same = _same_part(slots.select("conv_id", "slot", before.alias("before")), ("conv_id", "slot"))
    within = F.sum("bytes").over(Window.partitionBy("slot", "conv_id").orderBy(*order)) - F.col("bytes")
    place = F.floor((F.col("before") + within) / part_bytes).cast("long")
    return ranged.join(slots, same).select("conv_id", "turn", "speaker", "text", place.alias("part"))


def _same_part(other: DataFrame, names: tuple[str, ...] = ("conv_id", "part")) -> tuple[DataFrame, Column]:
    """``other`` with ``names`` renamed, and the condition that they are equal or both null."""
    renamed = other.withColumnsRenamed({n: f"o_{n}" for n in names})
    return renamed, reduce(and_, [F.col(n).eqNullSafe(F.col(f"o_{n}")) for n in names])


def views_of(rows: DataFrame) -> DataFrame:
    """conv_id, part and me: each part with each participant of its conversation."""
    speakers = rows.filter("speaker != 'system'").select("conv_id", F.col("speaker").alias("me")).distinct()
    speakers, same = _same_part(speakers, ("conv_id",))
    return rows.select("conv_id", "part").distinct().join(speakers, same).drop("o_conv_id")


def in_force(turns: DataFrame) -> DataFrame:
    """conv_id, part and force: the last system turn before each part that has one.

    ``turns`` has one row per part with its last system turn as ``last``. The window sees the
    numbers of a conversation's parts alone; the turn is joined by the part that holds it.
    """
    held = F.when(F.col("last").isNotNull(), F.col("part"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    holder = turns.select("conv_id", "part", F.last(held, ignorenulls=True).over(earlier).alias("holder"))
    last, _ = _same_part(turns.select("conv_id", "part", "last"))
    same = F.col("conv_id").eqNullSafe(F.col("o_conv_id")) & (F.col("holder") == F.col("o_part"))
    return holder.filter("holder IS NOT NULL").join(last, same).select("conv_id", "part", F.col("last").alias("force"))


def rotate(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per part and participant: conv_id, part, speaker, text, mask, n_turns.

    ``mask`` is an array of (begin, end) in characters, ``end`` not included; ``n_turns``
    counts the part's own turns, without the system turn from before it.
    """
    rows = parts(conversations, part_bytes)
    turn = F.struct("turn", "speaker", "text")
    whole = rows.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.max(F.when(F.col("speaker") == "system", turn)).alias("last"),
    )
    force, same = _same_part(in_force(whole))
    turns = F.when(F.col("force").isNull(), F.col("turns")).otherwise(F.concat(F.array("force"), "turns"))
    whole = whole.join(force, same, "left").select(
        "conv_id", "part", F.size("turns").alias("n_turns"), turns.alias("turns")
    )
    views, same = _same_part(views_of(rows))
    views = whole.join(views, same)
    head = lambda t: F.when(t["speaker"] == F.col("me"), F.lit("assistant")).when(
        t["speaker"] == "system", F.lit("system")
    ).otherwise(F.concat(F.lit("user name="), t["speaker"]))
    rendered = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("<|im_start|>"), head(t), F.lit("\n")).alias("head"),
            F.concat(t["text"], F.lit("<|im_end|>")).alias("body"),
            (t["speaker"] == F.col("me")).alias("mine"),
        ),
    )
    views = views.withColumn("rendered", rendered)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state, t):
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(
            (end + 1).alias("at"), F.when(t["mine"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    text = F.array_join(F.transform("rendered", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    return views.select(
        "conv_id",
        "part",
        F.col("me").alias("speaker"),
        text.alias("text"),
        F.aggregate("rendered", start, step, lambda s: s["spans"]).alias("mask"),
        "n_turns",
    )
