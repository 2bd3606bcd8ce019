"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

All sources share 150 % of all words by weight. A source's target stops at twice its size
and what it can't take goes to the others by weight, until none is above. The total is cut
into blocks of ``BLOCK_WORDS`` words. Blocks are allocated to sources, and a source's blocks
to its shards, by the highest quotients votes / (2 i + 1); that gives every shard an integer
quota. In a shard the documents stand in a seeded order and their words form a row of
blocks: as often as the quota covers the whole row every document is taken whole, and the
rest of the quota is a run of neighbouring blocks from a seeded start, over the end if need be.

Built from DataFrame functions alone. A source is split into shards of about
``SHARD_WORDS`` words by a hash of doc_id, so a source with a third of all rows is many
shards; only tables with one row per source, or per shard of a source, are ranked.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source, the
last one; a source without words has target 0; equal rows are documents each of their own;
a null doc_id is ordered like the text 'null'; an empty table gives no rows. The result
depends on the rows and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.llm.common import WORD, stage

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST = 2
BLOCK_WORDS = 16
SHARD_WORDS = 1_000_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def apportion(votes: DataFrame, group: list[str], seats: str, name: str, order: str) -> DataFrame:
    """Adds ``name``: the seats of each row by the highest quotients of its ``votes``.

    A row's seats lie within a known distance of its rounded share: with n rows and share f
    of the votes, at most f n / 2 + 1 away. Only quotients in that range are ranked, about
    five per row; those before it are certain. Equal quotients go by ``order``.
    """
    window = Window.partitionBy(*group)
    total, n = F.sum("votes").over(window), F.count("*").over(window)
    share = F.col("votes") / total
    ranged = (
        votes.filter("votes > 0")
        .withColumn("near", F.floor(share * F.col(seats) + 0.5))
        .withColumn("reach", F.floor(share * n / 2) + 2)
        .withColumn("sure", F.greatest(F.lit(0), F.col("near") - F.col("reach")))
    )
    keys = [*group, order]
    open_seats = F.col(seats) - F.sum(F.when(F.col("i") == F.col("sure"), F.col("sure")).otherwise(0)).over(window)
    quotients = ranged.withColumn("i", F.explode(F.sequence("sure", F.col("near") + F.col("reach") - 1)))
    quotients = quotients.withColumn("q", F.col("votes") / (2 * F.col("i") + 1)).withColumn("open", open_seats)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("q"), order))
    won = (
        quotients.withColumn("rank", rank)
        .groupBy(*keys)
        .agg((F.max("sure") + F.sum((F.col("rank") <= F.col("open")).cast("long"))).alias(name))
    )
    return votes.join(won, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def targets(by_source: DataFrame) -> DataFrame:
    """Adds target: each source's share by weight, stopped at twice its size.

    Sources that stop are those with the smallest size per weight; in that order, the first
    source that does not stop sets the words per weight of all that follow (it is the
    highest level of those that don't stop). One row per source is ranked, never a document.
    """
    one = F.lit(0).alias("all")
    by_code = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    number = (F.row_number().over(by_code) - 1).cast("int")
    rows = by_source.withColumn("number", number).withColumn(
        "weight", F.element_at(weights, F.col("number") % len(WEIGHTS) + 1)
    )
    everything = Window.partitionBy(one)
    by_room = everything.orderBy((F.col("source_size") / F.col("weight")), "number")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    most = MOST * F.col("source_size")
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / weight_left)
    stops = F.col("level") * F.col("weight") >= most
    level = F.max(F.when(~stops, F.col("level"))).over(everything)
    return rows.withColumn(
        "target", F.when(stops | level.isNull(), most.cast("double")).otherwise(level * F.col("weight"))
    ).drop("level", "weight")


def mix(documents: DataFrame, key: list[Column] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and the columns ``key``,
    which must be given names."""
    sized = documents.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), *(key or [])
    )
    return _mix(stage(sized))


def _mix(sized: DataFrame) -> DataFrame:
    """``sized``: doc_id, source, size and columns that are passed on; read from storage."""
    others = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    blocks = F.round(SHARE * F.sum("source_size").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS).cast("long")
    by_source = by_source.withColumn("blocks", blocks).withColumn("votes", F.col("target")).withColumn("all", F.lit(0))
    by_source = apportion(by_source, ["all"], "blocks", "quota", "number").select(
        F.col("source").alias("of"),
        "number",
        "source_size",
        F.round("target", 6).alias("target"),
        F.col("quota").alias("source_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long").alias("shards"),
    )
    by_source = stage(by_source)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = sized.join(by_source, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "size", "number", "source_size", "target", "source_quota", *others,
        F.pmod(_hash32(F.lit(SEED + "/shard"), name), F.col("shards")).alias("shard"),
        F.md5(F.concat_ws(":", F.lit(SEED + "/order"), name)).alias("place"),
    )
    rows = stage(rows)
    shards = rows.groupBy("number", "shard").agg(
        F.sum("size").alias("votes"), F.max("source_quota").alias("source_quota")
    )
    shards = shards.withColumn("row_blocks", F.ceil(F.col("votes") / BLOCK_WORDS).cast("long"))
    shards = apportion(shards, ["number"], "source_quota", "quota", "shard")
    quota = F.least(F.col("quota"), MOST * F.col("row_blocks"))
    start = F.pmod(_hash32(F.lit(SEED + "/start"), F.col("number"), F.col("shard")), F.greatest(F.lit(1), "row_blocks"))
    shards = stage(
        shards.select(
            F.col("number").alias("s_number"),
            F.col("shard").alias("s_shard"),
            F.col("votes").alias("words"),
            F.when(F.col("row_blocks") > 0, F.floor(quota / F.col("row_blocks"))).otherwise(0).cast("long").alias("times"),
            F.when(F.col("row_blocks") > 0, quota % F.col("row_blocks")).otherwise(0).cast("long").alias("extra"),
            F.col("row_blocks"),
            start.alias("first"),
        )
    )
    joined = rows.join(shards, (F.col("number") == F.col("s_number")) & (F.col("shard") == F.col("s_shard")))
    in_order = Window.partitionBy("number", "shard").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("lo", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    joined = joined.withColumn("hi", F.col("lo") + F.col("size"))
    last = F.col("first") + F.col("extra")
    here = _overlap(F.col("first") * BLOCK_WORDS, F.least(last * BLOCK_WORDS, F.col("words")))
    again = _overlap(F.lit(0), (last - F.col("row_blocks")) * BLOCK_WORDS)
    taken = F.col("times") * F.col("size") + here + again
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *others)


def _overlap(begin: Column, end: Column) -> Column:
    """Words that a document's place shares with the words from begin to end."""
    return F.greatest(F.lit(0), F.least(F.col("hi"), end) - F.greatest(F.col("lo"), begin))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents in the mix, with all their columns; one taken twice is there twice.

    Whole documents are given: one is there as often as the words taken make it up, rounded
    to the nearest. Only the two documents at the ends of a shard's run are ever rounded.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("doc"), "doc_id", "source", "text")
    found = _mix(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), "doc"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return found.filter(times > 0).select("doc", F.explode(F.array_repeat(F.lit(0), times))).select("doc.*")
