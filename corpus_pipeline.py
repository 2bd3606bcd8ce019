"""The corpus pipeline: rules, near-duplicates, repeated passages, the mix, packing.

Each stage works on what its predecessor kept. The result is the layout of all packed
documents: one row per piece, with its document, its tokens and its place in a sequence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firmwatt.llm import minhash_dedup, mixing, packing, quality_rules, suffix_dedup
from firmwatt.llm.common import stage, table
from firmwatt.sources.sinks import Stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The shortest passage of over 50 words.
PASSAGE_WORDS = 51


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages of over 50 words; the first copy stays."""
    return suffix_dedup.cut_documents(docs, length=PASSAGE_WORDS, symbol=suffix_dedup.WORD)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, as often as it takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: What the stage before stored while it worked, by application, folder and place in the chain.
_STORED: dict[tuple[str, str, int], Stages] = {}


def _tidy(place: int, function: Stage) -> Stage:
    """A stage that first removes what its predecessor stored while it worked.

    Its predecessor's rows were written before it begins, so only they are read on. What
    the last stage stored stays, as its rows are read later.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        former = _STORED.pop((app, sf_dir, place - 1), None)
        if former is not None and not any(f in file for file in docs.inputFiles() for f in former.folders):
            former.release()
        with Stages(spark) as stored:
            result = function(spark, docs, sf_dir)
        _STORED[app, sf_dir, place] = stored
        return result

    return run_stage


STAGES = [
    (name, _tidy(place, function))
    for place, (name, function) in enumerate(
        [
            ("quality_rules", rules),
            ("minhash_dedup", near_duplicates),
            ("suffix_dedup", repeated_passages),
            ("mixing", mix),
            ("packing", pack),
        ]
    )
]

#: SQL can't express the tokens nor the random draws; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = table(spark, sf_dir, "documents"), None
    for _, function in STAGES[:-1]:
        result = function(spark, docs, sf_dir)
        with Stages(spark) as written:
            docs = stage(result)
        if former is not None:
            former.release()
        former = written
    return STAGES[-1][1](spark, docs, sf_dir)
