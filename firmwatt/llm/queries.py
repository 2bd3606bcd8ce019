"""The registered query of every operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmwatt.llm import (
    bm25_search,
    chat,
    fill_in_middle,
    interval_search,
    language_id,
    minhash_dedup,
    mixing,
    packing,
    quality_model,
    quality_rules,
    suffix_dedup,
    two_fit_packing,
    url_filter,
)
from firmwatt.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"))


def op2_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: every document whose doc_id is divisible by 100."""
    return bm25_search.search(table(spark, sf, "documents"), F.col("doc_id") % 100 == 0)


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.classes(table(spark, sf, "documents"))


def op10_chat(spark: SparkSession, sf: str) -> DataFrame:
    """The mask as text: begin-end, begin-end, ..."""
    views = chat.rotate(table(spark, sf, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    return views.withColumn("mask", F.array_join(spans, ","))


def op11_best_two_fit(spark: SparkSession, sf: str) -> DataFrame:
    return two_fit_packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf, "documents"))


def op13_interval_search(spark: SparkSession, sf: str) -> DataFrame:
    """Items: every row of ``benchmark``."""
    return interval_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def queries() -> dict[str, Query]:
    found = [f for name, f in globals().items() if name.startswith("op")]
    return {f.__name__: f for f in found}
