"""Quality rules whose cutoffs keep the rate of false rejections below a set risk.

Every rule compares one statistic of a text with a cutoff. The cutoffs are not guessed:
on labelled documents, an exact binomial bound shows for each cutoff of a fixed grid
whether the share of good documents that it rejects can exceed the allowed share. Per
stratum (language) the strictest cutoff that is shown to be safe is taken.

Risk. ``ALPHA`` is the share of good documents of a stratum that all rules together may
reject; each of the R rules gets ``ALPHA / R``. ``DELTA`` is the chance that any of the
S strata breaks this; each of the R x S tests gets ``DELTA / (R S)`` (Bonferroni). Within
a rule the grid is tested from the mildest cutoff to stricter ones and the first failure
ends it (fixed-sequence testing, no further correction). Rejections only grow along the
grid, so the strictest safe cutoff is the smallest one with a passed test. A stratum with
too few labels to show anything gets no cutoff.

Defined cases: a null text has no words and fails the base rules, an empty one as well;
a null language is a stratum of its own; several labels of a document count as its lowest;
a document without labels takes no part in the choice; without any label only the base
rules reject. Equal rows are judged alike. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.llm.common import ship, stage
from firmwatt.llm.token_ids import forget

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS = 50
GRID = [10 * 2 ** (k / 4) for k in range(45)]
#: Cutoffs in thousandths, from strict to mild.
CUTOFFS = sorted({int(x) for x in GRID})

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_caps long"

_SPACE = bytes([32, *range(9, 14)])
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The statistics named in ``STATS`` of one text in UTF-8."""
    if not text:
        return (0,) * 7
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
    )


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1].astype(np.int64) * len(number) + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def stats_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The statistics of batches of texts."""
    forget()  # a worker that packed before would hold its tokens on
    names = [field.split()[0] for field in STATS.split(", ")]
    for batch in texts:
        yield pd.DataFrame([text_stats(t) for t in batch], columns=names).astype("int64")


def stats_column(text: Column) -> Column:
    """A struct of the statistics; only the text goes to Python."""

    @F.pandas_udf(STATS)
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from stats_of(texts)

    return stats(text.cast("binary"))


def per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("long")


def rule_values(s: str) -> dict[str, Column]:
    """What each rule compares, in thousandths; a document is rejected at the cutoff or above."""
    c = {name: F.col(f"{s}.{name}") for name in (field.split()[0] for field in STATS.split(", "))}
    length = per_mille(c["word_chars"], c["n_words"])
    return {
        "symbols": per_mille(c["n_symbols"], c["n_words"]),
        "dup_lines": per_mille(c["n_dup_lines"], c["n_lines"]),
        "repeats": per_mille(c["n_repeat_words"], c["n_words"]),
        "caps": per_mille(c["n_caps"], c["word_chars"]),
        "long_words": length - 5000,
        "short_words": 5000 - length,
    }


RULES = ("symbols", "dup_lines", "repeats", "caps", "long_words", "short_words")


def allowed_rejections(n: int, share: float, chance: float) -> int:
    """The largest k for which k rejections out of n show that the share is kept.

    Shown means that the exact binomial bound holds: with a true share of ``share`` or
    more, k rejections or fewer have at most the probability ``chance``. -1: not even none.
    """
    if n <= 0:
        return -1
    total, k, log = 0.0, -1, n * math.log1p(-share)
    odds = math.log(share) - math.log1p(-share)
    while k < n:
        total += math.exp(log)
        if total > chance:
            return k
        k += 1
        log += math.log(n - k) - math.log(k + 1) + odds if k < n else 0.0
    return k


def choose_cutoffs(judged: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum one column for each rule: its cutoff, or null for none.

    ``judged`` has a row per good labelled document: ``stratum`` and the rules' values.
    What is gathered per stratum and rule is a count for each cutoff of the grid.
    """
    step = sum((F.col("value") >= F.lit(c)).cast("int") for c in CUTOFFS)
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES]))
    counts = (
        judged.select("stratum", values.alias("v"))
        .select("stratum", "v.rule", "v.value")
        .groupBy("stratum", "rule", step.alias("step"))
        .agg(F.count("*").alias("n"))
    )
    strata = max(1, judged.select("stratum").distinct().count())
    share, chance = alpha / len(RULES), delta / (len(RULES) * strata)

    def strictest(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].sum())
        least = allowed_rejections(n, share, chance)
        reached = np.zeros(len(CUTOFFS) + 1, np.int64)
        np.add.at(reached, group["step"].to_numpy(), group["n"].to_numpy())
        rejected = reached[::-1].cumsum()[::-1][1:]
        safe = np.flatnonzero(rejected <= least)
        cutoff = CUTOFFS[safe[0]] if len(safe) else None
        return pd.DataFrame(
            {"stratum": group["stratum"].iloc[:1], "rule": group["rule"].iloc[:1], "cutoff": pd.array([cutoff], "Int64")}
        )

    chosen = counts.groupBy("stratum", "rule").applyInPandas(strictest, "stratum string, rule string, cutoff long")
    return chosen.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]
    )


def base_failed(s: str) -> Column:
    n = F.col(f"{s}.n_words")
    return (n < MIN_WORDS) | (F.col(f"{s}.n_repeat_words") * 100 > n * 50)


def cutoffs(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statistics of all documents, kept in a table, and the cutoffs learned from them."""
    ship(documents.sparkSession)
    measured = stage(documents.select("doc_id", F.col("lang").alias("stratum"), stats_column(F.col("text")).alias("s")))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    judged = measured.join(good, "doc_id").select(
        "stratum", *[v.alias(r) for r, v in rule_values("s").items()]
    )
    return measured, stage(choose_cutoffs(judged))


def _with_verdict(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``failed`` and ``kept``; rows have the columns ``stratum`` and ``s``."""
    c = chosen.withColumnRenamed("stratum", "cut_stratum")
    joined = rows.join(c, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    bad = F.lit(False)
    for rule, value in rule_values("s").items():
        bad = bad | F.coalesce(value >= F.col(f"cut_{rule}"), F.lit(False))
    return joined.withColumn("failed", base_failed("s")).withColumn("kept", ~F.col("failed") & ~bad)


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed and kept."""
    measured, chosen = cutoffs(documents, labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return _with_verdict(measured, chosen).select(
        "doc_id", *[F.col(f"s.{n}").alias(n) for n in names], F.col("failed").alias("base_failed"), "kept"
    )


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The texts are read a second time with the cutoffs known; they are never shuffled.
    """
    _, chosen = cutoffs(documents, labels)
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"),
        F.col("lang").alias("stratum"),
        stats_column(F.col("text")).alias("s"),
    )
    return _with_verdict(rows, chosen).filter("kept").select("doc.*")
