"""Quality scores by ridge regression on random Fourier features, calibrated isotonically.

Statistics of a text are standardised and mapped to ``FEATURES`` random cosines, whose inner
products approximate a Gaussian kernel. Each partition sums its normal equations (Z'Z and
Z'y), the sums meet by matrix row, and one small system is solved; its size depends on the
number of features alone. Scores of labelled rows that the regression has not seen are
binned, and the pooled adjacent violators of the bins turn scores into probabilities.

Rows whose crc32 of doc_id is 0 modulo 5 are held out; of the others 1 to 3 fit the
regression and 4 the calibration. Language, source, doc_id and labels are never inputs.

Defined cases: a null text counts as empty and is scored like any other (all statistics 0);
equal rows have equal scores; several labels of a document count as their mean; without
labels every score is 0.5. Scores are rounded to 6 digits, as sums depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmwatt.llm.common import crc_mod, ship, stage
from firmwatt.llm.quality_rules import text_stats

FEATURES, WIDTH, RIDGE, SEED = 256, 2.5, 1e-3, 11
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 4
BINS, LOW, HIGH = 2000, -0.5, 1.5
CUT = 0.3

_DIGITS, _STOPS, _LOUD = b"0123456789", b".,;:", b"!?"
STATISTICS = 14


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text in UTF-8 that scores depend on."""
    if not text or not text.strip():
        return [0.0] * STATISTICS
    n_words, word_chars, symbols, dup_lines, repeats, n_lines, caps = text_stats(text)
    words = text.split()
    distinct = len(set(words))
    rate = lambda marks: (len(text) - len(text.translate(None, marks))) / n_words
    longest = max(map(len, words))
    return [
        math.log1p(n_words),
        word_chars / n_words,
        math.log1p(symbols / n_words),
        dup_lines / n_lines,
        repeats / n_words,
        caps / word_chars,
        rate(_DIGITS),
        rate(_STOPS),
        rate(_LOUD),
        math.log1p(n_lines),
        math.log1p(n_words / n_lines),
        distinct / n_words,
        math.log1p(n_words) * distinct / n_words,
        math.log1p(longest),
    ]


class Cosines:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.waves = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        standard = np.clip((rows - self.mean) / self.scale, -6, 6)
        z = np.cos(standard @ self.waves + self.shift) * math.sqrt(2 / FEATURES)
        return np.hstack([np.ones((len(rows), 1)), z])


def isotonic(n: np.ndarray, good: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: centres and shares of blocks that never fall."""
    blocks: list[list[float]] = []
    for weight, ones, centre in zip(n.tolist(), good.tolist(), at.tolist(), strict=True):
        blocks.append([weight, ones, weight * centre])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 2] / table[:, 0], table[:, 1] / table[:, 0]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch["stats"].flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch), STATISTICS)


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, fold and the statistics of every document."""
    ship(documents.sparkSession)

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return documents.select(
        "doc_id", crc_mod(F.col("doc_id"), FOLDS).alias("fold"), stats(F.col("text").cast("binary")).alias("stats")
    )


def _normal_equations(rows: DataFrame, cosines: Cosines) -> np.ndarray:
    """Z'(Z, y) summed over all rows; the table that is gathered has one row per feature."""
    fields = "feature int, sums array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = cosines(_matrix(batch))
            sums += z.T @ np.column_stack([z, batch["y"].to_numpy()])
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array(np.arange(FEATURES + 1, dtype=np.int32)), "sums": pa.array(list(sums))}
        )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": group["feature"].iloc[:1], "sums": [np.sum(np.stack(group["sums"]), axis=0)]})

    summed = rows.mapInArrow(partial, fields).groupBy("feature").applyInPandas(add, fields)
    return np.stack(summed.orderBy("feature").toPandas()["sums"])


class Model:
    """Weights of the features and the calibrated steps."""

    def __init__(self, cosines: Cosines, weights: np.ndarray, centres: np.ndarray, shares: np.ndarray):
        self.cosines, self.weights, self.centres, self.shares = cosines, weights, centres, shares

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(rows) @ self.weights, LOW, HIGH)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.centres, self.shares)


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled rows that are not held out; None without labels."""
    y = labels.groupBy("doc_id").agg(F.avg("quality").alias("y")).filter("y is not null")
    known = stage(stats.filter(F.col("fold") != HELD_OUT).join(y, "doc_id").select("fold", "stats", "y"))
    learning = known.filter(F.col("fold") != CALIBRATES).select("stats", "y")
    moments = learning.agg(
        F.count("*").alias("n"),
        *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if not moments["n"]:
        return None
    cosines = Cosines(*[np.array([moments[f"{k}{i}"] for i in range(STATISTICS)]) for k in "ms"])
    sums = _normal_equations(learning, cosines)
    ridge = RIDGE * moments["n"] * np.eye(FEATURES + 1)
    ridge[0, 0] = 0
    weights = np.linalg.solve(sums[:, :-1] + ridge / FEATURES, sums[:, -1])
    model = Model(cosines, weights, np.array([LOW, HIGH]), np.array([0.5, 0.5]))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.floor((model.raw(_matrix(batch)) - LOW) / (HIGH - LOW) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(step), "y": batch["y"]})

    held = known.filter(F.col("fold") == CALIBRATES).select("stats", "y")
    counts = held.mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    table = counts.orderBy("bin").toPandas()  # one row per bin at most
    if len(table):
        at = LOW + (table["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
        model.centres, model.shares = isotonic(table["n"].to_numpy(), table["y"].to_numpy(), at)
    return model


def score(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    stats = stage(measured(documents))
    model = fit(stats, labels)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.stack(batch) if len(batch) else np.empty((0, STATISTICS))
            yield pd.Series(np.round(np.clip(model(rows), 0, 1), 6) if model else np.full(len(rows), 0.5))

    found = stats.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), scores("stats").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= cut).cast("int"))
