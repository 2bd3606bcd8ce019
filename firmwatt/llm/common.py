"""What the operators share: tables, stage boundaries, shipped code, word splitting."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmwatt.sources.sinks import stage

__all__ = ["WORD", "crc_mod", "mix64", "rows_of", "ship", "slices", "stage", "table", "word_edges", "word_hashes"]

#: A word: the longest run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts go to a Python worker in batches of about so many bytes.
BATCH_BYTES = "4m"

_SHIPPED: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions are then found by name, and what a Python worker has loaded (tables of a
    tokenizer, cached words) stays there for its next tasks. A batch of 10,000 texts is held
    several times, by the JVM and by the worker, so batches are bounded by bytes as well.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="code-")), "firmwatt_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of a value as text, modulo ``divisor``; null counts as the text 'null'."""
    text = F.coalesce(column.cast("string"), F.lit("null"))
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(divisor)).cast("int")


def rows_of(df: DataFrame) -> int:
    return df.count()


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``most`` bytes, one row at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
#: Longer tables, for very long texts, are not kept by the worker.
KEPT_POWERS = 1 << 21
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of an odd base modulo 2^64, and of its inverse."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= KEPT_POWERS:
            _POWERS[0] = have
    return have


def word_edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word of a text, and the byte after its last one."""
    inside = ~((text == 32) | ((text >= 9) & (text <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edge[::2], edge[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of several texts, and the index of each word's text.

    The texts are joined by a line feed and hashed at once: a word's hash is a
    polynomial over its bytes, read off running sums.
    """
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    if not len(joined):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    begin, end = word_edges(joined)
    up, down = powers(len(joined))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=sums[1:])
        hashes = mix64((sums[end] - sums[begin]) * down[begin])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begin, side="right") - 1
