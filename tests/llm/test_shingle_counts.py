"""Document frequencies of all shingles, and what a stage leaves behind."""

import collections
import time

import numpy as np

from firmwatt.llm import minhash_dedup
from firmwatt.llm.common import stage


def test_every_shingle_is_counted_over_distinct_texts(spark, monkeypatch):
    draw = np.random.default_rng(8)
    words = lambda n: " ".join(f"{draw.integers(1 << 40):x}" for _ in range(n))
    passages = {held: words(12) for held in (2, 3, 17, 120)}
    texts = [" ".join([words(6), *[p for held, p in passages.items() if i < held], words(6)]) for i in range(200)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:50], "one", " ", None])]  # copies count once
    want = collections.Counter()
    for text in {(t or "").encode() for _, t in rows}:
        want.update(minhash_dedup.shingles([text])[1].tolist())
    monkeypatch.setattr(minhash_dedup, "COUNTED_BYTES", 4096)
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 2048)
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    distinct = stage(minhash_dedup._in_blocks(minhash_dedup._texts(documents)))
    found = collections.defaultdict(set)
    size = sum(len(r["bytes"]) for r in distinct.collect())
    for r in minhash_dedup.shingle_counts(distinct, size).collect():
        values = minhash_dedup._unpacked(bytes(r["shingles"])).tolist()
        for value, held in zip(values, np.frombuffer(r["held"], "<i8").tolist(), strict=True):
            found[value].add(held)
    assert {v: {n} for v, n in want.items() if n > 1} == dict(found)
    assert {2, 3, 17, 120} <= {n for n in want.values()}


def test_weights_fall_with_every_further_text():
    weights = minhash_dedup.Weights(np.array([5, 3], np.uint64), np.array([500_000, 2]), 1_000_000)
    found = weights(np.array([3, 4, 5], np.uint64), np.array([1, 2, 1]))
    assert np.allclose(found, [np.log1p(500_000), 2 * np.log1p(1_000_000), np.log1p(2)])


def test_values_are_packed_and_unpacked():
    values = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 1000, np.uint64))
    for part in (values, values[:1], values[:0], np.array([0, 1, (1 << 64) - 1], np.uint64)):
        assert minhash_dedup._unpacked(minhash_dedup._packed(part)).tolist() == part.tolist()


def test_a_stage_leaves_no_shuffle_files(spark):
    def files() -> int:
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))

    before = files()
    rows = stage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    deadline = time.time() + 20
    while files() > before and time.time() < deadline:
        time.sleep(0.2)
    assert files() <= before and rows.count() == 7
