"""What a task of the repeated passages holds, and what a worker keeps for other work."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa

from firmwatt.llm import quality_rules, suffix_dedup, token_ids
from firmwatt.llm.common import ship, word_hashes


class Table:
    """Stands for a table: gives the function that a task would run."""

    schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function


def test_blocks_of_a_batch_are_given_on_in_parts():
    draw = np.random.default_rng(4)
    texts = [draw.integers(0, 1 << 60, 600).astype("<u8").tobytes() for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(range(len(texts))),
            "text_hash": pa.array(range(len(texts))),
            "bytes": pa.array(texts, pa.binary()),
        }
    )
    cut = suffix_dedup._blocks(Table(), 51, suffix_dedup.WORD)
    suffix_dedup.powers(1 << 12)
    tracemalloc.start()
    found, many = [], 0
    for part in cut(iter([batch, batch.slice(0, 0)])):
        many += len(part)
        if not found:
            found = part.to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # less than the texts of the batch, whatever its size
    assert peak < sum(len(t) for t in texts) / 2
    want = [(d, *b) for d, t in enumerate(texts) for b in suffix_dedup.window_blocks(t, 51, suffix_dedup.GRAM_WORDS, suffix_dedup.WORD)]
    assert many == len(want)
    assert [(r["doc_id"], r["anchor"], r["content"], r["start"], r["n"]) for r in found] == want[: len(found)]
    assert len(word_hashes([b"a b"])[0]) == 2


def test_rules_free_the_tokens_of_packing():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        token_ids.encoder(file.read())
    assert token_ids._ENCODERS
    stats = quality_rules.stats_of(iter([pd.Series([b"one two", None])]))
    assert next(stats)["n_words"].tolist() == [2, 0] and not token_ids._ENCODERS


def test_batches_of_texts_are_bounded_by_bytes(spark):
    ship(spark)
    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('0123456789', 1000) AS text")  # 20 MB in one partition
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches)
    found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 20_000_000 and max(found) < 6_000_000
