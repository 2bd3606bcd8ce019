"""What a suffix order holds, and anchors whose blocks are too large for one group."""

import random
import tracemalloc

import numpy as np
import pytest

from firmwatt.llm import suffix_dedup


def test_a_suffix_order_takes_less_than_eighty_times_its_symbols():
    symbols = np.random.default_rng(5).integers(1, 5, 300_000)
    symbols[200_000:] = symbols[:100_000]
    tracemalloc.start()
    order = suffix_dedup.SuffixOrder(symbols)
    factor = order.longest_other_factor()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(symbols)
    assert (factor[: 100_000 - 512] == 512).all() and (factor[100_000:199_000] < 100).all()


@pytest.mark.parametrize("keep, symbol, length", [("none", suffix_dedup.BYTE, 400), ("first", suffix_dedup.WORD, 51)])
def test_a_large_anchor_is_settled_by_hash_with_the_same_spans(spark, keep, symbol, length, monkeypatch):
    draw = random.Random(8)
    text = lambda n: " ".join("".join(draw.choice("abcdefg") for _ in range(6)) for _ in range(n))
    passage = text(90)
    rows = [(i, f"{text(20)} {passage} {text(20)}") for i in range(30)] + [(40, text(300)), (41, None), (None, passage)]
    keyed = suffix_dedup._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    suffix_dedup.ship(spark)
    asked = []
    by_hash = suffix_dedup._by_window_hash
    monkeypatch.setattr(suffix_dedup, "_by_window_hash", lambda texts, *a: asked.append(texts.count()) or by_hash(texts, *a))

    def places(anchor_bytes):
        spans = suffix_dedup.repeated_spans(keyed, length, keep, suffix_dedup.GROUP_BLOCKS, symbol, anchor_bytes).collect()
        return {(r["doc_id"], i) for r in spans for i in range(r["begin"], r["end"])}

    whole = places(suffix_dedup.ANCHOR_BYTES)
    assert whole and not asked
    assert places(2000) == whole and asked[0] > 20
