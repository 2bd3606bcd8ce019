"""What a search task holds while its queries run."""

import tracemalloc

import numpy as np
import pyarrow as pa

from firmwatt.llm import bm25_search


def test_raw_postings_end_before_the_queries_run():
    draw = np.random.default_rng(1)
    words = [np.unique(draw.integers(0, 5000, 200)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(range(len(words))),
            "length": pa.array([len(w) for w in words]),
            "words": pa.array([w.tobytes() for w in words], pa.binary()),
            "counts": pa.array([np.ones(len(w), np.int32).tobytes() for w in words], pa.binary()),
        }
    )
    known = np.arange(0, 5000, 2)
    tracemalloc.start()
    shards = bm25_search._shards([batch], known, 200.0)
    names, shard = next(shards)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    index = sum(v.nbytes for v in vars(shard).values() if isinstance(v, np.ndarray))
    assert len(names) == len(words) and held < 1.3 * index
    # the index has the known words only, each with its documents and their impacts
    assert list(shard.words) == sorted({w for row in words for w in row} & set(known.tolist()))
    assert len(shard.document) == sum(int((w % 2 == 0).sum()) for w in words)
    for d in (0, 1999):
        impact = (bm25_search.K1 + 1) / (1 + bm25_search.K1 * (1 - bm25_search.B + bm25_search.B * len(words[d]) / 200.0))
        assert np.allclose(shard.impact[shard.document == d], impact)
