"""Searches by matrix products select what scoring every document finds."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from firmwatt.llm import bm25_search


def _batch(ids, bags):
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "length": pa.array([int(c.sum()) for _, c in bags]),
            "words": pa.array([w.tobytes() for w, _ in bags], pa.binary()),
            "counts": pa.array([c.astype(np.int32).tobytes() for _, c in bags], pa.binary()),
        }
    )


def _bags(draw, documents, vocabulary):
    """Words by a steep law: some in most documents, most in few; two groups share none."""
    bags = []
    for i in range(documents):
        drawn = (draw.random(int(draw.integers(1, 400))) ** 4 * vocabulary).astype(np.int64) + (i // 40 % 2) * vocabulary
        bags.append(np.unique(drawn, return_counts=True))
    return bags


def _queries(bags, ids):
    words = np.concatenate([bags[i][0] for i in ids])
    weights = np.concatenate([bags[i][1] for i in ids]) * (1 + words % 7 / 3)
    return bm25_search.Queries(np.repeat(ids, [len(bags[i][0]) for i in ids]), words, weights)


def _impacts(bags, mean):
    b, k1 = bm25_search.B, bm25_search.K1
    return [c * (k1 + 1) / (c + k1 * (1 - b + b * c.sum() / mean)) for _, c in bags]


def test_small_batches_share_a_shard():
    bags = _bags(np.random.default_rng(2), 600, 500)
    batches = [_batch(range(i, i + 100), bags[i : i + 100]) for i in range(0, 600, 100)]
    found = list(bm25_search._shards(iter(batches), np.arange(1000), 200.0))
    assert [len(names) for names, _ in found] == [600]
    assert found[0][0].to_pylist() == list(range(600))
    assert len(found[0][1].document) == sum(len(w) for w, _ in bags)


@pytest.mark.parametrize("shard_docs", [4096, 150, 70])
def test_products_find_what_brute_force_finds(monkeypatch, shard_docs):
    draw = np.random.default_rng(3)
    bags = _bags(draw, 700, 2000)
    bags[650] = bags[40] = bags[300]  # equal scores go to the smaller id
    monkeypatch.setattr(bm25_search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(bm25_search, "SHARD_WORDS", shard_docs * 400)
    monkeypatch.setattr(bm25_search, "SEARCH_DOCS", 2 * shard_docs)
    monkeypatch.setattr(bm25_search, "HELD", 50_000)  # several groups of queries
    names = draw.permutation(700)
    asked = np.arange(0, 700, 10)
    queries = _queries(bags, asked)
    stored = list(bm25_search._inverter(210.0)([_batch(names, bags)]))
    assert len(stored) > 600 // shard_docs
    first = next(bm25_search._stored(iter(stored), queries.known, 210.0))
    assert (bm25_search.Search(first[1], first[2], queries).product >= 0).sum() > 20  # some words by products
    out = list(bm25_search._searcher(SimpleNamespace(value=queries), 10, 210.0, "bigint")(iter(stored)))[0]
    got = {}
    for q, d, s in zip(*(out[c].to_pylist() for c in ("query", "doc_id", "score")), strict=True):
        got.setdefault(q, []).append((d, s))
    impacts = _impacts(bags, 210.0)
    for n, q in enumerate(asked.tolist()):
        mine = slice(queries.begin[n], queries.begin[n + 1])
        weight = np.zeros(4000)
        weight[queries.known[queries.place[mine]]] = queries.weight[mine]
        scores = [float(np.bincount(np.zeros(len(w), int), weight[w] * i)[0]) for (w, _), i in zip(bags, impacts, strict=True)]
        want = sorted(((-s, names[d]) for d, s in enumerate(scores) if s > 0))[:10]
        assert got.get(q, []) == [(d, -s) for s, d in want]


def test_blocks_below_the_floor_are_left_out():
    bags = _bags(np.random.default_rng(5), 400, 300)
    stored = list(bm25_search._inverter(210.0)([_batch(range(400), bags)]))
    queries = _queries(bags, np.array([0, 41]))
    _, shard, at = next(bm25_search._stored(iter(stored), queries.known, 210.0))
    search = bm25_search.Search(shard, at, queries)
    scores = np.array([search.exact(q, list(range(400))) for q in (0, 1)])
    tenth = np.sort(scores, axis=1)[:, -10]
    query, document = search.selected(0, 2, 10, tenth)
    for q in (0, 1):
        want = np.flatnonzero(scores[q] >= tenth[q])
        assert set(want) <= set(document[query == q]) and (query == q).sum() < len(want) + 5
    assert len(search.selected(0, 2, 10, scores.max(1) * 2)[0]) == 0
