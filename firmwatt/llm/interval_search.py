"""Exact ranked search by best-first document intervals over range-maximum tables.

The index is cut by documents: a task turns the texts it reads into shards of a bounded size,
and a shard holds, for each of its terms, the documents with it, in the order of their ids,
and how often each has it. The statistics of the whole (documents, terms, document
frequencies) are sums over the shards, so every shard scores as if it held all documents.

Over the impacts of each posting list a sparse table answers where the largest impact in a
range lies. For an item, the largest impacts of its terms within an interval of documents,
each by its weight, add up to a bound for every document in it. The interval with the highest
bound is taken first: the document with its largest single impact is scored in whole and
splits the interval in two. An interval is left when its bound is below the k-th best
score found, or equal to it with no smaller id. Intervals are taken a few at a time, which
changes neither bounds nor results. The best k of the shards are merged; scores are
integers, so the merge is exact.

Terms are the runs of characters that are neither ASCII punctuation, white space nor control
characters, with A-Z in lower case. See ``impacts`` and ``term_weight`` for the score.

Items reach the shards in blocks of ``BLOCK_ITEMS``: a posting list is sent once per block,
together with the items that ask for its term, so neither items nor index pass the driver.

Defined cases: null texts and texts without a term are no documents of the index, and as items
find nothing; equal scores go to the smaller doc_id, null last; equal rows, of documents or
items, each count on their own; documents with a score of 0 are no results; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.llm.common import ship, stage

TOP = 10
SHARD_BYTES, BLOCK_ITEMS = 8 << 20, 256
#: Intervals that are split at a time: first, and at most.
FIRST_SPLITS, MOST_SPLITS = 8, 128
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH_PERCENT, SATURATION, SCALE = 90, 8, 1_000_000_000

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BORDER = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of terms in lower case, all others as spaces; bytes from 128 on belong to terms.
_CLEAN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms_of(text: bytes, most: int = SHARD_BYTES) -> Iterator[list[bytes]]:
    """All terms of a text in UTF-8, a stretch of it at a time."""
    at = 0
    while at < len(text):
        border = _BORDER.search(text, at + most)
        end = border.start() if border else len(text)
        yield text[at:end].translate(_CLEAN).split()
        at = end


class Shard:
    """The texts of one shard as they are read."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[object] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: object, text: bytes) -> None:
        numbers = [
            np.fromiter(map(self.vocabulary.__getitem__, terms), np.int32, len(terms)) for terms in terms_of(text)
        ]
        length = sum(map(len, numbers))
        if length:
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.found += numbers
            self.size += len(text)

    def rows(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        """A row per term, and one without a term for the documents."""
        ids = pa.array(self.ids, id_type)
        order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)
        # a posting is a term's number and the document's place in one key
        key = np.concatenate(self.found).astype(np.int64) * len(order) + np.repeat(place, lengths)
        key, often = np.unique(key, return_counts=True)
        borders = np.searchsorted(key, np.arange(len(self.vocabulary) + 1) * len(order))
        n = len(self.vocabulary)
        nothing = np.concatenate((borders, borders[-1:])).astype(np.int32)
        own = np.array([0] * (n + 1) + [len(order)], np.int32)
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array(np.full(n + 1, number)),
                "term": pa.array([t.decode() for t in self.vocabulary] + [None], pa.string()),
                "places": _lists(nothing, (key % len(order)).astype(np.int32)),
                "counts": _lists(nothing, often.astype(np.int32)),
                "doc_ids": pa.ListArray.from_arrays(pa.array(own), ids.take(pa.array(order))),
                "lengths": _lists(own, lengths[order]),
            }
        )


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


@dataclass
class Index:
    """Postings (shard, term, places, counts) and shards (shard, doc_ids, lengths) with the
    number of all documents and terms."""

    postings: DataFrame
    shards: DataFrame
    documents: int
    terms: int


def build(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, written once in the shared folder."""
    ship(documents.sparkSession)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard, kind = Shard(), None
        for batch in batches:
            kind = batch["doc_id"].type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["bytes"], strict=True):
                shard.add(doc_id, text.as_py() or b"")
                if shard.size >= shard_bytes:
                    yield shard.rows(number, kind)
                    shard, number = Shard(), number + 1
        if shard.ids:
            yield shard.rows(number, kind)

    schema = f"shard long, term string, places array<int>, counts array<int>, doc_ids array<{id_type}>, lengths array<long>"
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("bytes"))
    rows = stage(texts.mapInArrow(shards, schema))
    owners = rows.filter("term IS NULL").select("shard", "doc_ids", "lengths")
    terms = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    n, total = owners.agg(F.sum(F.size("doc_ids")), F.sum(terms)).first()
    return Index(rows.filter("term IS NOT NULL").select("shard", "term", "places", "counts"), owners, n or 0, total or 0)


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What an occurrence count adds to a score before its term's weight, rounded down."""
    norm = 100 - LENGTH_PERCENT + LENGTH_PERCENT * lengths * documents // terms
    return SCALE * counts.astype(np.int64) // (1000 * counts.astype(np.int64) + SATURATION * norm)


def term_weight(frequency: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Maxima:
    """Where the largest impact lies in any range of a list of impacts.

    Level ``j`` of the table has, for each place, the place of the largest of the ``2**j``
    impacts from there on; two of them cover a range. The first of equal ones is found.
    """

    def __init__(self, impact: np.ndarray, longest: int):
        self.impact = impact
        here = np.arange(len(impact), dtype=np.int32)
        self.levels = [here]
        for j in range(max(longest, 1).bit_length() - 1):
            left, right = self.levels[j][: -(1 << j)], self.levels[j][1 << j :]
            level = self.levels[j].copy()
            level[: len(left)] = np.where(impact[right] > impact[left], right, left)
            self.levels.append(level)
        self.table = np.stack(self.levels)

    def at(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each [low, high); ``low`` where that is empty."""
        size = high - low
        level = np.log2(np.maximum(size, 1)).astype(np.int64)
        last = len(self.impact) - 1
        left = self.table[level, np.minimum(low, last)]
        right = self.table[level, np.clip(high - (1 << level), 0, last)]
        return np.where(self.impact[right] > self.impact[left], right, left)


class Searcher:
    """The posting lists of one shard, one after the other, for some items."""

    def __init__(self, places: list[np.ndarray], impact: list[np.ndarray], documents: int):
        self.documents = documents
        sizes = np.array([len(p) for p in places])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        # lists and places in one rising key, so one search finds a document in all lists
        self.key = np.repeat(np.arange(len(places)), sizes) * documents + np.concatenate(places)
        self.maxima = Maxima(np.concatenate(impact), int(sizes.max()))
        self.scored = 0

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k documents for the terms of one item."""
        impact, maxima = self.maxima.impact, self.maxima
        low, high = self.starts[lists][None, :], self.ends[lists][None, :]
        first, last = np.zeros(1, np.int64), np.full(1, self.documents)
        top, top_score = np.empty(0, np.int64), np.empty(0, np.int64)
        at = maxima.at(low, high)
        most = np.where(high > low, impact[at] * weights, 0)
        bound, splits = most.sum(axis=1), FIRST_SPLITS
        while len(bound):
            chosen = np.arange(len(bound))
            if len(bound) > splits:
                chosen = np.argpartition(-bound, splits)[:splits]
            splits = min(2 * splits, MOST_SPLITS)
            # the document of the largest single impact of each chosen interval
            row = np.arange(len(chosen))
            found = at[chosen][row, most[chosen].argmax(axis=1)]
            document = self.key[found] % self.documents
            place = np.searchsorted(self.key, lists * self.documents + document[:, None])
            safe = np.minimum(place, len(self.key) - 1)
            there = (place < high[chosen]) & (self.key[safe] == lists * self.documents + document[:, None])
            score = np.where(there, impact[safe] * weights, 0).sum(axis=1)
            self.scored += len(score)
            top, top_score = np.append(top, document), np.append(top_score, score)
            order = np.lexsort((top, -top_score))[:k]
            top, top_score = top[order], top_score[order]
            # the halves beside it take the place of the interval
            halves = (
                np.concatenate((first[chosen], document + 1)),
                np.concatenate((document, last[chosen])),
                np.concatenate((low[chosen], place + there)),
                np.concatenate((place, high[chosen])),
            )
            half_at = maxima.at(halves[2], halves[3])
            half_most = np.where(halves[3] > halves[2], impact[half_at] * weights, 0)
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
            first, last, low, high, at, most, bound = (
                np.concatenate((old[rest], new))
                for old, new in zip(
                    (first, last, low, high, at, most, bound), (*halves, half_at, half_most, half_most.sum(axis=1)), strict=True
                )
            )
            open_ = bound > 0
            if len(top) == k:
                open_ &= (bound > top_score[-1]) | ((bound == top_score[-1]) & (first < top[-1]))
            first, last, low, high, at, most, bound = (x[open_] for x in (first, last, low, high, at, most, bound))
        return top, top_score


def item_terms(items: DataFrame) -> DataFrame:
    """item and term, once each."""
    small = F.translate(F.col("text"), _CAPITALS, _SMALL)
    terms = F.array_distinct(F.regexp_extract_all(small, F.lit(TERM), F.lit(0)))
    return items.select("item", F.explode(terms).alias("term"))


def search_index(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the best k documents of every row of ``items``."""
    id_type = index.shards.schema["doc_ids"].dataType.elementType.simpleString()
    numbered = stage(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    blocks = max(1, -(-numbered.count() // BLOCK_ITEMS))
    asked = item_terms(numbered).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    wanted = asked.select("term").distinct()
    frequencies = index.postings.join(wanted, "term").groupBy("term").agg(F.sum(F.size("places")).alias("frequency"))
    asked = asked.groupBy("block", "term").agg(F.collect_list("item").alias("items"))  # at most the items of a block
    asked = stage(asked.join(frequencies, "term"))
    documents, terms = index.documents, index.terms

    def rank(key: tuple, owner: pa.Table, lists: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(owner) and len(lists):
            lengths = _flat(owner["lengths"])
            places, counts = _arrays(lists["places"]), _arrays(lists["counts"])
            impact = [impacts(c, lengths[p], documents, terms) for p, c in zip(places, counts, strict=True)]
            weight = np.array([term_weight(f, documents) for f in lists["frequency"].to_pylist()], np.int64)
            searcher = Searcher(places, impact, len(lengths))
            by_item = defaultdict(list)
            for number, asking in enumerate(lists["items"].to_pylist()):
                for item in asking:
                    by_item[item].append(number)
            for item, numbers in by_item.items():
                use = np.array(numbers)
                place, score = searcher.best(use, weight[use], k)
                found += [(item, int(p), int(s)) for p, s in zip(place, score, strict=True) if s > 0]
        item, place, score = zip(*found, strict=True) if found else ((), (), ())
        ids = owner["doc_ids"].combine_chunks().flatten()
        return pa.table(
            {
                "item": pa.array(item, pa.int64()),
                "doc_id": ids.take(pa.array(place, pa.int64())),
                "score": pa.array(score, pa.int64()),
            }
        )

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    owners = index.shards.select(F.col("shard").alias("owner"), every.alias("block"), "doc_ids", "lengths")
    lists = index.postings.join(asked, "term").drop("term")
    best = (
        owners.groupBy("owner", "block")
        .cogroup(lists.groupBy("shard", "block"))
        .applyInArrow(rank, f"item long, doc_id {id_type}, score long")
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered, "item").select("item_id", "rank", "doc_id", "score")


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    return np.split(_flat(column), whole.offsets.to_numpy()[1:-1] - whole.offsets[0].as_py())


def search(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The best k documents of every item."""
    return search_index(build(documents), items, k)
