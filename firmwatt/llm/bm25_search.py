"""Exact top-k search by BM25 over an inverted index with block maxima.

Statistics are global: number of documents, mean length and the document frequency of every
word over all rows. The postings of each document are written once, and once more as shards of
up to ``SHARD_DOCS`` documents, inverted: per word, documents and impacts.

Queries go to the tasks in blocks of ``QUERY_WORDS`` words; one pass over the shards per
block, so what is sent at a time has a fixed size however many queries there are. In a shard a
block's words fall into two kinds. Words that few of its documents or queries hold are scored
posting by posting. Words that many hold on both sides are columns of two matrices, queries
and documents, whose product scores them together. Before that, the frequent words' largest
impacts in every ``BLOCK_DOCS`` documents give a bound for each query and block, as in
block-max WAND; blocks that cannot reach the k-th best score so far are left out of the product.
The product is in single precision and only selects: what it leaves within its error of the
best k is scored again in double precision, word by word. Each task returns its best k, and
the best k of these are exact, as scores use the global statistics.

score = sum over query words of qtf * idf * tf (k1 + 1) / (tf + k1 (1 - b + b len / mean)),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Words are runs of characters other than ASCII
white space, with A-Z in lower case.

Defined cases: texts without words, or null, are never found and as queries find nothing;
equal scores go to the smaller doc_id, null last; equal rows are found each, and as queries
answered each; rows with a
score of 0 are not results; fewer than k matches give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.llm.common import ship, slices, stage, word_hashes

K1, B, TOP = 1.2, 0.75, 10
SHARD_DOCS, SHARD_WORDS, BLOCK_DOCS, QUERY_WORDS = 2048, 1_000_000, 32, 1_000_000
#: Shards are searched together up to so many documents and postings.
SEARCH_DOCS, SEARCH_WORDS = 4096, 2_000_000
BLOCK_BYTES = 1 << 20
#: A word is a column of the product where its postings cost more one by one: a posting takes the
#: time of so many multiplications. Columns, documents a product takes, and products held at a time.
POSTING, COLUMNS, PRODUCT_DOCS, HELD = 800, 2048, 512, 1_500_000
#: Tasks of a pass over the shards, for each core: each returns k rows a query.
TASKS = 2


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, how often) by text and word."""
    words, owner = word_hashes([t.lower() for t in texts])
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], words[at], np.diff(np.append(at, len(words)))


def postings(documents: DataFrame) -> DataFrame:
    """doc_id, length, words and counts (packed) of every document with a word."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch["bytes"].to_pylist()]
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), BLOCK_BYTES):
                owner, word, often = bags(texts[lo:hi])
                at, first = np.unique(owner, return_index=True)
                ends = np.append(first[1:], len(owner))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].take(pa.array(at + lo)),
                        "length": pa.array([int(often[a:b].sum()) for a, b in zip(first, ends, strict=True)], pa.int64()),
                        "words": pa.array([word[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                        "counts": pa.array(
                            [often[a:b].astype(np.int32).tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()
                        ),
                    }
                )

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("bytes"))
    return rows.mapInArrow(index, f"doc_id {id_type}, length long, words binary, counts binary")


def document_frequencies(index: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = np.unique(np.frombuffer(b"".join(batch["words"].to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word), "n": pa.array(n)})

    return index.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("df"))


def weighted_queries(queries: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """query, word and weight, ordered within what is gathered later."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w, np.int64) for w in batch["words"].to_pylist()]
            counts = [np.frombuffer(c, np.int32) for c in batch["counts"].to_pylist()]
            if words:
                row = np.repeat(np.arange(len(words)), [len(w) for w in words])
                yield pa.RecordBatch.from_pydict(
                    {
                        "query": batch["row"].take(pa.array(row)),
                        "word": pa.array(np.concatenate(words)),
                        "often": pa.array(np.concatenate(counts).astype(np.int64)),
                    }
                )

    exploded = queries.select("row", "words", "counts").mapInArrow(spread, "query long, word long, often long")
    idf = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return exploded.join(frequencies, "word").select("query", "word", (F.col("often") * idf).alias("weight"))


class Shard:
    """Inverted index of some documents: per word, the postings by document, their counts and impacts."""

    def __init__(self, document: np.ndarray, often: np.ndarray, words: np.ndarray, size: np.ndarray, length: np.ndarray, mean: float):
        self.document, self.often, self.words, self.length = document, often, words, length
        self.last = np.cumsum(size, dtype=np.int64)
        self.first = self.last - size
        self.documents, self.blocks = len(length), -(-len(length) // BLOCK_DOCS)
        tf = often.astype(float)
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[document] / mean))


class Queries:
    """A block of queries: which of its words each asks for, by query and word, and their weights."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, weights: np.ndarray):
        self.ids, begin = np.unique(ids, return_index=True)
        self.begin = np.append(begin, len(ids))
        self.known, place = np.unique(words, return_inverse=True)
        self.place, self.weight = place.astype(np.int32), weights
        self.asked = np.bincount(self.place, minlength=len(self.known))
        self.owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.begin))


class Search:
    """The queries of a block in one shard."""

    def __init__(self, shard: Shard, at: np.ndarray, queries: Queries):
        """``at``: the place of each of the shard's words among the known ones."""
        self.shard, self.queries = shard, queries
        self.size = shard.last - shard.first
        self.impact = shard.impact.astype(np.float32)
        # place of every known word in the shard; after the last one, words that it has not got
        column = np.full(len(queries.known), len(at), np.int32)
        column[at] = np.arange(len(at))
        gain = self.size * queries.asked[at].astype(float) * POSTING - shard.documents * float(len(queries.ids))
        frequent = np.flatnonzero(gain > 0)
        if len(frequent) > COLUMNS:
            frequent = np.sort(frequent[np.argpartition(-gain[frequent], COLUMNS)[:COLUMNS]])
        self.product = np.full(len(at) + 1, -1, np.int32)
        self.product[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((shard.blocks * BLOCK_DOCS, len(frequent)), np.float32)
        found = ranges(shard.first[frequent], shard.last[frequent])
        self.matrix[shard.document[found], np.repeat(np.arange(len(frequent)), self.size[frequent])] = self.impact[found]
        self.most = self.matrix.reshape(shard.blocks, BLOCK_DOCS, len(frequent)).max(1)
        #: Of each query's sums in single precision, relative to them, as no term is negative.
        self.error = (np.diff(queries.begin) + 16) * 2.0**-23
        postings = np.append(self.size, 0)
        postings[frequent] = 0
        self.entries = column[queries.place]
        self.rare = postings[self.entries]
        self.forward: tuple[np.ndarray, ...] | None = None

    def groups(self) -> Iterator[tuple[int, int]]:
        """Consecutive queries whose scores and postings are held at a time."""
        sums = np.concatenate(([0], np.cumsum(self.rare)))[self.queries.begin]
        return slices(np.diff(sums) + len(self.matrix), HELD)

    def selected(self, lo: int, hi: int, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries ``lo`` to ``hi`` and documents that may score the floor or more and be among the best k."""
        count, width, error = hi - lo, len(self.matrix), self.error[lo:hi, None]
        part = slice(self.queries.begin[lo], self.queries.begin[hi])
        entry, weight, query = self.entries[part], self.queries.weight[part], self.queries.owner[part] - lo
        few = np.flatnonzero(self.rare[part])
        first, size = self.shard.first[entry[few]], self.rare[part][few]
        found = ranges(first, first + size)
        cell, value = np.repeat(query[few] * np.int64(width), size), self.impact[found]
        cell += self.shard.document[found]
        value *= np.repeat(weight[few].astype(np.float32), size)
        scores = np.zeros(count * width, np.float32)
        np.add.at(scores, cell, value)
        scores = scores.reshape(count, width)
        del found, cell, value
        column = self.product[entry]
        many = np.flatnonzero(column >= 0)
        asked = np.zeros((count, self.matrix.shape[1]), np.float32)
        asked[query[many], column[many]] = weight[many]
        bound = scores.reshape(count, self.shard.blocks, BLOCK_DOCS).max(2) + asked @ self.most.T
        floor = (floor[:, None] * (1 - error)).astype(np.float32)
        open_ = (bound >= floor * (1 - error)) & (bound > 0)
        step = PRODUCT_DOCS // BLOCK_DOCS
        for block in range(0, self.shard.blocks, step):
            rows = np.flatnonzero(open_[:, block : block + step].any(1))
            here = slice(block * BLOCK_DOCS, (block + step) * BLOCK_DOCS)
            if len(rows) == count:
                scores[:, here] += asked @ self.matrix[here].T
            elif len(rows):
                scores[rows, here] += asked[rows] @ self.matrix[here].T
        if width > k:
            crowded = np.flatnonzero((scores >= floor).sum(1) > k)
            best = np.partition(scores[crowded], width - k, axis=1)[:, width - k, None]
            floor[crowded] = np.maximum(floor[crowded], best * (1 - 2 * error[crowded]))
        hit = np.flatnonzero((scores >= floor) & (scores > 0))
        return hit // width + lo, hit % width

    def exact(self, query: int, documents: list[int]) -> np.ndarray:
        """Scores of some documents, summed by word."""
        if self.forward is None:
            order = np.argsort(self.shard.document, kind="stable")
            word = np.repeat(np.arange(len(self.size)), self.size)[order]
            edge = np.cumsum(np.bincount(self.shard.document, minlength=self.shard.documents))
            self.forward = word, self.shard.impact[order], [0, *edge.tolist()], np.zeros(len(self.size) + 1)
        word, impact, edge, weights = self.forward
        mine = slice(self.queries.begin[query], self.queries.begin[query + 1])
        weights[self.entries[mine]] = self.queries.weight[mine]
        weights[-1] = 0
        scores = np.empty(len(documents))
        for i, d in enumerate(documents):
            of = slice(edge[d], edge[d + 1])
            sums = np.cumsum(impact[of] * weights[word[of]])  # one after the other: equal texts score the same
            scores[i] = sums[-1] if len(sums) else 0.0
        weights[self.entries[mine]] = 0
        return scores


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of several half-open ranges, one range after the other."""
    size = end - begin
    start = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(begin - start, size)


def search(documents: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """query, rank, doc_id and score: the best k documents of every row that is a query."""
    spark = documents.sparkSession
    ship(spark)
    index = stage(postings(documents).withColumn("row", F.monotonically_increasing_id()))
    total, mean = index.agg(F.count("*"), F.avg("length")).first()
    every = documents.count()
    weights = stage(weighted_queries(index.filter(is_query), document_frequencies(index), every))
    # consecutive queries in blocks of a bounded number of words
    sizes = weights.groupBy("query").count()
    block = F.floor(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)) / QUERY_WORDS)
    spread = F.pmod(F.xxhash64("query"), F.lit(4096)).alias("bucket")
    blocks = sizes.groupBy(spread).agg(F.sum("count").alias("count")).withColumn("block", F.coalesce(block, F.lit(0)))
    blocks = stage(blocks.select("bucket", "block"))
    weights = weights.withColumn("bucket", spread).join(blocks, "bucket")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"query long, doc_id {id_type}, score double"
    shards = stage(index.mapInArrow(_inverter(mean), _INVERTED.format(id_type)))
    shards = shards.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    found = None
    for number in sorted(r["block"] for r in blocks.select("block").distinct().collect()):
        sent = spark.sparkContext.broadcast(_packed(weights.filter(F.col("block") == number)))
        part = stage(shards.mapInArrow(_searcher(sent, k, mean, id_type), schema))
        sent.destroy()  # the part is written
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.select(F.col("row").alias("query"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    rounded = found.withColumn("score", F.round("score", 6))
    ranked = rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = index.filter(is_query).select(F.col("row").alias("query"), F.col("doc_id").alias("asked"))
    return ranked.join(asked, "query").select(F.col("asked").alias("query"), "doc_id", "score", "rank")


def _packed(rows: DataFrame) -> Queries:
    """Queries of one block."""
    table = rows.select("query", "word", "weight").orderBy("query", "word").toArrow()
    return Queries(*(table[c].to_numpy() for c in ("query", "word", "weight")))


#: A row is a shard: its documents and their lengths; its words, their postings' number, documents and counts.
_INVERTED = "names array<{}>, length binary, words binary, size binary, document binary, often binary"


def _inverter(mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, shard in _shards(batches, None, mean):
            arrays = shard.length, shard.words, (shard.last - shard.first).astype(np.int32), shard.document, shard.often
            listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            yield pa.RecordBatch.from_arrays(
                [listed, *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                ["names", "length", "words", "size", "document", "often"],
            )

    return run


def _stored(batches: Iterator[pa.RecordBatch], known: np.ndarray, mean: float) -> Iterator[tuple[list, Shard, np.ndarray]]:
    """Stored shards, several as one, of the words that are ``known``, and the places of these."""
    kinds = {"length": np.int64, "words": np.int64, "size": np.int32, "document": np.int16, "often": np.int32}
    parts: list[tuple[np.ndarray, ...]] = []
    names: list = []
    postings = 0
    for batch in batches:
        for i in range(len(batch)):
            row = {c: np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in kinds.items()}
            at = np.minimum(np.searchsorted(known, row["words"]), len(known) - 1)
            use = np.flatnonzero(known[at] == row["words"])
            size, last = row["size"][use].astype(np.int64), np.cumsum(row["size"], dtype=np.int64)[use]
            more = int(size.sum())
            if parts and (len(names) + len(row["length"]) > SEARCH_DOCS or postings + more > SEARCH_WORDS):
                yield names, *_joined(parts, known, mean)
                parts, names, postings = [], [], 0
            found = ranges(last - size, last)
            parts.append((at[use], size, row["document"][found] + np.int16(len(names)), row["often"][found], row["length"]))
            names, postings = names + batch["names"][i].as_py(), postings + more
    if parts:
        yield names, *_joined(parts, known, mean)


def _joined(parts: list[tuple[np.ndarray, ...]], known: np.ndarray, mean: float) -> tuple[Shard, np.ndarray]:
    place, size, document, often, length = (np.concatenate(c) for c in zip(*parts, strict=True))
    if len(parts) > 1:
        order = np.argsort(place, kind="stable")
        last = np.cumsum(size)[order]
        found = ranges(last - size[order], last)
        document, often, place = document[found], often[found], place[order]
        size = np.add.reduceat(size[order], np.unique(place, return_index=True)[1]) if len(place) else size
        place = np.unique(place)
    return Shard(document, often, known[place], size, length, mean), place


def _searcher(sent, k: int, mean: float, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best: list[list[tuple[float, bool, object]]] = [[] for _ in queries.ids]
        floor = np.zeros(len(best))
        for names, shard, at in _stored(batches, queries.known, mean):
            search = Search(shard, at, queries)
            for lo, hi in search.groups():
                query, document = search.selected(lo, hi, k, floor[lo:hi])
                at, first = np.unique(query, return_index=True)
                for q, hits in zip(at.tolist(), np.split(document, first[1:]), strict=False):
                    score = search.exact(q, hits.tolist())
                    if len(score) > k:
                        keep = score >= np.partition(score, -k)[-k]
                        hits, score = hits[keep], score[keep]
                    new = [(s, names[d] is None, names[d]) for d, s in zip(hits.tolist(), score.tolist(), strict=True) if s >= floor[q]]
                    if new:
                        best[q] = sorted(best[q] + new, key=lambda r: (-r[0], r[1], r[2] or 0))[:k]
                    if len(best[q]) == k:
                        floor[q] = best[q][-1][0]
        rows = [(i, r[2], r[0]) for i, found in zip(queries.ids.tolist(), best, strict=True) for r in found]
        query, doc, score = zip(*rows, strict=True) if rows else ([], [], [])
        kind = pa.int64() if id_type == "bigint" else None
        yield pa.RecordBatch.from_pydict(
            {"query": pa.array(query, pa.int64()), "doc_id": pa.array(doc, kind), "score": pa.array(score, pa.float64())}
        )

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The consecutive documents of each shard, bounded by their number and their postings."""
    parts: list[pa.RecordBatch] = []
    documents = postings = 0
    for batch in batches:
        size = pc.binary_length(batch["words"]).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        for lo, hi in slices(np.maximum(size, SHARD_WORDS // SHARD_DOCS), SHARD_WORDS // 4):
            more = int(size[lo:hi].sum())
            if parts and (documents + hi - lo > SHARD_DOCS or postings + more > SHARD_WORDS):
                yield parts
                parts, documents, postings = [], 0, 0
            parts.append(batch.slice(lo, hi - lo))
            documents, postings = documents + hi - lo, postings + more
    if parts:
        yield parts


def _shards(batches: Iterator[pa.RecordBatch], known: np.ndarray | None, mean: float) -> Iterator[tuple[pa.Array, Shard]]:
    for parts in _parts(batches):
        yield pa.concat_arrays([p["doc_id"] for p in parts]), _shard(parts, known, mean)


def _shard(parts: list[pa.RecordBatch], known: np.ndarray | None, mean: float) -> Shard:
    """The index of the words that are ``known``, or of all. Its raw postings end with the call."""
    words = [np.frombuffer(w, np.int64) for p in parts for w in p["words"].to_pylist()]
    size = np.array([len(w) for w in words])
    word = np.concatenate(words)
    del words
    document = np.repeat(np.arange(len(size), dtype=np.int16), size)
    often = np.concatenate([np.frombuffer(c, np.int32) for p in parts for c in p["counts"].to_pylist()])
    if known is not None:
        place = np.minimum(np.searchsorted(known, word), len(known) - 1)
        use = np.flatnonzero(known[place] == word)
        del place
        word, document, often = word[use], document[use], often[use]
    order = np.argsort(word, kind="stable")  # postings come by document
    words, size = np.unique(word, return_counts=True)
    length = np.concatenate([p["length"].to_numpy() for p in parts])
    return Shard(document[order], often[order], words, size, length, mean)
