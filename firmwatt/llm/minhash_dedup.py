"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words: term frequency times an
inverse document frequency. Each of K samples draws one (shingle, level) per document by
improved consistent weighted sampling, so that two documents draw the same with the
probability of their weighted Jaccard similarity. Samples are banded; documents that agree
in a band are compared, and links of 0.8 or more form the classes.

Inverse document frequency. With n of N distinct texts holding a shingle, idf = ln(1 + N / n),
without any floor or cut. Every shingle is counted, exactly: blocks of about ``BLOCK_BYTES`` of
text send their different shingles, with the number of texts that hold each, to parts by ranges
of the shingle's hash; a part adds them up and sends what more than one text holds back to the
blocks that hold it, and a block meets its texts again where they are sampled. A frequent shingle
is one entry per block, and no table of shingles is held by the driver or by all workers.

The exact check that follows compares the shingles with their term frequencies alone: 0.8 is a
share of the two texts, whatever else the corpus holds. Were it weighted as well, the words that
were edited in one of many copies would outweigh all that is equal (a frequent passage is light,
an edit is heavy), and a group of copies would hide its members from each other.

No link is lost to large groups. Equal texts are one node. In a bucket, every node is first
compared with its head, the node that shares most buckets with others: in a group of edited
copies that is the one with the fewest edits; and with the head of its head, which finds it for
copies that share a bucket with other copies only. Links give classes. Where a bucket still holds
several classes, the rest is compared in blocks: the nodes of a head are dealt over blocks of
about ``CELL_BYTES`` of text, a task takes two blocks and multiplies their shingle matrices,
and only links between different classes leave it. Blocks of the head's own class don't meet
each other, so a group of copies costs one comparison per node.

Defined cases: a text of one to four words is one shingle of all its words; a text without
words, or null, is never a near-duplicate and is a class of its own; rows with equal texts
share a class; classes are named by their smallest doc_id, null only if all are null; a null
doc_id is a member like any other. An empty table gives no rows. Words are compared as they
stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmwatt.llm.common import mix64, ship, slices, stage, word_hashes
from firmwatt.sources.sinks import Stages

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 4
#: A block of a cell holds at most so much text and, on average, so many texts.
CELL_BYTES, CELL_TEXTS = 256 << 10, 500
BLOCK_BYTES = 1 << 20
#: The shingles of about so much text are counted by one task.
COUNTED_BYTES = 16 << 20


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, how often) of several texts, ordered by text and shingle."""
    hashes, text = word_hashes(texts)
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for k in range(1, words):
            rolled[:-k] = rolled[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
    position = np.arange(len(hashes)) - first[text] if len(hashes) else np.empty(0, np.int64)
    full = position + words <= n[text]
    if words > 1 and len(hashes):
        for t in np.flatnonzero((n > 0) & (n < words)):
            value = np.uint64(n[t])
            with np.errstate(over="ignore"):
                for h in hashes[first[t] : first[t] + n[t]]:
                    value = value * np.uint64(0x9E3779B97F4A7C15) + h
            rolled[first[t]], full[first[t]] = value, True
    value, owner = mix64(rolled[full]), text[full]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


class Weights:
    """TF-IDF weights; holds how many of ``texts`` distinct texts hold each shingle.

    A shingle that is not named stands in one text.
    """

    def __init__(self, shingle: np.ndarray, held: np.ndarray, texts: int = 1):
        order = np.argsort(shingle)
        self.shingle, self.held, self.texts = shingle[order], held[order], texts

    def __call__(self, value: np.ndarray, often: np.ndarray) -> np.ndarray:
        held = np.ones(len(value))
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, value), len(self.shingle) - 1)
            known = self.shingle[at] == value
            held[known] = self.held[at[known]]
        return often * np.log1p(self.texts / held)


#: All shingles count alike, as often as they occur.
EVEN = Weights(np.empty(0, np.uint64), np.empty(0))


class Sampler:
    """Improved consistent weighted sampling with tabled quantiles.

    The random numbers of a shingle come from its hash: r and c follow Gamma(2, 1), read
    from a table of 65,536 quantiles, beta is uniform.
    """

    def __init__(self, samples: int):
        rng = np.random.default_rng(7)
        self.seeds = rng.integers(1, 2**63, samples, dtype=np.uint64)
        grid = np.linspace(1e-9, 40, 1 << 20)
        below = 1 - np.exp(-grid) * (1 + grid)
        quantile = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), below, grid)
        self.gamma, self.log_gamma = quantile.astype(np.float32), np.log(quantile).astype(np.float32)

    def __call__(self, owner: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """One 64-bit draw per text and sample; texts without shingles draw 0.

        The rows are ordered by text; the arrays are worked on in pieces of whole texts
        that stay in the processor's cache.
        """
        out = np.zeros((texts, len(self.seeds)), np.uint64)
        if not len(value):
            return out
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        log_weight = np.log(weight).astype(np.float32)
        length = np.diff(np.append(begin, len(value)))
        for first, last in slices(length, 1 << 15):
            lo, hi = begin[first], begin[last - 1] + length[last - 1]
            at, who = begin[first:last] - lo, owner[begin[first:last]]
            out[who] = self._draw(value[lo:hi], log_weight[lo:hi], at, length[first:last])
        return out

    def _draw(self, value: np.ndarray, log_weight: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        drawn = np.empty((len(at), len(self.seeds)), np.uint64)
        rows = np.arange(len(value))
        low16 = np.uint64(0xFFFF)
        with np.errstate(over="ignore"):
            for k, seed in enumerate(self.seeds):
                z = (value ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(29)
                z *= np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(32)
                r = self.gamma[(z & low16).view(np.int64)]
                beta = ((z >> np.uint64(32)) & low16).astype(np.float32) * np.float32(1 / 65536)
                level = np.floor(log_weight / r + beta)
                score = self.log_gamma[((z >> np.uint64(16)) & low16).view(np.int64)] - r * (level - beta + 1)
                least = np.minimum.reduceat(score, at)
                hit = np.where(score == np.repeat(least, length), rows, len(rows))
                best = np.minimum.reduceat(hit, at)
                drawn[:, k] = mix64(value[best] + mix64(level[best].astype(np.int64).view(np.uint64) + seed))
        return drawn


@lru_cache(1)
def sampler_of(samples: int) -> Sampler:
    """One sampler per worker."""
    return Sampler(samples)


def bands(draws: np.ndarray, band_rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket per text and band."""
    out = np.zeros((len(draws), draws.shape[1] // band_rows), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(out.shape[1]):
            value = np.full(len(draws), b + 1, np.uint64)
            for k in range(band_rows):
                value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + draws[:, b * band_rows + k])
            out[:, b] = value
    return out.view(np.int64)


def similarity(a: bytes, b: bytes, weights: Weights) -> float:
    """Weighted Jaccard similarity of two texts: sum of the smaller over sum of the larger weights."""
    owner, value, often = shingles([a, b])
    weight = weights(value, often)
    _, number = np.unique(value, return_inverse=True)
    both = np.zeros((2, number.max(initial=-1) + 1))
    both[owner, number] = weight
    total = np.maximum(both[0], both[1]).sum()
    return float(np.minimum(both[0], both[1]).sum() / total) if total else 0.0


# --- Spark ---------------------------------------------------------------------------


def _texts(documents: DataFrame) -> DataFrame:
    binary = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return documents.select("doc_id", binary.alias("bytes"), F.md5(binary).alias("node"))


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of record batches with a bounded number of bytes, and their texts."""
    for batch in batches:
        texts = batch[column].to_pylist()
        for lo, hi in slices(np.array([len(t) for t in texts], np.int64), BLOCK_BYTES):
            yield batch.slice(lo, hi - lo), texts[lo:hi]


def _in_blocks(texts: DataFrame) -> DataFrame:
    """The different texts: node, bytes and the block that a text is in."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _blocks(batches, "bytes"):
            block = int(batch["node"][0].as_py()[:15], 16)
            yield batch.append_column("block", pa.array([block] * len(texts), pa.int64()))

    distinct = texts.select("node", "bytes").dropDuplicates(["node"])
    return distinct.mapInArrow(number, "node string, bytes binary, block long")


def _packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as the bytes of their steps, the highest bytes first: mostly 0."""
    steps = np.diff(values, prepend=np.uint64(0)).astype(">u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(">u8")
    return np.cumsum(steps.ravel().astype(np.uint64), dtype=np.uint64)


def shingle_counts(distinct: DataFrame, size: int) -> DataFrame:
    """block, shingles, held: what more than one text holds, for each block that holds it.

    ``held`` says how many of the texts hold each of the shingles; a block has several rows.
    The texts have ``size`` bytes together.
    """
    parts = max(1, -(-size // COUNTED_BYTES))
    edges = np.array([(k << 64) // parts for k in range(parts)], np.uint64)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, texts = batch["block"].to_numpy(), batch["bytes"]
            begin = np.flatnonzero(np.concatenate(([len(block) > 0], block[1:] != block[:-1])))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(block)], strict=True):
                value, count = np.unique(shingles(texts.slice(lo, hi - lo).to_pylist())[1], return_counts=True)
                at = np.append(np.searchsorted(value, edges), len(value))
                there = np.flatnonzero(np.diff(at))
                spans = [slice(at[k], at[k + 1]) for k in there]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(there, pa.int32()),
                        "block": pa.array([block[lo]] * len(there), pa.int64()),
                        "shingles": pa.array([_packed(value[k]) for k in spans], pa.binary()),
                        "held": pa.array([count[k].astype("<i4").tobytes() for k in spans], pa.binary()),
                    }
                )

    def add(group: pa.Table) -> pa.Table:
        parts = [_unpacked(p.as_py()) for p in group["shingles"]]
        value = np.concatenate(parts)
        held = np.concatenate([np.frombuffer(h.as_py(), "<i4") for h in group["held"]])
        order = np.argsort(value, kind="stable")
        value, held = value[order], held[order]
        begin = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        total, value = np.add.reduceat(held, begin, dtype=np.int64), value[begin]
        value, total = value[total > 1], total[total > 1]
        blocks, shared, often = [], [], []
        for block, part in zip(group["block"].to_pylist(), parts, strict=True):
            at = np.searchsorted(value, part)
            at = at[(at < len(value)) & (value[np.minimum(at, len(value) - 1)] == part)] if len(value) else at[:0]
            if len(at):
                blocks.append(block)
                shared.append(_packed(value[at]))
                often.append(total[at].astype("<i8").tobytes())
        return pa.table(
            {"block": pa.array(blocks, pa.int64()), "shingles": pa.array(shared, pa.binary()), "held": pa.array(often, pa.binary())}
        )

    rows = distinct.select("bytes", "block").mapInArrow(named, "part int, block long, shingles binary, held binary")
    return rows.groupBy("part").applyInArrow(add, "block long, shingles binary, held binary")


def signatures(distinct: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """node, whether it has a word, and its buckets, of every different text."""

    def sign(texts: pa.Table, held: pa.Table) -> pa.Table:
        shared = np.concatenate([np.empty(0, np.uint64), *[_unpacked(s.as_py()) for s in held["shingles"]]])
        often = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(h.as_py(), "<i8") for h in held["held"]]])
        weights, sampler, parts = Weights(shared, often, total), sampler_of(BANDS * ROWS), []
        for batch, block in _blocks(texts.to_batches(), "bytes"):
            owner, value, often = shingles(block)
            buckets = bands(sampler(owner, value, weights(value, often), len(block)))
            worded = np.bincount(owner, minlength=len(block)) > 0
            flat = pa.array(buckets.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
            parts.append(pa.RecordBatch.from_pydict({"node": batch["node"], "worded": pa.array(worded), "buckets": lists}))
        schema = pa.schema([("node", pa.string()), ("worded", pa.bool_()), ("buckets", pa.list_(pa.int64()))])
        return pa.Table.from_batches(parts, schema)

    schema = "node string, worded boolean, buckets array<long>"
    return distinct.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(sign, schema)


def compared(pairs: DataFrame, texts: DataFrame, weights: Weights = EVEN) -> DataFrame:
    """The pairs of nodes (a, b) with their weighted Jaccard similarity."""

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([similarity(a, b, weights) for a, b in zip(left, right, strict=True)], dtype=float)

    left = texts.select(F.col("node").alias("a"), F.col("bytes").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("bytes").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", alike("left", "right").alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node that it is linked with, directly or by others.

    Alternating large-star and small-star steps; the number of rounds grows with the
    logarithm of the longest chain. Every round is a table of its own.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        around = links.union(links.select("b", "a")) if large else links
        around = around.toDF("a", "b")
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = around.join(least, "a")
        if large:
            return moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)

    # an edge goes from the larger node to the smaller one
    links = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    )
    before = None
    while True:
        links = stage(star(star(links, True).filter("a != b").distinct(), False).filter("a != b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now


def classes(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), the class's
    number of documents, and whether it is the one that stays."""
    return _classes(documents, least).select("doc_id", "class_id", "class_size", "stays")


def _classes(documents: DataFrame, least: float) -> DataFrame:
    spark: SparkSession = documents.sparkSession
    ship(spark)
    texts = _texts(documents)
    distinct = stage(_in_blocks(texts))
    with Stages(spark) as counting:
        total, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()
        counts = stage(shingle_counts(distinct, size))
    signed = stage(signatures(distinct, counts, total))
    counting.release()
    nodes = signed.filter("worded").select("node", "buckets")
    buckets = nodes.select("node", F.posexplode("buckets").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").count().filter("count > 1")
    shared = stage(buckets.join(shared, ["band", "bucket"]))
    central = shared.groupBy("node").agg(F.sum("count").alias("score"))
    shared = shared.select("node", "band", "bucket").join(central, "node")
    head = F.max(F.struct("score", "node"))["node"].alias("head")
    heads = shared.groupBy("band", "bucket").agg(head)
    members = stage(shared.join(heads, ["band", "bucket"]).select("node", "band", "bucket", "head"))
    in_buckets = stage(distinct.join(members.select("node").distinct(), "node", "left_semi"))
    pairs = _pairs(members, "head").union(_pairs(_heads_of_heads(members, central), "top")).distinct()
    done = stage(compared(pairs, in_buckets))
    found = components(done.filter(F.col("similarity") >= least))
    more = stage(_between_classes(_open_members(members, found), in_buckets, EVEN, least))
    if more.limit(1).count():
        found = components(done.filter(F.col("similarity") >= least).select("a", "b").unionByName(more))
    return _named(texts.select("doc_id", "node"), signed.filter("not worded").select("node"), found)


def _heads_of_heads(members: DataFrame, central: DataFrame) -> DataFrame:
    """Every node with the best head of each of its heads (``top``)."""
    under = members.select("node", "head").distinct()
    scored = under.join(central.select(F.col("node").alias("head"), "score"), "head")
    best = scored.groupBy(F.col("node").alias("head")).agg(F.max(F.struct("score", "head"))["head"].alias("top"))
    return under.join(best.filter("head != top"), "head").select("node", "top")


def _pairs(rows: DataFrame, other: str) -> DataFrame:
    """Different unordered pairs (a, b) of a node and the column ``other``."""
    rows = rows.filter(F.col("node") != F.col(other))
    return rows.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def _open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with their classes, of the buckets that hold several classes."""
    labelled = members.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("band", "bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = mixed.filter("lo != hi").select("band", "bucket")
    return stage(labelled.join(mixed, ["band", "bucket"], "left_semi"))


def linked(texts: list[bytes], labels: list[str], weights: Weights, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts with different labels and a weighted Jaccard similarity of ``least`` or more.

    The n-th repeat of a shingle is a column of its own, so the smaller of two term
    frequencies is a sum of products, and one matrix product gives all sums of minima.
    """
    owner, value, often = shingles(texts)
    weight = weights(value, np.ones(len(value)))
    nth = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
    with np.errstate(over="ignore"):
        column = mix64(np.repeat(value, often) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row, weight = np.repeat(owner, often), np.repeat(weight, often)
    total = np.bincount(row, weight, len(texts))
    _, number, count = np.unique(column, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    _, number = np.unique(number[shared], return_inverse=True)
    row, weight = row[shared], weight[shared]
    order = np.argsort(number, kind="stable")
    row, number, weight = row[order], number[order], weight[order]
    both = np.zeros((len(texts), len(texts)))
    width = 4096
    for lo in range(0, int(number.max(initial=-1)) + 1, width):
        part = slice(*np.searchsorted(number, (lo, lo + width)))
        dense = np.zeros((len(texts), width))
        dense[row[part], number[part] - lo] = np.sqrt(weight[part])
        both += dense @ dense.T
    union = total[:, None] + total[None, :] - both
    _, kind = np.unique(np.array(labels, dtype=object), return_inverse=True)
    link = (both >= (least - 1e-9) * union) & (union > 0) & (kind[:, None] != kind[None, :])
    return np.nonzero(np.triu(link, 1))


def _between_classes(open_: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Links (a, b) between different classes of nodes with the same head."""
    nodes = open_.select("head", "node", "label").distinct()
    of_head = nodes.filter("node = head").select("head", F.col("label").alias("head_label"))
    sized = texts.select("node", F.length("bytes").alias("size"))
    nodes = nodes.join(of_head, "head", "left").join(sized, "node")
    nodes = stage(nodes.withColumn("main", F.col("label").eqNullSafe(F.col("head_label"))))

    def blocks(main: bool) -> Column:
        """By bytes and by texts: a cell compares its texts by matrices of texts by texts."""
        mine = F.col("main") == main
        by_size = F.ceil(F.sum(F.when(mine, F.col("size")).otherwise(0)) / CELL_BYTES)
        return F.greatest(by_size, F.ceil(F.count_if(mine) / CELL_TEXTS))

    counts = nodes.groupBy("head").agg(blocks(True).alias("mains"), blocks(False).alias("others"))
    counts = counts.filter("others > 0")
    dealt = nodes.join(counts, "head")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others")))
    dealt = dealt.withColumn("mine", mine)
    others = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    mains = F.when(F.col("mains") > 0, F.sequence(F.lit(0).cast("long"), F.col("mains") - 1)).otherwise(F.array().cast("array<bigint>"))
    # a cell is (block of the head's class or -1, block of the others, block of the others)
    with_main = F.transform(others, lambda r: F.struct(F.col("mine").alias("m"), r.alias("r"), r.alias("s")))
    with_other = F.concat(
        F.transform(mains, lambda m: F.struct(m.alias("m"), F.col("mine").alias("r"), F.col("mine").alias("s"))),
        F.transform(
            others,
            lambda r: F.struct(
                F.lit(-1).cast("long").alias("m"), F.least(r, F.col("mine")).alias("r"), F.greatest(r, F.col("mine")).alias("s")
            ),
        ),
    )
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("main"), with_main).otherwise(with_other)))
    filled = cells.select("head", "cell.m", "cell.r", "cell.s", "node", "label").join(texts, "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        a, b = linked(group["bytes"].to_pylist(), group["label"].to_pylist(), weights, least)
        return pa.table({"a": group["node"].take(pa.array(a)), "b": group["node"].take(pa.array(b))})

    return filled.groupBy("head", "m", "r", "s").applyInArrow(compare, "a string, b string").distinct()


def _named(rows: DataFrame, empty: DataFrame, found: DataFrame) -> DataFrame:
    """Classes of rows: equal texts and linked ones; rows without words stand alone."""
    known = found.select("node", "label", F.lit(True).alias("worded")).unionByName(
        empty.select("node", F.lit(None).cast("string").alias("label"), F.lit(False).alias("worded"))
    )
    rows = rows.join(known, "node", "left").withColumn("worded", F.coalesce("worded", F.lit(True)))
    label = F.when(F.col("worded"), F.coalesce("label", "node"))
    rows = rows.withColumn("label", label)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    sizes = rows.filter("worded").groupBy("label").agg(F.min(order).alias("keeper"), F.count("*").alias("class_size"))
    joined = rows.join(sizes, "label", "left")
    return joined.select(
        "doc_id",
        "node",
        F.when(F.col("worded"), F.col("keeper.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (~F.col("worded") | order.eqNullSafe(F.col("keeper"))).alias("stays"),
    )


def keep_one(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents that stay, with all their columns: of each class the one with the
    smallest doc_id (of equal rows one), and every document without words.

    Only the ids of the rows to drop are joined, not the ids of those that stay.
    """
    found = stage(_classes(documents, least))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    binary = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = documents.select(F.struct(*columns).alias("doc"), F.col("doc_id").alias("k_doc"), F.md5(binary).alias("k_node"))
    gone = found.filter(~F.col("stays")).select("doc_id", "node").distinct()
    kept = rows.join(gone, F.col("k_doc").eqNullSafe(F.col("doc_id")) & (F.col("k_node") == F.col("node")), "left_anti")
    # rows that share the doc_id and the text of the one that stays
    twice = found.filter("stays and class_size > 1").groupBy("doc_id", "node").count().filter("count > 1")
    if not twice.limit(1).count():
        return kept.select("doc.*")
    named = twice.select("doc_id", "node")
    same = F.col("k_doc").eqNullSafe(F.col("doc_id")) & (F.col("k_node") == F.col("node"))
    single = kept.join(named, same, "left_semi").groupBy("k_doc", "k_node").agg(F.first("doc").alias("doc"))
    return kept.join(named, same, "left_anti").select("doc.*").union(single.select("doc.*"))
