"""Repeated passages by suffix order: every 400-byte string that starts more than once.

Exact for every pair of places, in one document or in two. The work is dealt out by
content, so that equal passages meet without any pair being formed:

1. *Anchors.* Every 400-byte window names the smallest hash among its 64-byte strings, the
   leftmost on ties. That depends on the window's bytes alone, so equal windows name equal
   anchors. Consecutive windows with the same anchor form a block; one row per block, about
   one per 170 bytes. An anchor that occurs once has no equal window anywhere: it goes.
2. *Equal blocks.* Blocks of an anchor with the same content hash are repeated as a whole.
3. *Unequal blocks of one anchor* may still share windows. Of each different block one text
   is fetched, and groups of a bounded number of blocks get a suffix array with the longest
   previous factor of each position, from the previous and next smaller positions in suffix
   order. A factor of 400 or more says that the window stands earlier in the corpus.
4. An anchor with more than ``GROUP_BLOCKS`` different blocks or more than ``ANCHOR_BYTES`` of
   them (a passage in very many surroundings) would not fit one group; the windows of its
   blocks are counted by hash instead, which spreads over all tasks and gives the same answer.

The spans found are joined to their documents once, and the bytes are cut out.

``symbol`` says what a text is a row of: ``BYTE``, as above, or ``WORD``. For words every
number above is one of words (anchors of ``GRAM_WORDS`` words), a word is the 64-bit hash of
its bytes, white space is not compared, and a span is cut from the first byte of its first
word to the last byte of its last one.

``keep`` says what goes: 'none' removes every copy, 'first' keeps the first of the corpus
(by doc_id, then by a hash of the text, then by position).

Defined cases: a null text counts as empty; texts below 400 bytes never lose a byte; equal
rows, with the same doc_id and text, are copies of each other under 'none' and one document
under 'first'; a null doc_id is a value like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt.llm.common import mix64, powers, ship, slices, stage, word_edges, word_hashes

LENGTH = 400
GRAM = 64
GRAM_WORDS = 10
BYTE, WORD = np.dtype(np.uint8), np.dtype("<u8")
GROUP_BLOCKS = 8000
#: A group holds so many bytes on average, and those of one anchor beside them; a suffix
#: order takes about 70 times its symbols.
GROUP_BYTES, ANCHOR_BYTES = 1 << 18, 1 << 22
#: A key with more than one in so many rows is joined by broadcast.
HOT_KEYS = 1000
SEGMENT = 1 << 18
#: Blocks are given on after so many bytes of texts.
PART_BYTES = 1 << 20

_POSITION = np.uint64((1 << 20) - 1)


def window_blocks(
    text: bytes, length: int = LENGTH, gram: int = GRAM, symbol: np.dtype = BYTE
) -> Iterator[tuple[int, int, int, int]]:
    """Blocks of windows with a common anchor: anchor hash, content hash, first start, windows."""
    size = symbol.itemsize
    windows, width = len(text) // size - length + 1, length - gram + 1
    for first in range(0, max(windows, 0), SEGMENT):
        many = min(SEGMENT, windows - first)
        part = np.frombuffer(text, symbol, many + length - 1, first * size)
        hashes = gram_hashes(part, gram)
        keys = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < width:
            keys = np.minimum(keys[: len(keys) - (width - span)], keys[width - span :])
        anchor = (keys & _POSITION).astype(np.int64)
        begin = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        count = np.diff(np.append(begin, many))
        minimum = hashes[anchor[begin]].view(np.int64)
        for a, b, n in zip(minimum.tolist(), begin.tolist(), count.tolist(), strict=True):
            content = xxhash.xxh3_64_intdigest(text[(first + b) * size : (first + b + n + length - 1) * size])
            yield a, content - (1 << 63), first + b, n


def gram_hashes(part: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every string of ``gram`` symbols, by running sums."""
    up, down = powers(len(part))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        grams = len(part) - gram + 1
        return mix64((sums[gram:] - sums[:grams]) * down[:grams])


class SuffixOrder:
    """Suffixes of a row of symbols in the order of their first 512, by prefix doubling."""

    LEVELS = 9
    #: Suffixes that are compared at once.
    TOGETHER = 1 << 15

    def __init__(self, symbols: np.ndarray):
        n, rank = len(symbols), symbols.astype(np.int32)
        self.ranks, self.n = [rank], n
        for level in range(self.LEVELS):
            h = 1 << level
            key = rank * np.int64(int(rank.max(initial=0)) + 1)
            key[: max(n - h, 0)] += rank[h:]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32)
            self.ranks.append(rank)
        self.order = np.argsort(rank, kind="stable") if n else np.empty(0, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to 512; -1 stands for no suffix."""
        out = np.zeros(len(a), np.int64)
        for at in range(0, len(a), self.TOGETHER):
            part = slice(at, at + self.TOGETHER)
            out[part] = self._common(a[part], b[part])
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        there = (a >= 0) & (b >= 0)
        whole = there.copy()
        whole[there] = self.ranks[-1][a[there]] == self.ranks[-1][b[there]]
        out[whole] = 1 << self.LEVELS
        left = there & ~whole
        for level in range(self.LEVELS - 1, -1, -1):
            i, j = a[left] + out[left], b[left] + out[left]
            inside = (i < self.n) & (j < self.n)
            same = np.zeros(len(i), bool)
            same[inside] = self.ranks[level][i[inside]] == self.ranks[level][j[inside]]
            out[left] += np.where(same, 1 << level, 0)
        return out

    def longest_previous_factor(self) -> np.ndarray:
        """Per position, the longest prefix that also starts at a smaller position."""
        out = np.zeros(self.n, np.int64)
        for smaller in (nearest_smaller(self.order), _mirrored(self.order)):
            other = np.where(smaller >= 0, self.order[smaller], -1)
            np.maximum.at(out, self.order, self.common(self.order, other))
        return out

    def longest_other_factor(self) -> np.ndarray:
        """Per position, the longest prefix that also starts at any other position."""
        next_to = np.zeros(self.n + 1, np.int64)
        next_to[1:-1] = self.common(self.order[:-1], self.order[1:]) if self.n > 1 else 0
        out = np.zeros(self.n, np.int64)
        out[self.order] = np.maximum(next_to[:-1], next_to[1:])
        return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, -1 for none; by pointer jumping."""
    pointer = np.arange(len(values)) - 1
    open_ = np.flatnonzero(pointer >= 0)
    while len(open_):
        open_ = open_[values[pointer[open_]] > values[open_]]
        pointer[open_] = pointer[pointer[open_]]
        open_ = open_[pointer[open_] >= 0]
    return pointer


def _mirrored(values: np.ndarray) -> np.ndarray:
    found = nearest_smaller(values[::-1])[::-1]
    return np.where(found >= 0, len(values) - 1 - found, -1)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def shared_windows(blocks: list[bytes], length: int, keep: str, symbol: np.dtype = BYTE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block, the runs of window starts that stand in another place (or an earlier one).

    The blocks come in the order of the corpus. Symbol 0, which is no byte and no word, ends
    each block; no window of a block holds it.
    """
    blocks = _numbered(blocks, symbol)
    symbols = np.zeros(sum(len(b) + 1 for b in blocks), np.int64)
    at = 0
    for block in blocks:
        symbols[at : at + len(block)] = block
        at += len(block) + 1
    order = SuffixOrder(symbols)
    factor = order.longest_previous_factor() if keep == "first" else order.longest_other_factor()
    out, at = [], 0
    for block in blocks:
        out.append(runs(factor[at : at + len(block) - length + 1] >= length))
        at += len(block) + 1
    return out


def _numbered(blocks: list[bytes], symbol: np.dtype) -> list[np.ndarray]:
    """The symbols of each block as small numbers from 1 on."""
    if symbol == BYTE:
        return [np.frombuffer(b, BYTE).astype(np.int64) + 1 for b in blocks]
    _, number = np.unique(np.frombuffer(b"".join(blocks), symbol), return_inverse=True)
    return np.split(number + 1, np.cumsum([len(b) // symbol.itemsize for b in blocks])[:-1])


# --- Spark ---------------------------------------------------------------------------

_KEY = ("doc_id", "text_hash")


def _keyed(documents: DataFrame) -> DataFrame:
    binary = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return documents.select("doc_id", binary.alias("bytes")).withColumn("text_hash", F.xxhash64("bytes"))


def _words(keyed: DataFrame) -> DataFrame:
    """The keys, with the hashes of the words of each text for its bytes."""

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([word_hashes([t])[0].astype(WORD).tobytes() for t in texts], dtype=object)

    return keyed.select(*_KEY, hashed("bytes").alias("bytes"))


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["r_doc_id"]) & (left["text_hash"] == right["r_text_hash"])


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc_id", "r_doc_id").withColumnRenamed("text_hash", "r_text_hash")


def _joined(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join of rows with a table of one row per key; column ``size`` counts the key's rows.

    A key with more than a thousandth of all rows would fill one task. Fewer than a thousand
    keys can be that frequent, whatever the data, so these are broadcast and their rows stay
    where they are; only the others are shuffled.
    """
    most = rows.count() / HOT_KEYS
    hot = F.broadcast(groups.filter(F.col(size) > most))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(groups.filter(F.col(size) <= most), on))


def _blocks(keyed: DataFrame, length: int, symbol: np.dtype) -> DataFrame:
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    gram = GRAM if symbol == BYTE else GRAM_WORDS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch["bytes"]).to_numpy().astype(np.int64)
            for lo, hi in slices(sizes, PART_BYTES):
                yield found_in(batch.slice(lo, hi - lo))

    def found_in(part: pa.RecordBatch) -> pa.RecordBatch:
        row, found = [], []
        for number, text in enumerate(part["bytes"]):
            here = list(window_blocks(text.as_py(), length, gram, symbol))
            found += here
            row += [number] * len(here)
        take = pa.array(row, pa.int64())
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_pydict(
            {name: part[name].take(take) for name in _KEY}
            | {n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "content", "start", "n"), columns, strict=True)}
        )

    return keyed.select("doc_id", "text_hash", "bytes").mapInArrow(
        cut, f"doc_id {id_type}, text_hash long, anchor long, content long, start long, n long"
    )


def repeated_spans(
    keyed: DataFrame, length: int, keep: str, group_blocks: int, symbol: np.dtype = BYTE, anchor_bytes: int = ANCHOR_BYTES
) -> DataFrame:
    """Spans to remove: doc_id, text_hash, begin, end, in symbols; they may overlap."""
    if symbol == WORD:
        keyed = stage(_words(keyed))
    blocks = stage(_blocks(keyed, length, symbol))
    often = stage(blocks.groupBy("anchor").agg(F.count("*").alias("rows")).filter("rows > 1"))
    blocks = stage(_joined(blocks, often, ["anchor"], "rows").drop("rows"))
    kinds = stage(
        blocks.groupBy("anchor", "content").agg(
            F.count("*").alias("copies"),
            F.min(F.struct("doc_id", "text_hash", "start")).alias("first"),
            F.min("n").alias("n"),
        )
    )
    size = symbol.itemsize
    twice = kinds.filter("copies > 1").select("anchor", "content", "first", "copies")
    whole = _joined(blocks, twice, ["anchor", "content"], "copies")
    if keep == "first":
        here = F.struct("doc_id", "text_hash", "start")
        whole = whole.filter(~here.eqNullSafe(F.col("first")))
    spans = whole.select(*_KEY, F.col("start").alias("begin"), (F.col("start") + F.col("n") + length - 1).alias("end"))

    several = kinds.groupBy("anchor").agg(
        F.count("*").alias("kinds"),
        F.min("copies").alias("fewest"),
        (F.sum(F.col("n") + length - 1) * size).alias("bytes"),
    )
    # under 'none' an anchor whose blocks are all repeated as a whole is settled
    several = several.filter("kinds > 1" if keep == "first" else "kinds > 1 and fewest = 1")
    several = several.select("anchor", "kinds", ((F.col("kinds") <= group_blocks) & (F.col("bytes") <= anchor_bytes)).alias("fits"))
    texts = stage(_block_texts(keyed, _joined(kinds, stage(several), ["anchor"], "kinds"), length, symbol))
    small, large = texts.filter("fits"), texts.filter("not fits")
    parts = spans.unionByName(_by_suffix_order(small, length, keep, symbol))
    if large.limit(1).count():
        parts = parts.unionByName(_by_window_hash(large, length, keep, symbol))
    return parts


def _block_texts(keyed: DataFrame, kinds: DataFrame, length: int, symbol: np.dtype) -> DataFrame:
    """The bytes of the first block of each kind, cut from its document."""
    wanted = kinds.groupBy(F.col("first.doc_id").alias("r_doc_id"), F.col("first.text_hash").alias("r_text_hash")).agg(
        F.collect_list(F.struct("anchor", "content", "copies", "fits", F.col("first.start").alias("start"), "n")).alias("b")
    )
    joined = keyed.join(wanted, _same_key(keyed, wanted))
    size = symbol.itemsize
    cut = F.transform(
        "b",
        lambda x: F.struct(
            *[x[name].alias(name) for name in ("anchor", "content", "copies", "fits", "start")],
            F.substr(F.col("bytes"), (x["start"] * size + 1).cast("int"), ((x["n"] + length - 1) * size).cast("int")).alias("block"),
        ),
    )
    return joined.select(*_KEY, F.explode(cut).alias("x")).select(*_KEY, "x.*").dropDuplicates([*_KEY, "start"])


def _by_suffix_order(texts: DataFrame, length: int, keep: str, symbol: np.dtype) -> DataFrame:
    size = texts.agg(F.sum(F.length("block"))).first()[0] or 0
    buckets = max(1, -(-size // GROUP_BYTES))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    order = [("doc_id", "ascending"), ("text_hash", "ascending"), ("start", "ascending")]

    def find(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=order, null_placement="at_start"))
        found = shared_windows(group["block"].to_pylist(), length, keep, symbol)
        start, copies = group["start"].to_numpy(), group["copies"].to_numpy()
        row, begin, end = [], [], []
        for number, (a, b) in enumerate(found):
            if keep == "none" and copies[number] > 1:
                continue
            row += [number] * len(a)
            begin += (a + start[number]).tolist()
            end += (b + start[number] + length - 1).tolist()
        take = pa.array(row, pa.int64())
        return pa.table(
            {name: group[name].take(take) for name in _KEY}
            | {"begin": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64())}
        )

    return (
        texts.select(*_KEY, "start", "copies", "block", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInArrow(find, f"doc_id {id_type}, text_hash long, begin long, end long")
    )


def _by_window_hash(texts: DataFrame, length: int, keep: str, symbol: np.dtype) -> DataFrame:
    """The same answer for anchors with very many blocks: windows counted by their hash."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    size = symbol.itemsize

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in enumerate(batch["block"]):
                text, start = block.as_py(), batch["start"][number].as_py()
                n = len(text) // size - length + 1
                hashes = [xxhash.xxh3_128_digest(text[i * size : (i + length) * size]) for i in range(n)]
                take = pa.array([number] * n, pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {name: batch[name].take(take) for name in (*_KEY, "copies")}
                    | {"start": pa.array(range(start, start + n), pa.int64()), "window": pa.array(hashes, pa.binary())}
                )

    each = stage(
        texts.select(*_KEY, "copies", "start", "block").mapInArrow(
            windows, f"doc_id {id_type}, text_hash long, copies long, start long, window binary"
        )
    )
    place = F.struct("doc_id", "text_hash", "start")
    twice = each.groupBy("window").agg(F.count("*").alias("c"), F.min(place).alias("first")).filter("c > 1")
    found = _joined(each, stage(twice), ["window"], "c")
    found = found.filter(~place.eqNullSafe(F.col("first"))) if keep == "first" else found.filter("copies = 1")
    return found.select(*_KEY, F.col("start").alias("begin"), (F.col("start") + length).alias("end"))


def merged(spans: list[dict] | np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by spans."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans) if spans is not None else ():
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def in_bytes(text: bytes, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as runs of bytes, without the white space around them."""
    begin, end = word_edges(np.frombuffer(text, np.uint8))
    return [(int(begin[a]), int(end[b - 1])) for a, b in words]


def remaining(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    if not cut:
        return text
    edges = [0, *[e for span in cut for e in span], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(text: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans narrowed so that no character of UTF-8 is cut in two."""
    out = []
    for begin, end in cut:
        while begin < end and text[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def _with_spans(keyed: DataFrame, length: int, keep: str, group_blocks: int) -> DataFrame:
    spans = repeated_spans(keyed, length, keep, group_blocks)
    lists = _renamed(spans.groupBy(*_KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    return keyed.join(lists, _same_key(keyed, lists), "left")


def digests(documents: DataFrame, length: int = LENGTH, keep: str = "none", group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the rest."""
    ship(documents.sparkSession)
    keyed = _keyed(documents)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, found in zip(texts, spans, strict=True):
                cut = merged(found)
                rest = remaining(text, cut)
                rows.append((len(text), len(text) - len(rest), len(cut), hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_spans(keyed, length, keep, group_blocks)
    return joined.select("doc_id", digest("bytes", "spans").alias("d")).select("doc_id", "d.*")


def cut_documents(
    documents: DataFrame,
    length: int = LENGTH,
    keep: str = "first",
    group_blocks: int = GROUP_BLOCKS,
    symbol: np.dtype = BYTE,
) -> DataFrame:
    """The documents with repeated passages of ``length`` symbols cut out of their texts, in
    all their columns.

    A span is narrowed to whole characters. Where there is a column ``n_chars``, it follows
    the new text. A null text stays null.
    """
    ship(documents.sparkSession)
    rows = documents.select(
        "doc_id",
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"),
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"),
    ).withColumn("text_hash", F.xxhash64("bytes"))

    def cut(text: bytes, spans: list[dict]) -> list[tuple[int, int]]:
        found = merged(spans)
        return whole_characters(text, found if symbol == BYTE else in_bytes(text, found))

    @F.pandas_udf("string")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series(
                [
                    None if t is None else remaining(t, cut(t, s)).decode("utf-8", "replace")
                    for t, s in zip(texts, spans, strict=True)
                ],
                dtype=object,
            )

    spans = repeated_spans(_keyed(documents), length, keep, group_blocks, symbol)
    lists = _renamed(spans.groupBy(*_KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    joined = rows.drop("bytes").join(lists, _same_key(rows, lists), "left")
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(rest(F.col("doc.text").cast("binary"), F.col("spans")))
    doc = F.col("doc").withField("text", text)
    if "n_chars" in documents.columns:
        doc = doc.withField("n_chars", F.length(text).cast(documents.schema["n_chars"].dataType))
    return joined.select(doc.alias("doc")).select("doc.*")
