"""Packing documents into windows of tokens by best-fit decreasing.

A document is its token ids and one end token. Documents longer than a window are first
cut into full windows and a rest. The pieces are dealt over shards, and each shard packs
its pieces from the longest to the shortest: a piece goes to the open window whose
remaining capacity is the smallest that still holds it, found in a segment tree indexed
by remaining capacity. The number of shards follows the number of pieces, so a shard is
small however many documents there are, and no document or source is dealt as a whole.

Defined cases: a null text counts as empty and is the end token alone; equal rows are
packed each on its own; a null doc_id is packed like any other. An empty table gives no
rows. A string of the tokenizer's special token in a text is that token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmwatt.llm.common import ship, stage
from firmwatt.llm.token_ids import encoder

WINDOW = 2048
END_TOKEN = 1
SHARD_PIECES = 4096


def pieces(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens and,
    if asked for, its ids."""
    ship(documents.sparkSession)
    with open(tokenizer_path, "rb") as file:
        definition = documents.sparkSession.sparkContext.broadcast(file.read())  # fixed size, 2 MB
    end = np.array([END_TOKEN], "<u4").tobytes()
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition.value)
        for batch in batches:
            row, start, length, crc, tokens, ids = [], [], [], [], [], []
            for number, ids_of_text in enumerate(encode.texts(batch["text"])):
                whole = memoryview(ids_of_text + end)
                total = len(whole) // 4
                for at in range(0, total, window):
                    part = whole[4 * at : 4 * (at + window)]
                    row.append(number)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(total)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            out = {"doc_id": batch["doc_id"].take(pa.array(row, pa.int64()))}
            for name, values in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", tokens)):
                out[name] = pa.array(values, pa.int64())
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return documents.select("doc_id", "text").mapInArrow(cut, schema)


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree over the capacities.

    A node holds the largest capacity below it at which a window is open, so the search
    for the tightest fit goes down once.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.at[capacity].append(number)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the smallest remaining capacity of ``length`` or more."""
        node = length + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        number = self.at[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, number


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece; equal lengths keep their order."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, n = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = opened.take(length)
        if found is None:
            found, n = (window, n), n + 1
        capacity, number = found
        where[i], offset[i] = number, window - capacity
        if capacity > length:
            opened.add(capacity - length, number)
    return where, offset


def pack(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces; every other column is kept.

    The rows should come from storage: they are counted first.
    """
    ship(cut.sparkSession)
    shards = max(1, -(-cut.count() // shard_pieces))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)

    def place(key: tuple, group: pa.Table) -> pa.Table:
        group = group.drop_columns("shard__").sort_by(
            [("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]
        )
        where, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        where += key[0].as_py() << 32
        return group.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))

    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(shards))
    return (
        cut.withColumn("shard__", spread)
        .groupBy("shard__")
        .applyInArrow(place, fields + ", sequence_id long, `offset` long")
    )


def sequences(packed: DataFrame, window: int = WINDOW, padding: int = 0) -> DataFrame:
    """The windows themselves: sequence_id, the padded ids and the pieces' borders.

    ``packed`` has the ids of each piece; a window holds ``window`` tokens at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))
    ids = F.flatten(F.col("parts.ids"))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.concat(ids, F.array_repeat(F.lit(padding), F.lit(window) - F.size(ids))).alias("ids"),
            F.col("parts.offset").alias("offsets"),
            F.col("parts.doc_id").alias("doc_ids"),
        )
    )


def pack_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """The layout of all documents; the pieces are written once, so a lost executor
    doesn't tokenize again."""
    return pack(stage(pieces(documents, tokenizer_path)))
