"""Packing whole documents into sequences by best-two-fit.

A document is its token ids and one end token. Only a document longer than a sequence is
cut: its first piece takes the rest, all others are full, so cutting adds no half-empty
piece at the end. The pieces are dealt over shards by a row number, so equal rows and null
ids spread like any others. A shard fills one sequence at a time: the longest unpacked
piece that fits goes in until none does; then, if the sequence has a gap and more than one
piece, its smallest piece is exchanged for the two unpacked pieces that together fill the
gap it leaves most tightly, if those fill it more tightly than it did. A shard holds
``SHARD_PIECES`` pieces on average, so its tables have a bounded size, and only its last
few sequences have larger gaps.

Defined cases: a null text counts as empty and is the end token alone; equal rows are
packed each on its own; a null doc_id is packed like any other; an empty table gives no
rows; columns other than doc_id and text are not read. A special token's string in a text
is that token, as the tokenizer has it.
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
END_TOKEN = 0
SHARD_PIECES = 16384


def pieces(
    documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_token: int = END_TOKEN, with_ids: bool = False
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32 and, if
    asked for, its ids."""
    ship(documents.sparkSession)
    with open(tokenizer_path, "rb") as file:
        definition = documents.sparkSession.sparkContext.broadcast(file.read())  # fixed size, 2 MB
    end = np.array([end_token], "<u4").tobytes()
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition.value)
        for batch in batches:
            row, number, start, length, crc, ids = [], [], [], [], [], []
            for at, ids_of_text in enumerate(encode.texts(batch["text"])):
                whole = memoryview(ids_of_text + end)
                total = len(whole) // 4
                borders = [0, *range(total % window or window, total + 1, window)] if total > window else [0, total]
                for k, (begin, stop) in enumerate(zip(borders, borders[1:], strict=False)):
                    part = whole[4 * begin : 4 * stop]
                    row.append(at)
                    number.append(k)
                    start.append(begin)
                    length.append(stop - begin)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            out = {"doc_id": batch["doc_id"].take(pa.array(row, pa.int64())), "piece": pa.array(number, pa.int32())}
            for name, values in (("start", start), ("length", length), ("ids_crc32", crc)):
                out[name] = pa.array(values, pa.int64())
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return documents.select("doc_id", "text").mapInArrow(cut, schema)


class Unpacked:
    """Pieces that are not packed yet, by length.

    ``below[x]`` is the longest length of at most ``x`` that is still there, 0 if none is.
    """

    def __init__(self, lengths: np.ndarray, window: int):
        self.order = np.argsort(lengths, kind="stable")
        self.count = np.bincount(lengths, minlength=window + 1)
        self.first = np.cumsum(self.count) - self.count
        there = np.where(self.count > 0, np.arange(window + 1), 0)
        self.below = np.maximum.accumulate(there)

    def take(self, length: int) -> int:
        """One piece of that length; it is the next to be taken if it is put back."""
        self.count[length] -= 1
        if not self.count[length]:
            last = np.searchsorted(self.below, length, side="right")
            self.below[length:last] = self.below[length - 1]
        return int(self.order[self.first[length] + self.count[length]])

    def put_back(self, length: int) -> None:
        self.count[length] += 1
        if self.count[length] == 1:
            last = np.searchsorted(self.below, self.below[length], side="right")
            self.below[length:last] = length

    def tightest_two(self, room: int) -> tuple[int, int]:
        """Two lengths, the longer one first, whose sum is the largest of at most ``room``;
        of equal sums the one with the longest piece. (0, 0) if there are no two."""
        longer = np.flatnonzero(self.count[:room])
        if not len(longer):
            return 0, 0
        shorter = self.below[np.minimum(longer, room - longer)]
        alone = (shorter == longer) & (self.count[longer] < 2)
        shorter = np.where(alone, self.below[longer - 1], shorter)
        total = np.where(shorter > 0, longer + shorter, 0)[::-1]
        best = len(longer) - 1 - int(np.argmax(total))
        return (int(longer[best]), int(shorter[best])) if shorter[best] else (0, 0)


def best_two_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece; lengths are from 1 to ``window``."""
    unpacked = Unpacked(lengths, window)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, sequence = len(lengths), 0
    while left:
        inside: list[tuple[int, int]] = []
        gap = window
        while length := int(unpacked.below[gap]):
            inside.append((length, unpacked.take(length)))
            gap -= length
        if gap and len(inside) > 1:
            smallest = inside[-1][0]
            two = unpacked.tightest_two(gap + smallest)
            if sum(two) > smallest:
                taken = [(length, unpacked.take(length)) for length in two]
                unpacked.put_back(smallest)
                inside[-1:] = taken
        at = 0
        for length, piece in inside:
            where[piece], offset[piece] = sequence, at
            at += length
        left -= len(inside)
        sequence += 1
    return where, offset


def pack(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces; every other column is kept.

    The pieces are written once with a row number each, so that a shard computed again
    after the loss of an executor holds the same rows.
    """
    ship(cut.sparkSession)
    numbered = stage(cut.withColumn("row__", F.monotonically_increasing_id()))
    shards = max(1, -(-numbered.count() // shard_pieces))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)

    def place(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("row__").drop_columns(["shard__", "row__"])
        where, offset = best_two_fit(group["length"].to_numpy(), window)
        where += key[0].as_py() << 32
        return group.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))

    return (
        numbered.withColumn("shard__", F.pmod(F.xxhash64("row__"), F.lit(shards)))
        .groupBy("shard__")
        .applyInArrow(place, fields + ", sequence_id long, `offset` long")
    )


def sequences(packed: DataFrame, window: int = WINDOW, padding: int = 0) -> DataFrame:
    """The sequences themselves, padded: sequence_id, ids and, in order, the offsets and
    documents of its pieces. ``packed`` has the ids of each piece."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
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
    """The layout of all documents."""
    return pack(pieces(documents, tokenizer_path))
