"""Fill-in-the-middle documents by block rotation in place, and back.

A text is cut between two of its units (runs of ASCII letters, or single other characters)
into prefix, middle and suffix. The cuts are found in one scan over its bytes. The three
sentinels are inserted into a byte array, which then holds prefix, middle and suffix, each
behind its sentinel. The blocks are exchanged in the same array: two neighbouring blocks
change places when each is reversed and then both together are. The inverse exchanges them
back and takes the sentinels out again, which gives the exact text.

A document's cuts and form come from a hash of its id alone, so reruns agree.

Defined cases: a null text counts as empty; empty texts, texts that hold a sentinel and the
share of texts that is left alone stay plain; a null doc_id has the empty text as its id;
equal rows give equal rows; an empty table gives no rows; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmwatt.llm.common import ship, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SEED = "1:"
BLOCK_BYTES = 1 << 22


def unit_starts(text: bytes) -> np.ndarray:
    """The byte at which each unit begins."""
    codes = np.frombuffer(text, np.uint8)
    lower = codes | 32
    letter = (lower >= 97) & (lower <= 122)
    begins = ~letter & ((codes & 0xC0) != 0x80)
    begins[:1] = True
    begins[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(begins)


def characters(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def reverse(blocks: bytearray, begin: int, end: int) -> None:
    part = blocks[begin:end]
    part.reverse()
    blocks[begin:end] = part


def exchange(blocks: bytearray, begin: int, border: int, end: int) -> None:
    """Exchange the neighbouring blocks [begin, border) and [border, end) in place."""
    reverse(blocks, begin, border)
    reverse(blocks, border, end)
    reverse(blocks, begin, end)


def rotate(text: bytes, first: int, second: int, suffix_first: bool) -> bytes:
    """The text with its middle, bytes [first, second), moved behind its suffix."""
    blocks = bytearray(text)
    blocks[second:second] = SUFFIX
    blocks[first:first] = MIDDLE
    blocks[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    exchange(blocks, 0 if suffix_first else middle, suffix, len(blocks))
    return bytes(blocks)


def restored(output: bytes, form: str) -> bytes:
    """The text that ``rotate`` was given."""
    if form == "plain":
        return output
    blocks = bytearray(output)
    if form == "spm":
        exchange(blocks, 0, blocks.index(PREFIX), len(blocks))
    else:
        middle = blocks.index(SUFFIX)
        exchange(blocks, middle, blocks.index(MIDDLE, middle), len(blocks))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):  # the text itself has none
        at = blocks.index(sentinel)
        del blocks[at : at + len(sentinel)]
    return bytes(blocks)


def draws(doc_id: object) -> list[int]:
    """Four 32-bit numbers from a document's id."""
    name = SEED + ("" if doc_id is None else str(doc_id))
    digest = hashlib.sha256(name.encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(documents: DataFrame) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document."""
    ship(documents.sparkSession)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def cut(doc_id: object, text: bytes) -> tuple:
        starts = unit_starts(text)
        n, (h1, h2, h3, h4) = len(starts), draws(doc_id)
        if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        borders = np.append(starts, len(text))
        first, second = (int(borders[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        form = "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"
        sizes = characters(text[:first]), characters(text[first:second])
        return n, form, *sizes, rotate(text, first, second, form == "spm")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size__"].to_numpy()
            for low, high in slices(sizes, BLOCK_BYTES):
                part = batch.slice(low, high - low)
                rows = zip(part["doc_id"].to_pylist(), part["bytes__"].to_pylist(), strict=True)
                n, form, prefix, middle, output = zip(*(cut(d, t) for d, t in rows), strict=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "n": pa.array(n, pa.int64()),
                        "form": pa.array(form, pa.string()),
                        "prefix_chars": pa.array(prefix, pa.int64()),
                        "middle_chars": pa.array(middle, pa.int64()),
                        "output": pa.array(output, pa.binary()).cast(pa.string()),
                    }
                )

    schema = f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = documents.select("doc_id", raw.alias("bytes__")).withColumn("size__", F.octet_length("bytes__"))
    return sized.mapInArrow(cuts, schema)


def restore(rotated: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from ``output`` and ``form``; a null output
    gives null. A column of that name is replaced, every other one is kept."""
    ship(rotated.sparkSession)
    kept = rotated.drop("restored")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch["size__"].to_numpy(), BLOCK_BYTES):
                part = batch.slice(low, high - low)
                rows = zip(part["output"].to_pylist(), part["form"].to_pylist(), strict=True)
                texts = [None if output is None else restored(output.encode(), form) for output, form in rows]
                columns = {name: part[name] for name in part.schema.names if name != "size__"}
                yield pa.RecordBatch.from_pydict(
                    columns | {"restored": pa.array(texts, pa.binary()).cast(pa.string())}
                )

    sized = kept.withColumn("size__", F.coalesce(F.octet_length("output"), F.lit(0)))
    return sized.mapInArrow(rebuild, ", ".join([*fields, "restored string"]))


def digests(documents: DataFrame) -> DataFrame:
    """The transformation as digests: of each output, and of the text rebuilt from it."""
    rows = restore(transform(documents))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
