"""Token ids of texts by a tokenizer of the ``tokenizers`` library, remembered by part."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from firmwatt.llm.common import slices

CACHE_PARTS, CACHED_CHARACTERS = 300_000, 64
#: Letters below are letters in every version of Unicode, so that a word of them is one unit.
STABLE_LETTERS = "\u0250"
#: Texts are encoded together up to so many bytes.
TOGETHER_BYTES = 4 << 20


def _characters_of_bytes() -> dict[int, str]:
    """The published map of byte-level vocabularies: printable bytes stand for themselves,
    the others for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _table(flags: Iterable[int]) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(flags)] = True
    return found


_ASCII_LETTER = _table([*range(65, 91), *range(97, 123)])
#: First bytes of the letters U+00C0 to U+023F, apart from the two signs below.
_WIDE_LETTER = _table(range(0xC3, 0xC9))
_SIGNS = (0x97, 0xB7)  # second bytes of U+00D7 and U+00F7
#: ASCII signs that end a word; an apostrophe may begin a unit of letters.
_MARK = _table(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, as ``tokenizers`` gives them.

    ``definition`` is the JSON of a byte-level tokenizer. Its pattern never joins what stands
    on both sides of a single space or line feed, nor a letter and a mark behind it, so texts
    are cut there. Arrow numbers the different parts of several texts, so that each is looked
    up once for all of them, and a worker remembers the ids of parts. A part that is one word
    of letters goes to the tokenizer's model without its pattern. A text where white space
    stands otherwise or that holds a special token's string is encoded at once.
    """

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize, self.characters = self.tokenizer.model.tokenize, _characters_of_bytes()
        self.space, self.line_feed = self.unit(" "), self.whole("\n")
        self.parts: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def unit(self, text: str) -> str:
        """The characters that stand for the bytes of a text."""
        return text.encode().decode("latin-1").translate(self.characters)

    def __call__(self, text: str | None) -> bytes:
        return next(self.texts(pa.array([text], pa.string())))

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column; null counts as empty."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        sizes = pc.binary_length(column).to_numpy()
        for lo, hi in slices(sizes, TOGETHER_BYTES):
            yield from self._together(column.slice(lo, hi - lo), sizes[lo:hi])

    def _together(self, column: pa.Array, sizes: np.ndarray) -> Iterator[bytes]:
        borders = np.concatenate(([0], np.cumsum(sizes)))
        symbols = _symbols(column, int(borders[-1]))
        begin = _begins(symbols, borders[:-1][sizes > 0])
        edges = np.append(begin, len(symbols)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(symbols)])
        numbered = parts.dictionary_encode()
        number, found = numbered.indices.to_numpy(), self._found(numbered.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        unsettled = size == 0
        ids, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        size = size[number]
        to = np.concatenate(([0], np.cumsum(size)))
        ids = ids[np.repeat(at[number] - to[:-1], size) + np.arange(to[-1])]
        first = np.searchsorted(begin, borders)  # part of every text
        at_once = np.diff(np.concatenate(([0], np.cumsum(unsettled[number])))[first]) > 0
        for special in self.special:
            at_once |= pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        to = to[first]
        for k, one in enumerate(at_once.tolist()):
            yield self.whole(column[k].as_py()) if one else ids[to[k] : to[k + 1]].tobytes()

    def _found(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts, each with the space or line feed before it; no ids where white space
        stands beside.

        When the memory is full it starts anew beside what it held, so frequent parts stay.
        """
        out = list(map(self.parts.get, parts))
        for k in [k for k, found in enumerate(out) if found is None]:
            part = parts[k]
            found = self.former.get(part)
            out[k] = found = self._ids(part.decode()) if found is None else found
            if len(part) <= CACHED_CHARACTERS:
                if len(self.parts) >= CACHE_PARTS:
                    self.former, self.parts = self.parts, {}
                self.parts[part] = found
        return out

    def _ids(self, part: str) -> bytes:
        feed = self.line_feed if part[0] == "\n" else b""
        text = part[1:] if feed else part
        word = text[1:] if text[:1] == " " else text
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.tokenize(self.space + word if len(word) < len(text) else word)]
            return feed + struct.pack(f"<{len(ids)}I", *ids)
        if not word or word[0].isspace() or word[-1].isspace():
            return b""
        if word.isalpha() and max(word) < STABLE_LETTERS:
            ids = [t.id for t in self.tokenize(self.unit(text))]
            return feed + struct.pack(f"<{len(ids)}I", *ids)
        return feed + self.whole(text)


def _symbols(column: pa.Array, size: int) -> np.ndarray:
    """The bytes of all texts of a large_string column without nulls."""
    if not size:
        return np.empty(0, np.uint8)
    _, edges, data = column.buffers()
    return np.frombuffer(data, np.uint8, size, int(np.frombuffer(edges, np.int64, 1, 8 * column.offset)[0]))


def _begins(symbols: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the parts begin: at a text, a space, a line feed, or a mark behind a letter."""
    begins = (symbols == 32) | (symbols == 10)
    mark = np.flatnonzero(_MARK[symbols])
    mark = mark[mark > 1]
    last, before = symbols[mark - 1], symbols[mark - 2]
    wide = _WIDE_LETTER[before] & (last >= 0x80) & ~((before == 0xC3) & ((last == _SIGNS[0]) | (last == _SIGNS[1])))
    begins[mark[_ASCII_LETTER[last] | wide]] = True
    begins[texts] = True
    return np.flatnonzero(begins)


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: bytes) -> Encoder:
    """One encoder per worker and tokenizer; it stays for the worker's next tasks."""
    key = zlib.crc32(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def forget() -> None:
    """Free the tables of this worker, where other work begins that needs none."""
    _ENCODERS.clear()
