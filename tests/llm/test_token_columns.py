"""Token ids of a column of texts: equal to the tokenizer's, each different part once."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from firmwatt.llm import token_ids

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "one", " one", "one two,three; four.", "a\nb\n\nc", "a\n b", "tab\there", "end ", "\n", "  ", "é×é, ÷. ƀ! ÿ?",
    "don't 'tis it's'x", "3.14 x2.y -a- (b) [c] {d}", "<|endoftext|>", "x <|endoftext|>.", "a|>b <|endoftext", "日本語, です。 ok", " x ,",
    "ǅ, ɐ; ́x, é.", "one***two&&& |||", "word\r\nnext", "q" * 70 + ", " + "é" * 70,
]


@pytest.fixture(scope="module")
def definition():
    with open(BPE, "rb") as file:
        return file.read()


def plain(text):
    return np.array(Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("together", [1, 40, 4 << 20])
def test_a_column_gives_the_ids_of_each_text(definition, together, monkeypatch):
    monkeypatch.setattr(token_ids, "TOGETHER_BYTES", together)
    monkeypatch.setattr(token_ids, "CACHE_PARTS", 5)  # the memory starts anew within a column
    encode = token_ids.Encoder(definition)
    want = [plain(t) for t in TEXTS]
    column = pa.array(TEXTS, pa.string())
    assert list(encode.texts(column)) == want == list(encode.texts(column.cast(pa.large_string())))
    assert list(encode.texts(column.slice(3, 9))) == want[3:12]
    assert list(encode.texts(column.slice(0, 0))) == [] and [encode(t) for t in TEXTS] == want


def test_a_word_is_encoded_once_whatever_marks_stand_behind_it(definition):
    encode, seen = token_ids.Encoder(definition), []
    tokenize = encode.tokenize
    encode.tokenize = lambda unit: seen.append(unit) or tokenize(unit)
    texts = ["x alpha alpha, alpha; alpha***", "x alpha! beta. alpha\nx"] * 50
    assert list(encode.texts(pa.array(texts))) == [plain(t) for t in texts]
    assert sorted(seen) == sorted(["x", "x", "Ġalpha", "Ġbeta"])  # x at a text's and at a line's begin
