"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, computed by the forward
algorithm; a text's is the product over its words. Words are runs of letters in lower case,
marked at their start; pieces never cross words, so each distinct word is computed once.

Learning counts words by language over all learning documents and runs a few rounds of
expectation maximisation: every word passes its count on to its pieces by their share in
all segmentations (forward and backward sums), and counts give new probabilities. What is
gathered is one number per language and piece, bounded by the vocabulary.

Learned from documents whose crc32 of doc_id modulo 3 is not 1 and whose language is known.
The score is the posterior of the predicted language, with the learned languages' shares of
documents as prior.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any
learned language every text is ``und``; ties go to the language first in code order; a
character outside the vocabulary is a piece of its own with a small probability; equal rows
are predicted alike; a word of any length is summed over all its segmentations, in logarithms, so that
no sum leaves the range of doubles.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmwatt.llm.common import crc_mod, ship, slices, stage

FOLDS, HELD_OUT = 3, 1
ROUNDS, SMOOTHING = 2, 0.1
#: Least probability of a piece.
LEAST = 1e-10
CACHE_WORDS = 400_000
#: Characters of the words that are computed at once, and of the longest word whose scores are kept.
BATCH_CHARS, KEPT_CHARS = 200_000, 64

START = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def vocabulary(path: str) -> list[str]:
    """The pieces of a public model that are made of letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    letters = (p for p in found if _LETTERS.fullmatch(p.replace(START, "")) or p == START)
    return sorted(p for p in letters if p)


class Words:
    """Words of one length with the pieces in them.

    ``first`` holds the number of every single character's piece (0: none) by place and word;
    ``longer`` the longer pieces by size: rows of the words and piece numbers in the order of
    the places where they begin, and where each place's share of them starts.
    """

    def __init__(self, at: list[int], first: np.ndarray, longer: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        self.at, self.first, self.longer = np.array(at), first, longer

    def between(self, begin: int | None, end: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, rows and numbers of the longer pieces that begin or end at a place."""
        for size, row, piece, edge in self.longer:
            place = end - size if begin is None else begin
            if 0 <= place < len(edge) - 1 and edge[place] < edge[place + 1]:
                here = slice(edge[place], edge[place + 1])
                yield size, row[here], piece[here]


class Lattice:
    """The pieces at every place of many words of one length."""

    def __init__(self, pieces: list[str]):
        number = {p: i + 1 for i, p in enumerate(pieces)}
        self.by_size = []
        for size in range(1, max(map(len, pieces), default=1) + 1):
            these = [p for p in pieces if len(p) == size]
            hashes = list(_rolling(_codes(these, size), size))[-1][:, -1] if these else np.empty(0, np.uint64)
            order = np.argsort(hashes)
            self.by_size.append((hashes[order], np.array([number[p] for p in these], np.int32)[order]))

    def by_length(self, words: list[str]) -> Iterator[Words]:
        lengths: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            lengths[len(word) + 1].append(i)
        for length, rows in lengths.items():
            step = max(1, BATCH_CHARS // length)
            for lo in range(0, len(rows), step):
                yield self._found(rows[lo : lo + step], words, length)

    def _found(self, at: list[int], words: list[str], length: int) -> Words:
        codes = _codes([START + words[i] for i in at], length)
        first, longer = np.zeros((length, len(at)), np.int32), []
        for size, hashes in enumerate(_rolling(codes, len(self.by_size)), 1):
            known, numbers = self.by_size[size - 1]
            if not len(known):
                continue
            hashes = hashes.T
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[place] == hashes
            if size == 1:
                first[hit] = numbers[place[hit]]
            elif hit.any():
                edge = np.concatenate(([0], np.cumsum(hit.sum(axis=1))))
                longer.append((size, np.nonzero(hit)[1].astype(np.int32), numbers[place[hit]], edge))
        return Words(at, first, longer)


def _codes(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)


def _rolling(codes: np.ndarray, sizes: int) -> Iterator[np.ndarray]:
    """For sizes 1, 2, ... the hashes of all strings of that many code points, by their begin.

    Strings are told apart by 64 bits of a polynomial; the vocabulary has no two alike.
    """
    now = codes + np.uint64(1)
    yield now
    for size in range(1, min(sizes, codes.shape[1])):
        with np.errstate(over="ignore"):
            now = now[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + codes[:, size:] + np.uint64(1)
        yield now


def forward(words: Words, prob: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations up to every place: (places + 1, words, languages).

    A sum is taken relative to the one before it; no piece is so long that the ratio overflows.
    """
    length, n = words.first.shape
    logs = np.zeros((length + 1, n, prob.shape[1]))
    for end in range(1, length + 1):
        now, base = prob[words.first[end - 1]], logs[end - 1]
        for size, row, piece in words.between(None, end):
            now[row] += prob[piece] * np.exp(logs[end - size, row] - base[row])
        logs[end] = base + np.log(now)
    return logs


def backward(words: Words, prob: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations from every place on, like ``forward``."""
    length, n = words.first.shape
    logs = np.zeros((length + 1, n, prob.shape[1]))
    for begin in range(length - 1, -1, -1):
        now, base = prob[words.first[begin]], logs[begin + 1]
        for size, row, piece in words.between(begin, None):
            now[row] += prob[piece] * np.exp(logs[begin + size, row] - base[row])
        logs[begin] = base + np.log(now)
    return logs


def word_scores(words: list[str], lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Log probability of every word in every language."""
    out = np.zeros((len(words), prob.shape[1]))
    for found in lattice.by_length(words):
        out[found.at] = forward(found, prob)[-1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in one language: ``counts`` of words spread over pieces."""
    out, log_prob, column = np.zeros(len(prob)), np.log(prob), prob[:, None]
    for found in lattice.by_length(words):
        before, after = forward(found, column)[:, :, 0], backward(found, column)[:, :, 0]
        weight, every = np.log(counts[found.at]) - before[-1], np.arange(len(found.at))
        for end in range(1, len(before)):
            for size, row, piece in [(1, every, found.first[end - 1]), *found.between(None, end)]:
                used = before[end - size, row] + log_prob[piece] + after[end, row] + weight[row]
                np.add.at(out, piece, np.exp(used))
    return out


class Model:
    def __init__(self, languages: list[str], prior: np.ndarray, lattice: Lattice, prob: np.ndarray):
        self.languages, self.prior, self.lattice, self.prob = languages, prior, lattice, prob


class WordScores:
    """Scores of the words that a worker has met, one matrix row per word."""

    def __init__(self, key: int, languages: int):
        self.key, self.rows, self.matrix = key, {}, np.empty((CACHE_WORDS, languages), np.float32)

    def add(self, words: list[str], model: Model) -> None:
        scores, first = word_scores(words, model.lattice, model.prob), len(self.rows)
        if first + len(words) > len(self.matrix):  # one text with more new words than that
            self.matrix = np.vstack([self.matrix, np.empty_like(self.matrix)])
        self.matrix[first : first + len(words)] = scores
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))


_KNOWN: list[WordScores] = []


def predict(texts: list[str | None], model: Model, key: int) -> tuple[list[str], list[float]]:
    """Language and posterior of texts; word scores stay in the worker for later calls."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, scores
    words = [words_of(t) for t in texts]
    for lo, hi in slices(np.array([len(w) for w in words]), CACHE_WORDS // 2):
        if not _KNOWN or _KNOWN[0].key != key:
            _KNOWN[:] = [WordScores(key, len(model.languages))]
        rows = _KNOWN[0].rows
        short = {w for part in words[lo:hi] for w in part if len(w) <= KEPT_CHARS}
        new = [w for w in short if w not in rows]
        if len(rows) + len(new) > CACHE_WORDS:
            _KNOWN[:] = [WordScores(key, len(model.languages))]
            rows, new = _KNOWN[0].rows, list(short)
        _KNOWN[0].add(new, model)
        matrix = _KNOWN[0].matrix
        for i in range(lo, hi):
            if words[i]:
                kept = [rows[w] for w in words[i] if len(w) <= KEPT_CHARS]
                total = model.prior + matrix[kept].sum(axis=0, dtype=float)
                if len(kept) < len(words[i]):
                    other = [w for w in words[i] if len(w) > KEPT_CHARS]
                    total = total + word_scores(other, model.lattice, model.prob).sum(axis=0)
                best = int(np.argmax(total))
                names[i] = model.languages[best]
                scores[i] = float(1 / np.exp(total - total[best]).sum())
    return names, scores


def word_counts(documents: DataFrame) -> DataFrame:
    """lang, word and how often it stands in the learning documents; counted by batch first."""
    learning = documents.filter((crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                sums[lang].update(words_of(text))
            rows = [(lang, w, n) for lang, found in sums.items() for w, n in found.items()]
            yield pa.RecordBatch.from_pydict(
                dict(zip(("lang", "word", "n"), map(list, zip(*rows, strict=True)), strict=True))
                if rows else {"lang": pa.array([], pa.string()), "word": pa.array([], pa.string()), "n": pa.array([], pa.int64())}
            )

    counted = learning.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(documents: DataFrame, vocabulary_path: str, rounds: int = ROUNDS) -> Model:
    """The model of all learning documents."""
    ship(documents.sparkSession)
    pieces = vocabulary(vocabulary_path)
    lattice = Lattice(pieces)
    counts = stage(word_counts(documents))
    rows = documents.filter((crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull())
    shares = rows.groupBy("lang").count().orderBy("lang").toPandas()  # one row per language
    languages = shares["lang"].tolist()
    prior = np.log(shares["count"].to_numpy() / max(1, shares["count"].sum()))
    number = {lang: i for i, lang in enumerate(languages)}
    start = np.array([1e-3, *[0.05 ** (len(p.replace(START, "")) ** 0.5) for p in pieces]])
    prob = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    sent = documents.sparkSession.sparkContext.broadcast(lattice)  # the vocabulary, fixed size

    for _ in range(rounds if languages else 0):
        now = documents.sparkSession.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(now.value)
            for batch in batches:
                frame = batch.to_pandas()
                for lang, group in frame.groupby("lang"):
                    i = number[lang]
                    sums[:, i] += expected_counts(
                        group["word"].tolist(), group["n"].to_numpy(float), sent.value, now.value[:, i]
                    )
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(piece), "lang": pa.array(lang), "n": pa.array(sums[piece, lang])}
            )

        used = counts.mapInArrow(expect, "piece long, lang long, n double")
        table = used.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # languages x vocabulary
        sums = np.full(prob.shape, SMOOTHING)
        sums[table["piece"], table["lang"]] += table["n"]
        prob = np.maximum(sums / sums.sum(axis=0), LEAST)
    return Model(languages, prior, lattice, prob)


def identify(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score."""
    model = learn(documents, vocabulary_path)
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    key = hash((spark.sparkContext.applicationId, sent._jbroadcast.id() if sent._jbroadcast else 0))

    @F.pandas_udf("lang string, score double")
    def languages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            names, scores = predict(texts, sent.value, key)
            yield pd.DataFrame({"lang": names, "score": np.round(scores, 6)})

    found = documents.select(
        "doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), languages("text").alias("p")
    )
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
