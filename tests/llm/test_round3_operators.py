"""Best-two-fit packing, fill-in-the-middle and interval search against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from firmwatt.llm import fill_in_middle, interval_search, two_fit_packing
from firmwatt.llm.token_ids import encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


# --- best-two-fit ---


def plain_two_fit(lengths, window):
    """Sorted contents of every sequence, by lists and all pairs."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        inside = []
        for length in list(left):
            if sum(inside) + length <= window:
                inside.append(length)
                left.remove(length)
        room = window - sum(inside) + inside[-1]
        if len(inside) > 1 and sum(inside) < window:
            pairs = [(a + b, max(a, b)) for a, b in itertools.combinations(left, 2) if a + b <= room]
            total, longer = max(pairs, default=(0, 0))
            if total > inside[-1]:
                left.append(inside.pop())
                inside += [longer, total - longer]
                left.remove(longer)
                left.remove(total - longer)
                left.sort(reverse=True)
        out.append(sorted(inside))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_two_fit_equals_the_plain_version(lengths):
    where, offset = two_fit_packing.best_two_fit(np.array(lengths, np.int64), 30)
    found = defaultdict(list)
    for s, o, n in zip(where, offset, lengths, strict=True):
        found[s].append((o, n))
    assert sorted(sorted(n for _, n in parts) for parts in found.values()) == plain_two_fit(lengths, 30)
    for parts in found.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]


def test_an_exchange_closes_the_gap():
    where, _ = two_fit_packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert where.tolist() == [0, 1, 0, 0]  # 6 + 3 leaves a gap, 6 + 2 + 2 none


def layout(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in found.values():
        parts.sort()
        assert parts[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert parts[-1][0] + parts[-1][1] <= two_fit_packing.WINDOW
    return found


def test_documents_are_packed_whole(documents, rows):
    packed = two_fit_packing.pack(two_fit_packing.pieces(documents, TOKENIZER), shard_pieces=40).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*ids_of(text), 0]
        borders = [0, len(ids)]
        if len(ids) > 2048:
            borders = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    total = sum(r["length"] for r in packed)
    assert len(layout(packed)) <= math.ceil(total / 2048) + 2 * 3  # three shards


def test_equal_rows_spread_over_shards(spark):
    same = spark.createDataFrame([(None, "a b c")] * 3000, "doc_id long, text string")
    packed = two_fit_packing.pack(two_fit_packing.pieces(same, TOKENIZER), shard_pieces=300).collect()
    assert len(packed) == 3000
    per_shard = Counter(r["sequence_id"] >> 32 for r in packed)
    assert len(per_shard) == 10 and max(per_shard.values()) < 450
    layout(packed)


def test_sequences_hold_the_ids(documents, rows):
    cut = two_fit_packing.pieces(documents, TOKENIZER, with_ids=True)
    found = two_fit_packing.sequences(two_fit_packing.pack(cut)).collect()
    assert all(len(r["ids"]) == 2048 for r in found)
    kept = sum(sum(1 for i in r["ids"]) for r in found)
    assert kept >= sum(len(ids_of(r[1])) + 1 for r in rows)


def test_no_documents_give_no_pieces(nothing):
    packed = two_fit_packing.pack_documents(nothing, TOKENIZER)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() == 0


ODD = st.text(st.sampled_from("ab1.'! \n\t \u0085 \x1c中\U0001f600é"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_ids_equal_the_tokenizer(text):
    with open(TOKENIZER, "rb") as file:
        encode = encoder(file.read())
    assert encode(text) == np.array(ids_of(text), "<u4").tobytes()


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "x <|endoftext|> y\n<|endoftext|>", "q" * 30000, "  <|endoftext|>", "<|endoftext|>" * 3])
def test_ids_of_special_strings_and_long_runs(text):
    with open(TOKENIZER, "rb") as file:
        encode = encoder(file.read())
    assert encode(text) == np.array(ids_of(text), "<u4").tobytes()


# --- fill-in-the-middle ---


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD_ROWS = [
    (500, "has <P> inside"), (501, "\x00\x7f"), (502, "<<S"), (503, "M>a"), (504, "\U0001f600é"), (505, "Z" * 200_000),
    (506, "a<"), (507, "1"), (508, "<S"), (509, "\r\n  "), (None, "no id"), (510, ""), (510, "twice"), (510, "twice"),
]


def test_texts_are_cut_and_restored(spark, documents, rows):
    every = [(r[0], r[1]) for r in rows] + ODD_ROWS + [(1000 + i, f"x{i} <{'y' * i}") for i in range(100)]
    df = spark.createDataFrame(every, "doc_id long, text string").selectExpr("doc_id", "text", "'q' AS form", "1 AS restored")
    found = fill_in_middle.restore(fill_in_middle.transform(df)).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in found)
    want = Counter()
    for doc_id, text in every:
        want[doc_id, *plain_middle(doc_id, text), text or ""] += 1
    assert got == want
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_exchange_is_its_own_kind_of_inverse():
    blocks = bytearray(b"headAAABBBBB")
    fill_in_middle.exchange(blocks, 4, 7, 12)
    assert blocks == b"headBBBBBAAA"
    fill_in_middle.exchange(blocks, 4, 9, 12)
    assert blocks == b"headAAABBBBB"


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab <>PSMé"), max_size=30), st.data(), st.booleans())
def test_rotation_round_trip(text, data, suffix_first):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    raw = text.encode()
    starts = [*fill_in_middle.unit_starts(raw).tolist(), len(raw)]
    a, b = sorted((data.draw(st.sampled_from(starts)), data.draw(st.sampled_from(starts))))
    output = fill_in_middle.rotate(raw, a, b, suffix_first)
    assert fill_in_middle.restored(output, "spm" if suffix_first else "psm") == raw


def test_no_documents_give_no_outputs(nothing):
    assert fill_in_middle.digests(nothing).count() == 0


# --- interval search ---

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERMS.findall(small)


def plain_ranks(documents, items, k=10):
    bags = [(d, Counter(plain_terms(t))) for d, t in documents]
    bags = [(d, bag) for d, bag in bags if bag]
    n_docs, all_terms = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = Counter()
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n_docs // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in set(plain_terms(text))
                if t in bag
            )
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, missing, d) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if missing else d, -score] += 1
    return out


def ranks(found):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())


SEARCHED = [
    (1, "the The THE cat"), (2, "Ünï ünï cat-dog"), (3, "dog\x00dog_dog 12a"), (4, None), (5, ""), (6, " .,- "),
    (7, "the cat"), (7, "the cat"), (None, "the cat"), (8, "É é É"), (9, "中文 the 中文"), (10, "zebra " * 500),
]
ITEMS = [(1, "the cat"), (1, "the cat"), (2, "ÜNÏ dog é"), (3, None), (4, "..."), (None, "zebra 中文"), (5, "absent"), (6, "Dog dog DOG")]


@pytest.mark.parametrize("shard_bytes", [1, 40, 1 << 20])
def test_ranks_equal_the_plain_version(spark, rows, shard_bytes):
    documents = SEARCHED + [(100 + i, r[1]) for i, r in enumerate(rows)] + [(300, "the " * 9 + "cat")] * 20
    words = [r[1] for r in rows if r[1]]
    items = ITEMS + [(10 + i, " ".join(words[i].split()[:40])) for i in range(12)]
    df = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS term", "0 AS shard")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS item", "2 AS doc_id")
    index = interval_search.build(df.repartition(3), shard_bytes)
    assert ranks(interval_search.search_index(index, asked)) == plain_ranks(documents, items)


def test_many_items_go_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(interval_search, "BLOCK_ITEMS", 3)
    documents = [(r[0], r[1]) for r in rows]
    items = [(i, " ".join((rows[i][1] or "").split()[:5])) for i in range(30)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranks(interval_search.search(df, asked)) == plain_ranks(documents, items)


def test_empty_tables_give_no_ranks(spark, nothing, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for df, items in ((nothing, some), (documents, none), (nothing, none)):
        found = interval_search.search(df, items)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_long_texts_are_read_in_stretches():
    text = ("Word9, " * 1000 + "é" * 50 + " x").encode()
    assert sum(interval_search.terms_of(text, 37), []) == [t.encode() for t in plain_terms(text.decode())]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_intervals_find_the_best_and_leave_most(seed):
    draw = np.random.default_rng(seed)
    places = [np.flatnonzero(draw.random(3000) < p) for p in (0.6, 0.2, 0.01, 0.002)]
    places = [p if len(p) else np.array([5]) for p in places]
    impact = [draw.integers(1, 400, len(p)) for p in places]
    weights = np.array([1, 3, 20, 40])
    searcher = interval_search.Searcher(places, impact, 3000)
    place, score = searcher.best(np.arange(4), weights, 10)
    plain = np.zeros(3000, np.int64)
    for p, i, w in zip(places, impact, weights, strict=True):
        plain[p] += i * w
    order = np.lexsort((np.arange(3000), -plain))[:10]
    assert place.tolist() == order.tolist() and score.tolist() == plain[order].tolist()


def test_rare_terms_leave_most_documents_unscored():
    draw = np.random.default_rng(1)
    common, rare = np.arange(20000), np.sort(draw.choice(20000, 40, replace=False))
    searcher = interval_search.Searcher([common, rare], [draw.integers(1, 100, 20000), draw.integers(50, 100, 40)], 20000)
    searcher.best(np.arange(2), np.array([1, 100]), 10)
    assert searcher.scored < 500


def test_queries_of_one_id_are_answered_each(spark):
    from pyspark.sql import functions as F

    from firmwatt.llm import bm25_search

    rows = [(100, "alpha beta gamma"), (100, "delta delta"), (1, "alpha beta"), (2, "delta"), (3, "none")]
    found = bm25_search.search(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 100 == 0)
    got = sorted((r["query"], r["rank"], r["doc_id"]) for r in found.collect())
    assert got == [(100, 1, 100), (100, 1, 100), (100, 2, 1), (100, 2, 2)]
