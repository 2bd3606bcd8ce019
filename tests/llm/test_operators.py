import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from firmwatt.llm import (
    bm25_search,
    chat,
    language_id,
    minhash_dedup,
    mixing,
    oracles,
    packing,
    quality_model,
    quality_rules,
    suffix_dedup,
    url_filter,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_repeated_words_against_windows():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = [bytes([97 + x]) for x in rng.integers(0, 4, rng.integers(0, 30))]
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_allowed_rejections_is_the_exact_bound():
    for n, share, chance in ((50, 0.1, 0.05), (400, 0.02, 0.01), (10, 0.1, 0.05)):
        tail = lambda k, n=n, p=share: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        k = quality_rules.allowed_rejections(n, share, chance)
        assert (k < 0 or tail(k) <= chance) and tail(k + 1) > chance


def test_cutoffs_reject_junk_and_keep_the_promise(spark):
    rng = np.random.default_rng(2)
    rows = [("en", int(v), 0, 0, 0, 0, 0) for v in np.where(rng.random(5000) < 0.001, 900, 0)] + [(None, 0, 0, 0, 0, 0, 0)]
    judged = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} long" for r in quality_rules.RULES))
    found = {r["stratum"]: r for r in quality_rules.choose_cutoffs(judged).collect()}
    assert found["en"]["cut_symbols"] == quality_rules.CUTOFFS[0]
    assert found[None]["cut_symbols"] is None  # one label shows nothing


def test_quality_rules_rows(documents, labels, rows, nothing):
    found = quality_rules.judge(documents, labels).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[72]["n_words"] == 0 and by_id[72]["base_failed"] and not by_id[73]["kept"]
    kept = quality_rules.keep_good(documents, labels)
    assert kept.columns == documents.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in found if r["kept"])
    assert quality_rules.judge(nothing, labels).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(BPE)
    encode = packing.encoder(open(BPE, "rb").read())
    draw = np.random.default_rng(4)
    odd = ["a", "B9", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "'s", "'", "　", "\xa0", "<|endoftext|>", "日本", "!?", "\x1c", "́", "²"]
    for _ in range(400):
        text = "".join(draw.choice(odd) for _ in range(draw.integers(0, 14)))
        ids = np.frombuffer(encode(text), "<u4").tolist()
        assert ids == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 65, 300)
    where, offset = packing.best_fit_decreasing(lengths, 64)
    left: list[int] = []
    for length in sorted(lengths.tolist(), reverse=True):  # plain search over all windows
        fits = [i for i, room in enumerate(left) if room >= length]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= length
        else:
            left.append(64 - length)
    used = np.bincount(where, lengths)
    assert sorted(64 - used) == sorted(left)
    for w in range(len(used)):
        at = sorted(zip(offset[where == w], lengths[where == w], strict=True))
        assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1]]


def test_packing_holds_every_token_once(documents, rows, nothing):
    found = packing.pack_documents(documents, BPE).collect()
    encode = packing.encoder(open(BPE, "rb").read())
    by_doc = collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for doc_id, text, *_ in rows:
        ids = encode(text) + b"\1\0\0\0"
        parts = sorted({(r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id]})
        assert sum(n for _, n, _ in parts) == len(ids) // 4
        assert all(zlib.crc32(ids[4 * a : 4 * (a + n)]) == c for a, n, c in parts)
    for r in range(0, len(found)):
        assert found[r]["length"] <= packing.WINDOW
    windows = collections.defaultdict(list)
    for r in found:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack_documents(nothing, BPE).count() == 0
    whole = packing.sequences(packing.pack(packing.pieces(documents.limit(5), BPE, with_ids=True))).collect()
    assert all(len(r["ids"]) == packing.WINDOW for r in whole)


def brute_removed(rows, length=400):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc_id, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((doc_id, len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_blocks", [1000, 1])
def test_suffix_dedup_against_all_windows(documents, rows, nothing, group_blocks):
    found = suffix_dedup.digests(documents, group_blocks=group_blocks).collect()
    assert sorted([tuple(r) for r in found], key=str) == brute_removed(rows)
    if group_blocks > 1:
        assert suffix_dedup.digests(nothing).count() == 0


def test_longest_previous_factor_by_definition():
    rng = np.random.default_rng(6)
    for _ in range(20):
        text = rng.integers(1, 4, rng.integers(1, 40))
        common = lambda i, j, t=text: next((k for k in range(len(t) - j) if t[i + k] != t[j + k]), len(t) - j)
        want = [max([common(j, i) for j in range(i)], default=0) for i in range(len(text))]
        assert suffix_dedup.SuffixOrder(text).longest_previous_factor().tolist() == want


def test_cut_documents_keeps_the_first_copy(documents, rows):
    cut = suffix_dedup.cut_documents(documents)
    assert cut.columns == documents.columns
    by_id = {r["doc_id"]: r for r in cut.collect()}
    texts = {r[0]: r[1] for r in rows}
    assert by_id[1]["text"] == texts[1] and by_id[66]["text"] == texts[66]
    assert by_id[60]["text"] == "" and 0 < len(by_id[67]["text"]) < len(texts[67]) - 400
    assert by_id[72]["text"] is None and by_id[67]["n_chars"] == len(by_id[67]["text"])


def test_cut_documents_by_words(spark):
    import corpus_pipeline

    draw = np.random.default_rng(8)
    words = lambda n: [f"{draw.integers(1 << 40):x}" for _ in range(n)]
    short = lambda n: "".join(f"{draw.choice(list('abcdefghij'))}{i % 10} " for i in range(n)).split()
    over, under, wide = short(51), short(50), words(90)
    assert len(" ".join(over)) < 400
    texts = [words(100) + p + words(100) for p in [over] * 3 + [under] * 3]
    # unequal blocks of the same anchors: parts of one passage
    texts += [words(40) + wide[k : k + 60 + k] + words(40) for k in (0, 5, 10, 20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(20, "\t\n".join(texts[0][90:160])), (21, None), (22, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), {}
    for i, text in rows:
        found = (text or "").split()
        gone = [False] * len(found)
        for k in range(len(found) - 50):
            window = tuple(found[k : k + 51])
            if window in seen:
                gone[k : k + 51] = [True] * 51
            seen.add(window)
        want[i] = [w for w, g in zip(found, gone, strict=True) if not g]
    assert [len(want[i]) for i in (0, 1, 2, 4, 20)] == [251, 200, 200, 250, 0]
    for group_blocks in (suffix_dedup.GROUP_BLOCKS, 1):
        found = suffix_dedup.cut_documents(frame, 51, group_blocks=group_blocks, symbol=suffix_dedup.WORD).collect()
        assert {r["doc_id"]: (r["text"] or "").split() for r in found} == want
    stage = corpus_pipeline.repeated_passages(spark, frame, "").collect()
    assert {r["doc_id"]: (r["text"] or "").split() for r in stage} == want


def brute_classes(rows):
    bags = []
    for r in rows:
        words = (r[1] or "").encode().split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
        bags.append(collections.Counter(grams))
    df = collections.Counter(g for b in bags for g in b)
    idf = lambda g: math.log1p(1 / max(df[g] / len(rows), 0.05)) / math.log1p(20)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            every = bags[i] | bags[j]
            total = sum(n * idf(g) for g, n in every.items())
            if total and sum(n * idf(g) for g, n in (bags[i] & bags[j]).items()) >= 0.8 * total:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return [sorted(g, key=str) for g in groups.values()]


def test_minhash_classes_against_all_pairs(documents, rows, nothing):
    found = minhash_dedup.classes(documents).collect()
    groups = collections.defaultdict(list)
    plain = [r for r in found if r["doc_id"] not in (72, 73, 74)]
    for r in plain:
        groups[r["class_id"]].append(r["doc_id"])
    want = brute_classes([r for r in rows if r[0] not in (72, 73, 74)])
    assert sorted((sorted(g, key=str) for g in groups.values()), key=str) == sorted(want, key=str)
    assert all(r["class_size"] == 1 and r["stays"] for r in found if r["doc_id"] in (72, 73, 74))
    kept = minhash_dedup.keep_one(documents)
    assert kept.columns == documents.columns
    assert kept.count() == len(want) + 3
    assert minhash_dedup.classes(nothing).count() == 0


def test_copies_do_not_hide_an_edited_copy(spark):
    draw = np.random.default_rng(21)
    words = lambda n: [f"{draw.integers(1 << 40):x}" for _ in range(n)]
    hot, edits = words(104), words(104)
    changed = lambda text, *at: [f"n{draw.integers(1 << 40):x}" if i in at else w for i, w in enumerate(text)]
    # a text with a third of all rows and one copy of it with two words changed: 90 of 110 shingles
    texts = [hot] * 40 + [changed(hot, 30, 60)] + [words(50) for _ in range(79)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[40]["class_id"] == 0 and found[0]["class_size"] == 41
    assert all(found[i]["class_size"] == 1 for i in range(41, 120))
    # a group of different edited copies with half of all rows
    texts = [edits] + [changed(edits, 10 + i, 60 + i) for i in range(9)] + [words(50) for _ in range(10)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i]["class_size"] for i in range(20)] == [10] * 10 + [1] * 10


def test_linked_blocks_against_pairs(rows):
    weights = minhash_dedup.Weights(np.empty(0, np.uint64), np.empty(0))
    texts = sorted({(r[1] or "").encode() for r in rows})
    a, b = minhash_dedup.linked(texts, [str(i) for i in range(len(texts))], weights, 0.5)
    want = {
        (i, j)
        for i in range(len(texts))
        for j in range(i + 1, len(texts))
        if minhash_dedup.similarity(texts[i], texts[j], weights) >= 0.5
    }
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_sampling_agrees_as_often_as_texts_are_alike():
    weights = minhash_dedup.Weights(np.empty(0, np.uint64), np.empty(0))
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words).encode(), " ".join(words[:250] + [f"x{i}" for i in range(50)]).encode()]
    owner, value, often = minhash_dedup.shingles(texts)
    draws = minhash_dedup.Sampler(4000)(owner, value, weights(value, often), 2)
    assert abs((draws[0] == draws[1]).mean() - minhash_dedup.similarity(*texts, weights)) < 0.03


def test_mix_comes_near_its_targets(documents, rows, nothing):
    found = mixing.mix(documents).collect()
    assert len(found) == len(rows)
    sizes = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    taken, target = collections.Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in found:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = (r["target"], r["source_size"])
    for s, (want, size) in target.items():
        assert want <= 2 * size + 1e-6 and abs(taken[s] - want) <= 2 * mixing.BLOCK_WORDS
    assert abs(sum(t for t, _ in target.values()) - 1.5 * sum(sizes[r[0]] for r in rows)) < 1e-3
    again = mixing.mix(documents.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mixed_documents(documents).columns == documents.columns
    assert mixing.mix(nothing).count() == 0


def test_apportion_equals_the_highest_quotients(spark):
    rng = np.random.default_rng(8)
    for seats in (0, 1, 7, 100):
        votes = [int(v) for v in rng.integers(1, 500, 12)] + [100_000]
        frame = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, i_ int, votes long, s long")
        found = {r["i_"]: r["won"] for r in mixing.apportion(frame, ["g"], "s", "won", "i_").collect()}
        ranked = sorted((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats))[:seats]
        want = collections.Counter(i for _, i in ranked)
        assert found == {i: want[i] for i in range(len(votes))}


def test_hosts_paths_rules_and_spread(spark):
    urls = [
        (1, "HTTP://A.Example.ORG/es/x?q", None), (2, "https://b.com/fr", ""), (3, None, None), (4, "no scheme", ""),
        (5, "https://b.com/de/1", '<a href="https://spam.net/x">'), (6, "https://spam.net/y", '<a href="//B.com/">'),
        (7, "http://x.org", ""), (8, "http://notexample.org/en/1", ""), (9, "http://bad.com/de/", ""), (10, "http://bad.com/x", ""),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert (found[1]["host"], found[1]["path"], found[1]["rule"]) == ("a.example.org", "/es/x", "example.org/es/")
    assert found[2]["rule"] is None and found[7]["path"] == "" and found[7]["rule"] is None
    assert found[8]["rule"] == "org/" and found[3]["host"] == "" and found[4]["verdict"] == "allow"
    assert found[10]["rule"] is None and found[10]["verdict"] == "block"
    # b.com <-> spam.net: distrust of one page walks back and forth, 0.15 * 0.85 ^ k
    walk = [0.15 * 0.85**k for k in range(400)]
    assert found[6]["distrust"] == pytest.approx(sum(walk[1::2]), abs=1e-6)
    assert found[2]["distrust"] == pytest.approx(sum(walk[0::2]), abs=1e-6)


def test_mass_reaches_the_end_of_a_long_chain(spark):
    """A chain of 24 hosts from a seed of a million pages; every link carries all mass on."""
    seeds = spark.createDataFrame([("trust", "h0", 1e6)], "kind string, host string, mass double")
    chain = [("trust", f"h{i}", f"h{i + 1}", 1.0) for i in range(24)]
    edges = spark.createDataFrame(chain, "walk string, src string, dst string, share double")
    found = {r["host"]: r["score"] for r in url_filter.spread(seeds, edges).collect()}
    assert found == pytest.approx({f"h{i}": 0.15e6 * 0.85**i for i in range(25)})
    none = url_filter.spread(seeds.limit(0), edges)
    assert none.columns == ["kind", "host", "score"] and not none.count()


def test_quality_model_learns(spark):
    rng = np.random.default_rng(9)
    rows, labels = [(None, None), (-1, "")], []
    for i in range(400):
        good = i % 2
        text = " ".join("word" + "x" * int(n) + ("" if good else "###") for n in rng.integers(0, 5, 80))
        rows.append((i, text))
        labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality_model.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 0]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
    empty = quality_model.score(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in empty.collect()} == {0.5}


def test_isotonic_never_falls():
    centres, shares = quality_model.isotonic(np.array([2, 2, 2, 2]), np.array([1.0, 0, 2, 1]), np.arange(4.0))
    assert np.allclose(shares, [0.25, 0.75]) and np.allclose(centres, [0.5, 2.5])


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "ab", "b", "ba", "▁ab", "▁abababab", "bababababa"]
    prob = np.array([[0.05], [0.1], [0.2], [0.15], [0.1], [0.25], [0.1], [0.02], [0.03]])
    number = {p: i + 1 for i, p in enumerate(pieces)}

    def total(rest):
        if not rest:
            return 1.0
        out = 0.0
        for n in range(1, len(rest) + 1):
            piece = rest[:n]
            if len(piece) == n and (piece in number or n == 1):
                out += prob[number.get(piece, 0), 0] * total(rest[n:])
        return out

    words = ["ab", "abab", "zab", "b", "abababababab", "zbabababababaz"]
    found = language_id.word_scores(words, language_id.Lattice(pieces), prob)[:, 0]
    assert np.allclose(np.exp(found), [total("▁" + w) for w in words])
    counts = language_id.expected_counts(["ab"], np.array([3.0]), language_id.Lattice(pieces), prob[:, 0])
    assert counts[number["▁ab"]] == pytest.approx(3 * prob[number["▁ab"], 0] / total("▁ab"))


def test_all_pieces_and_whole_words_count():
    pieces = language_id.vocabulary(PIECES)
    assert max(map(len, pieces)) > 6
    lattice = language_id.Lattice(pieces)
    rng = np.random.default_rng(3)
    prob = rng.uniform(1e-10, 1e-3, (len(pieces) + 1, 2))
    number = {p: i + 1 for i, p in enumerate(pieces)}
    words = ["international", "x" * 30, "verantwortung" * 3, "straße" * 40]
    for word, found in zip(words, language_id.word_scores(words, lattice, prob), strict=True):
        text = "▁" + word
        sums = [[Fraction(1)] * 2]
        for end in range(1, len(text) + 1):
            used = [(n, number.get(text[end - n : end], 0)) for n in range(1, end + 1) if n == 1 or text[end - n : end] in number]
            sums.append([sum(Fraction(prob[i, k]) * sums[end - n][k] for n, i in used) for k in (0, 1)])
        want = [math.log(x.numerator) - math.log(x.denominator) for x in sums[-1]]
        assert list(found) == pytest.approx(want, rel=1e-9)
    counts = language_id.expected_counts(words, np.array([1.0, 2, 3, 1]), lattice, prob[:, 0])
    sizes = np.array([1, *map(len, pieces)])  # pieces used cover every place of every word
    assert (counts * sizes).sum() == pytest.approx(sum(n * (len(w) + 1) for n, w in zip((1, 2, 3, 1), words, strict=True)))


def test_languages_end_to_end_by_all_segmentations(spark):
    """The whole query against plain sums over dictionaries; repeated rows, long words, other columns."""
    rng = np.random.default_rng(12)
    kinds = {"aa": ["theory", "tion", "international"], "bb": ["ciones", "mente", "responsabilidad"]}
    rows = [(i, " ".join(rng.choice(kinds[k], 4)), k) for i, k in enumerate(["aa", "bb"] * 12)]
    rows += [(90, "tion" * 30, "aa"), (91, "ciones mente", None), (91, "ciones mente", None), (92, "", "bb"), (93, None, "bb")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, word string, n int")
    pieces = language_id.vocabulary(PIECES)
    number = {p: i + 1 for i, p in enumerate(pieces)}
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[2]]
    start = np.array([1e-3, *[0.05 ** (len(p.replace("▁", "")) ** 0.5) for p in pieces]])
    prob = {lang: start / start.sum() for lang in ("aa", "bb")}

    def cuts(word, p):  # sums over all segmentations before and after every place, and the pieces that end there
        text, before = "▁" + word, [1.0]
        edges = [
            [(n, number.get(text[e - n : e], 0)) for n in range(1, e + 1) if n == 1 or text[e - n : e] in number]
            for e in range(1, len(text) + 1)
        ]
        for e, used in enumerate(edges, 1):
            before.append(sum(p[i] * before[e - n] for n, i in used))
        after = [0.0] * len(text) + [1.0]
        for e in range(len(text), 0, -1):
            for n, i in edges[e - 1]:
                after[e - n] += p[i] * after[e]
        return before, after, edges

    for _ in range(language_id.ROUNDS):
        for lang in prob:
            sums = np.full(len(start), language_id.SMOOTHING)
            for _, text, k in learned:
                for word in (text or "").split() if k == lang else []:
                    before, after, edges = cuts(word, prob[lang])
                    for e, used in enumerate(edges, 1):
                        for n, i in used:
                            sums[i] += prob[lang][i] * before[e - n] * after[e] / before[-1]
            prob[lang] = np.maximum(sums / sums.sum(), language_id.LEAST)
    shares = collections.Counter(k for _, _, k in learned)
    got = language_id.identify(docs, PIECES).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        row = found[doc_id]
        if not text:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        logs = {k: math.log(shares[k]) + sum(math.log(cuts(w, prob[k])[0][-1]) for w in text.split()) for k in prob}
        best = max(sorted(logs), key=logs.get)
        assert row["lang_pred"] == best
        assert row["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-5)
    assert language_id.identify(docs.limit(0), PIECES).collect() == []


def test_languages_are_told_apart(spark):
    rng = np.random.default_rng(10)
    kinds = {"aa": ["the", "tion", "ing", "and"], "bb": ["ciones", "mente", "para", "que"]}
    rows = [
        (i, " ".join(rng.choice(kinds[lang], 30)), lang) for i, lang in enumerate(["aa", "bb"] * 60)
    ] + [(500, None, "aa"), (501, "12 !", "bb"), (None, "the and the", None), (502, "the" * 200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs, PIECES).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[500]["lang_pred"] == by_id[501]["lang_pred"] == "und" and by_id[None]["lang_pred"] == "aa"
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found if r["doc_id"] is not None)
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unknown, PIECES).collect()} == {"und"}


def test_search_against_all_documents(documents, rows):
    found = bm25_search.search(documents, F.col("doc_id") % 10 == 0, k=5).collect()
    bags = [(r[0], collections.Counter((r[1] or "").encode().lower().split())) for r in rows]
    n, df = len(rows), collections.Counter(w for _, b in bags for w in b)
    lengths = [sum(b.values()) for _, b in bags]
    mean = np.mean([x for x in lengths if x])
    for doc_id, query in bags:
        if doc_id is None or doc_id % 10 or not query:
            continue
        scores = []
        for (other, bag), length in zip(bags, lengths, strict=True):
            s = sum(
                q * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * length / mean))
                for w, q in query.items()
            )
            if s > 0:
                scores.append((-round(s, 4), other is None, other))
        want = [(o, -s) for s, _, o in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:5]]
        got = [(r["doc_id"], round(r["score"], 4)) for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == doc_id]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-4)
        assert {o for o, s in got if s > want[-1][1] + 1e-3} == {o for o, s in want if s > want[-1][1] + 1e-3}


def test_every_participant_gets_a_view(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hé"), (1, 2, "ann", None),
        (2, 0, "system", "alone"), (3, None, None, "x"), (4, 0, "ann", "a"), (4, 70, "ann", "b"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["part"], r["speaker"]): r for r in chat.rotate(turns).collect()}
    assert set(found) == {(1, 0, "ann"), (1, 0, "bob"), (3, 0, "unknown"), (4, 0, "ann")}
    ann = found[1, 0, "ann"]
    assert ann["text"].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|>")
    assert [ann["text"][s["begin"] : s["end"]] for s in ann["mask"]] == ["hi < |im_end|><|im_end|>", "<|im_end|>"]
    bob = found[1, 0, "bob"]
    assert [bob["text"][s["begin"] : s["end"]] for s in bob["mask"]] == ["hé<|im_end|>"]
    assert "user name=ann" in bob["text"]
    assert found[4, 0, "ann"]["n_turns"] == 2
    assert chat.rotate(turns.limit(0)).collect() == []


def _chat_rows(df):
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    columns = ["conv_id", "part", "speaker", "text", F.array_join(spans, ",").alias("mask"), "n_turns"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_long_conversations_are_whole_below_the_bound(spark):
    rows = [(5, 0, "system", "be kind")] + [(5, i, f"s{i % 3}", f"t{i}") for i in range(1, 400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.rotate(turns).collect()
    assert {(r["part"], r["speaker"], r["n_turns"]) for r in found} == {(0, f"s{i}", 400) for i in range(3)}


@pytest.mark.parametrize("part_bytes", [300, 2000, 1 << 19])
def test_large_conversations_are_cut_in_order(spark, part_bytes):
    """Against the SQL: system turns in force, ties, nulls, repeated rows, a hot and a null conversation."""
    draw = np.random.default_rng(11)
    rows = [(9, int(i % 8) if i % 9 else None, f"s{i % 3}", f"t{draw.integers(40)}é" * (i % 5)) for i in range(500)]
    rows += [(9, 3, "s1", "same")] * 60 + [(8, 0, "ann", "x"), (None, None, "ann", "y"), (None, 4, None, "long " * 300)]
    rows += [(None, 3, "system", "s"), (None, 9, "cy", None), (9, 2, "system", "a <| b"), (9, 5, "system", "later"), (7, 1, "system", "alone")]
    turns = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part string, speaker string"
    )
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    sql = oracles.OP10.replace("524288", str(part_bytes))
    names = "conv_id, part, speaker, text, mask, n_turns"
    want = sorted(duck.execute(f"SELECT {names} FROM ({sql})").fetchall(), key=str)
    for partitions in (1, 7):  # the parts don't go by the layout
        assert _chat_rows(chat.rotate(turns.repartition(partitions), part_bytes)) == want
