"""Operators against brute force, the libraries, round trips and held-out accuracy; and their edge cases."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoscape.llm import fingerprints as fp
from genoscape.llm import jaccard, languages, licences, mixing, neighbours, pieces, quality, repeats, sketches, substrings, token_counts, words
from genoscape.llm.components import components
from genoscape.llm.words import U64, text_hashes, window_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, k string, starts string, sig string"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    base = [rng.choice(vocab) for _ in range(120)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 150))) for _ in range(30)]
    texts += [" ".join(base)] * 3
    for i in range(12):
        edited = list(base)
        for _ in range(i % 4):
            edited[rng.randrange(len(edited))] = "edit" + str(i)
        texts.append(" ".join(edited))
    texts += [f"{t} {passage} {t}" for t in texts[:5]]
    texts += [None, "", " \n ", "ONE", "a b c", "a b c", "x " * 400, "Ünï cödé no-break", "w" * 5000]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], len(t or ""), "k", "s", "g") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[31], (None, texts[2], "en", "s1", 1, "k", "s", "g"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def path(name):
    import public_tokenizers

    return str(public_tokenizers.path(name))


def test_hashes_without_words_tell_words_apart():
    texts = [b"", b"a", b" a  b\n", b"ab c ab", "é \x0b x".encode()]
    for t in texts:
        a, b = text_hashes(t), word_hashes(t.split())
        assert len(a) == len(b) and len(np.unique(a)) == len(np.unique(b))
    assert text_hashes(b"q ab")[1] == text_hashes(b"ab  zzz")[0]
    w = window_hashes(text_hashes(b"a b c a b c a"), 3)
    assert w[0] == w[3] and len(np.unique(w)) == 3


def thue_morse(n: int, a: str, b: str) -> list[str]:
    """n signs whose sums of powers of any odd base agree, modulo 2**64, with those of the mirror sequence, if n is large."""
    return [(a, b)[k.bit_count() % 2] for k in range(n)]


def test_hashes_tell_thue_morse_sequences_apart():
    for n in (64, 1024, 4096, 1 << 19):
        one, two = ("".join(thue_morse(n, *x)).encode() for x in ("ab", "ba"))
        a, b = text_hashes(b"x " + one + b" y"), text_hashes(b"x " + two + b" y")
        assert (a == b).tolist() == [True, False, True]
        one, two = ((" ".join(thue_morse(n, *x))).encode() for x in (("cat", "dog"), ("dog", "cat")))
        if n <= 4096:
            assert window_hashes(text_hashes(one), n)[0] != window_hashes(text_hashes(two), n)[0]
            sums = fp.text_sums(one), fp.text_sums(two)
            assert fp.written(sums[0]) != fp.written(sums[1]) and fp.likeness(*sums) < 1


def test_unequal_texts_with_equal_polynomials(spark):
    words_of = [" ".join(thue_morse(1024, *x)) for x in (("cat", "dog"), ("dog", "cat"))]
    rows = fp.fingerprints(spark.createDataFrame(list(enumerate(words_of)), "doc_id long, text string")).collect()
    assert rows[0].fingerprint != rows[1].fingerprint and max(r.near_next for r in rows) < 1
    long = ["".join(thue_morse(1024, *x)) for x in ("ab", "ba")]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_classes(docs, n=4, num=85, den=100).collect()} == {0: 0, 1: 1}
    docs = spark.createDataFrame([(i, w + " same" * 34) for i, w in enumerate(long)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.substring_dedup(docs, 35).collect()] == [0, 0]


def test_slices_do_not_show():
    rng = random.Random(9)
    text = b"".join(bytes(rng.choice(b"abcxyz") for _ in range(rng.randint(1, 9))) + rng.choice([b" ", b"\n", b"  ", b"\t\x0b "]) for _ in range(90_000)) + b"q" * 700_000 + b" end"
    whole = text_hashes(text)
    assert len(whole) == len(text.split())
    assert (whole[:50] == np.concatenate([text_hashes(w) for w in text.split()[:50]])).all() and (whole[-3:] == np.concatenate([text_hashes(w) for w in text.split()[-3:]])).all()
    seen = dict(zip(text.split(), whole.tolist(), strict=True))
    assert all(seen[w] == h for w, h in zip(text.split(), whole.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    values = np.arange(3 * words.SLICE, dtype=U64) % U64(1000)
    for width in (4, 35):
        found = window_hashes(values, width)
        assert len(found) == len(values) - width + 1 and (found[:1000] == found[1000:2000]).all() and len(np.unique(found)) == 1000
        assert (found[words.SLICE - 100 : words.SLICE + 100] == window_hashes(values[words.SLICE - 100 : words.SLICE + 99 + width], width)).all()


@pytest.mark.parametrize("work", ["jaccard", "substrings"])
def test_a_text_of_50_mb_needs_bounded_memory(work):
    """Peak of the arrays beside the text itself; one value a word and a few slices."""
    import tracemalloc

    text = b" ".join([b"word%d" % (k % 5000) for k in range(5_000_000)])[: 50 << 20]
    tracemalloc.start()
    try:
        if work == "jaccard":
            jaccard.window_hashes(jaccard.text_hashes(text), 4)
        else:
            substrings._anchors(text_hashes(text), 35)
        assert tracemalloc.get_traced_memory()[1] < 400 << 20
    finally:
        tracemalloc.stop()


def test_packed_runs_round_trip():
    x = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(U64) * U64(2)
    x = np.concatenate((x, x[:100], x[:10]))
    for bits in (0, 5):
        got = {}
        for bucket, *run in repeats.packed_run(x, bits):
            h, c = repeats.unpacked(bucket, *run, bits)
            got |= dict(zip(h.tolist(), c.tolist(), strict=True))
        assert got == dict(Counter(x.tolist()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == got[102] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_windows(rows, width):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    count = Counter(tuple(w[p : p + width]) for _, w in words for p in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = substrings.covered_words(len(w), [p for p in range(len(w) - width + 1) if count[tuple(w[p : p + width])] > 1], width)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("way", ["filter", "join"])
def test_substrings(docs, way, monkeypatch):
    if way == "join":
        monkeypatch.setattr(substrings, "bloom_of", lambda *a: None)
        monkeypatch.setattr(words, "FAIR_SHARE", 2)
    for width in (35, 2):
        assert Counter(tuple(r) for r in substrings.substring_dedup(docs, width).collect()) == brute_windows(corpus(), width)


def test_covers_are_difference_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_deduplicated_keeps_columns_and_untouched_texts(docs):
    got = substrings.deduplicated(docs)
    assert got.columns == docs.columns
    untouched = {r.doc_id: r.text for r in got.where("doc_id IN (50, 51, 52, 53, 54, 55, 57, 58)").collect()}
    own = {r[0]: r[1] for r in corpus()}
    assert untouched == {i: own[i] for i in untouched}


def brute_classes(rows, n, num):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().translate(jaccard._LOWER).split()
        sets.append(frozenset(tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    low = {}
    for x, r in enumerate(rows):
        if r[0] is not None:
            low[top(x)] = min(r[0], low.get(top(x), r[0]))
    return Counter((r[0], len(sets[x]), low.get(top(x))) for x, r in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "block", "cells"), [(4, 85, 512, 1 << 26), (5, 80, 2, 1 << 26), (3, 60, 3, 64)])
def test_near_classes(docs, n, num, block, cells, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(sketches, "LEVEL_CELLS", cells)
    if block < 512:  # the ways of large tables: no filter, salted joins
        monkeypatch.setattr(jaccard, "bloom_of", lambda *a: None)
        monkeypatch.setattr(words, "FAIR_SHARE", 2)
    got = Counter(tuple(r) for r in jaccard.near_classes(docs, n, num, 100).drop("k", "stays").collect())
    assert got == brute_classes(corpus(), n, num)


def test_counted_hashes_keep_a_level_without_room_in_the_table(spark, monkeypatch):
    monkeypatch.setattr(sketches, "LEVEL_CELLS", 64)
    twice = np.random.default_rng(5).integers(0, 1 << 63, 2000)
    counts = spark.createDataFrame([(h, 2 + i % 3) for i, h in enumerate(twice.tolist())], "h long, c long")
    levels = sketches.levels_of(counts)
    assert (levels.of(twice.astype(np.uint64)) > 0).all()
    others = np.random.default_rng(6).integers(0, 1 << 63, 2000).astype(np.uint64)
    assert (levels.of(others) == 0).mean() > 0.6  # what was counted once is still told apart


def test_ids_that_share_a_hash_are_connected(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RUN", 64)
    rng = np.random.default_rng(7)
    sets = {i: np.unique(rng.integers(0, 400, 3)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(-100, 100)}
    sent = spark.createDataFrame([(i,) for i in sets], "id long").repartition(3)
    pairs = {tuple(r) for r in repeats.sharing(sent, lambda batch: ((sets[i], i) for i in batch.column(0).to_pylist())).collect()}
    assert all(np.intersect1d(sets[a], sets[b]).size or a == b for a, b in pairs)
    up = {i: i for i in sets}
    for a, b in pairs:
        old, new = up[a], up[b]
        up = {i: new if x == old else x for i, x in up.items()}
    assert all(up[a] == up[b] for a in sets for b in sets if np.intersect1d(sets[a], sets[b]).size)


def test_prefix_tree_overlaps():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(40)]
    tree = jaccard.PrefixTree(lists)
    mark = np.zeros(61, bool)
    for mine in lists:
        mark[mine] = True
        shared = tree.overlaps(mark, len(mine), 50, 100)[tree.node_of]
        mark[mine] = False
        for got, other in zip(shared, lists, strict=True):
            true = len(np.intersect1d(mine, other))
            assert got in (-1, true)
            if jaccard.links(len(mine), len(other), true, 50, 100):
                assert got == true


def test_mixing(docs, spark):
    rows = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus())
    taken = {}
    for r in rows:
        assert r.taken == r.size * r.copies <= 3 * r.size
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
    total = sum(r.size for r in rows)
    assert abs(sum(t for _, t in taken) - total) < 1e-6 * total
    assert all(abs(got - target) <= max(r.size for r in rows) for (_, target), got in taken.items())
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in again)
    assert mixing.take(docs, mixing.mix(docs)).count() == sum(r.copies for r in rows if r.size)


def capped_targets(sizes, most=3):
    """Brute force: share by weight, cap what is above, share the rest anew."""
    order = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    goal, free = {}, list(order)
    while free:
        level = (sum(sizes.values()) - sum(goal.values())) / sum(weight[k] for k in free)
        above = [k for k in free if weight[k] * level > most * sizes[k] + 1e-9]
        if not above:
            return goal | {k: weight[k] * level for k in free}
        goal |= {k: most * sizes[k] for k in above}
        free = [k for k in free if k not in above]
    return goal


def test_targets_equal_a_capping_loop(spark):
    rng = random.Random(8)
    cases = [[400, 1, 3, 400], [0, 0, 0], [1], [5, 5, 5, 5, 5, 5], [0, 7, 7, 1, 1, 2, 2, 14]]
    cases += [[rng.choice([0, 1, 2, 3, 5, 10, 400]) for _ in range(rng.randint(1, 9))] for _ in range(4)]
    for case in cases:
        names = [f"s{i}" for i in range(len(case) - 1)] + [None]
        rng.shuffle(names)
        sizes = dict(zip(names, case, strict=True))
        rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
        want = capped_targets(sizes)
        assert {r.source: r.target for r in mixing.targets(mixing.sized(frame)).collect()} == pytest.approx(want)
        if case is cases[0]:
            assert all(0 <= r.taken <= 3 * r.size and r.target == want[names[r.doc_id]] for r in mixing.mix(frame).collect())


def test_salted_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(words, "FAIR_SHARE", 2)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 90 + ["b", "c", None])], "k string, salt long")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, v int")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left", "left_semi"):
        assert Counter(map(tuple, words.salted_join(rows, table, counts, "k", F.col("salt"), how).collect())) == Counter(map(tuple, rows.join(table, "k", how).collect()))


def test_mixing_caps_and_shares(spark):
    one = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate("aaaaaaaaaabc")], "doc_id long, text string, source string")
    goal = {r.source: r.target for r in mixing.targets(mixing.sized(one)).collect()}
    assert goal["b"] == 30 and goal["c"] == 15 or goal == pytest.approx({"a": 75.0, "b": 30.0, "c": 15.0})


def paragraph_sums(text):
    """Brute force: every paragraph's own sums, added up."""
    found = fp.text_sums(b"")
    for p in text.encode().split(b"\n") if text else []:
        found = fp.combine(found, fp.text_sums(p) if p else fp.sums_of(fp.paragraph_vectors(b"\n")[:1], np.empty(0, U64)))
    return found


@pytest.mark.parametrize("hot", [False, True])
def test_fingerprints(docs, spark, hot):
    frame = docs if not hot else spark.createDataFrame([(i if i % 3 else [7, None][i % 2], f"t{i}\nx{i % 40} y") for i in range(400)], "doc_id long, text string")
    rows = fp.fingerprints(frame).collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text or "") for r in frame.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()))
    want = []
    for at, (known, i, _, t) in enumerate(texts):
        after = texts[(at + 1) % len(texts)][3]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (paragraph_sums(x) for x in (t, edited, after))
        want.append((i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c)))
    assert Counter(tuple(r) for r in rows) == Counter(want)


def test_fingerprints_are_homomorphic():
    rng = random.Random(6)
    lines = ["alpha one", "beta two", "", "", "x  y", " ".join(f"w{i}" for i in range(300)), "beta two"]
    whole = fp.text_sums("\n".join(lines).encode())
    for end in ("", "\n"):
        seen = set()
        for _ in range(10):
            rng.shuffle(lines)
            text = "\n".join(lines) + end
            seen.add(fp.written(fp.text_sums(text.encode())))
            assert fp.written(paragraph_sums(text)) == fp.written(fp.text_sums(text.encode()))
        assert len(seen) == 1
    one = fp.text_sums(b"five six")
    more = fp.combine(whole, one)
    assert fp.written(fp.text_sums(("five six\n" + "\n".join(lines)).encode())) == fp.written(more) != fp.written(whole)
    assert fp.written(fp.combine(more, fp.text_sums(b"five six", -1))) == fp.written(whole)
    assert fp.written(fp.text_sums(b"a\nb")) != fp.written(fp.text_sums(b"a b")) and fp.likeness(whole, whole) == 1.0
    assert tuple(map(str, fp.read_back(fp.written(whole)))) == tuple(map(str, whole))


@pytest.mark.parametrize(("room", "name"), [(1 << 24, "word_bpe_49k.json"), (600, "word_bpe_49k.json"), (600, "byte_bpe_50k.json")])
def test_token_counts(docs, spark, room, name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", room)
    lib = Tokenizer.from_file(path(name))
    odd = ["a<|endoftext|>b", " x y\x1cz", "I'LL İΣ ΑΣ", "'s ſ 123 ４５ ⅷ ́a", "a<|END", "__ - a_b", "x'll''s é\u00ad\u00b5\u00aa2²", "don't we're ''s 's", "ÀÉ Ǆ ŉ", "a" * 3000]
    odd += [t + end for t in ("hello", "hello world.", "a 'll") for end in ("\x85", "\u2028", "\u2029", "\n", "\r\n", "\r", "\x0b", "\x0c", "\u2028\n")]
    odd += ["".join(random.Random(k).choice("aB1é'sſ., -_<|\n\u00a0\u00df\u01c5²") for _ in range(60)) for k in range(60)]
    frame = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(frame, path(name)).collect())
    rows = [(1000 + i, t) for i, t in enumerate(odd)] + [r[:2] for r in corpus()]
    assert got == Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_pieces_round_trip_and_viterbi(docs, spark):
    words = pieces.vocabulary(path("piece_bpe_32k.model"))
    for t in ["▁", "▁▁ ▁a", "  a  b\n\nc \n ", "一\U0001f600x", " ", "", "\n", "x" * 900]:
        assert words.decode(words.encode([t.encode()])[0]) == t.encode()
    small = pieces.Vocabulary(["▁".encode(), "▁a".encode(), b"a", b"ab", b"b", b"ba", b"aba"], np.log([0.1, 0.2, 0.1, 0.2, 0.1, 0.15, 0.15]), list(range(7)), list(range(7, 263)))

    def best(t):
        if not t:
            return 0.0
        found = [small.scores[k] + best(t[len(p) :]) for k, p in enumerate(["▁".encode(), "▁a".encode(), b"a", b"ab", b"b", b"ba", b"aba"]) if t.startswith(p)]
        return max(found, default=-np.inf)

    for t in ["ab", "aba", "abab", "babaab", "aabba"]:
        ids = small.encode([t.encode()])[0]
        assert sum(small.scores[i] for i in ids) == pytest.approx(best("▁".encode() + t.encode()))
    coded = pieces.encode_pieces(docs, path("piece_bpe_32k.model"))
    assert coded.where("NOT round_trip").count() == 0
    back = Counter((r.doc_id, r.text) for r in pieces.decode_pieces(coded, path("piece_bpe_32k.model")).collect())
    assert back == Counter((i, t or "") for i, t, *_ in corpus())


def test_long_words_take_the_same_path():
    words = pieces.vocabulary(path("piece_bpe_32k.model"))
    rng = random.Random(3)
    for alphabet in ("abcdefgh", "aé▁一\U0001f600z", "theing"):
        text = "".join(rng.choice(alphabet) for _ in range(900)).encode()
        marked = re.sub(rb" ", pieces.MARK, (b" " + text).replace(pieces.MARK, b"\xff" * 3))
        assert words._walk(marked) == words._search([marked])[0]
    long = "".join(rng.choice("theingaé") for _ in range(300_000)).encode()
    began = time.time()
    assert words.decode(words.encode([long])[0]) == long and time.time() - began < 20
    assert max(map(len, words.table), default=0) <= pieces.LONG


def test_licences(docs):
    scan = licences.Scanner().scan
    assert scan(b"the MIT License; cc-by, Apache  LICENSE")["base_labels"] == "apache,cc-by,mit"
    got = scan(b"x GNU general public license y gnu General Public License")
    assert (got["n_base"], got["first_word"], got["last_word"]) == (2, 1, 6)
    whole = scan(b"zz " + licences.TEMPLATES["mit"].encode() + b" zz")
    assert whole["labels"] == "mit" and whole["score"] == 1.0 and whole["spans"][0]["first_word"] == 1
    assert scan(b"")["labels"] == "" and scan(b"nothing here")["score"] == 0
    rng, automaton = random.Random(1), licences.SuffixAutomaton([[1, 2, 1, 3], [2, 1, 2, 2]])
    for _ in range(50):
        ids = [rng.randint(1, 3) for _ in range(12)]
        for end, (_, length) in enumerate(automaton.statistics(ids)):
            parts = [ids[a : end + 1] for a in range(end + 1)]
            assert length == max((len(p) for p in parts if any(s[k : k + len(p)] == p for s in ([1, 2, 1, 3], [2, 1, 2, 2]) for k in range(4))), default=0)


def best_cover(template, words, min_match, max_gap):
    """Brute force: template words covered by the best chain of matches that cannot be extended."""
    n, m = len(words), len(template)
    items = []
    for last in range(n):
        sizes = {e: next(k for k in range(min(last, e) + 2) if k > min(last, e) or words[last - k] != template[e - k]) for e in range(m)}
        most = max(sizes.values())
        longer = max((next(k for k in range(min(last + 1, e) + 2) if k > min(last + 1, e) or words[last + 1 - k] != template[e - k]) for e in range(m)), default=0) if last + 1 < n else 0
        if most >= min(min_match, m) and longer <= most:
            items += [(last - most + 1, last, e) for e, k in sizes.items() if k == most]

    def grow(at):
        f, last, e = items[at]
        found = last - f + 1
        for j, (f2, l2, e2) in enumerate(items):
            gain = found2 = l2 - f2 + 1
            gain = found2 - max(0, last - f2 + 1, e - (e2 - found2))
            if l2 > last and f2 > f and e2 > e and f2 - last - 1 <= max_gap and gain > 0:
                found = max(found, last - f + 1 + gain + grow(j) - found2)
        return found

    return max((grow(k) for k in range(len(items))), default=0)


def test_licence_chains_equal_brute_force():
    rng = random.Random(4)
    scanner = licences.Scanner({"x": "a b c a b d a b c e f a b", "y": "c d a b c"}, {}, 2, 2)
    for _ in range(150):
        words = [rng.choice(["a", "b", "c", "d", "e", "f", "zz"]) for _ in range(rng.randint(1, 16))]
        ids = np.array([scanner.ids.get(w.encode(), 0) for w in words])
        by = {}
        for k, *item in scanner.matches(ids):
            by.setdefault(k, []).append(tuple(item))
        for k, text in enumerate(("a b c a b d a b c e f a b", "c d a b c")):
            assert max(scanner.best_chains(by.get(k, []))[0], default=0) == best_cover(text.split(), words, 2, 2)


def test_licence_spans():
    scan = licences.Scanner().scan
    words = licences.TEMPLATES["bsd"].split()
    words[20], words[50] = "changed", "too"
    got = scan(" ".join(words).encode())
    assert got["labels"] == "bsd" and got["score"] > 0.9
    twice = scan((licences.TEMPLATES["mit"] + " . " + licences.TEMPLATES["mit"]).encode())
    assert [s["share"] for s in twice["spans"] if s["label"] == "mit"] == [1.0, 1.0]
    many = scan((licences.TEMPLATES["isc"] + " ").encode() * 300)
    assert sum(s["label"] == "isc" for s in many["spans"]) == 300


def test_licence_table_equals_brute_force(docs, spark):
    rng = random.Random(9)
    parts = ["GNU", "general", "Public", "license", "apache", "cc", "by", "MIT", "x", "é", "7"]
    texts = [("", " ", "-")[k % 3].join([""]) + " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for k in range(60)] + ["cc-by,apache_license", "mit\u00a0license", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    want = []
    for r in frame.collect():
        w = "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in r.text or "").split(" ")
        w = [x for x in w if x]
        found = [(a, label) for p, label in licences.PHRASES.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        want.append((r.doc_id, len(w), len(found), min((a for a, _ in found), default=None), max((a for a, _ in found), default=None), ",".join(sorted({x for _, x in found}))))
    got = licences.licence_scan(frame).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[40:80] = x[40]
    rows = [(i, [float(v) for v in x[i]], "e") for i in range(600)]
    odd = [(700, None, "e"), (720, [0.0] * 16, "e"), (740, [float("nan")] * 16, "e"), (760, [None] * 16, "e"), (780, [1.0], "e"), (3, rows[3][1], "e"), (None, rows[4][1], "e")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, v string")
    got = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        true = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        hits += len({i for _, i, _ in found} & set(true))
    assert hits >= 0.9 * 600
    assert neighbours.nearest(frame.limit(0)).count() == 0


def recall_of(found, x):
    hits = 0
    for r in found.groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        s = x @ x[r.query_id]
        s[r.query_id] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(r.ids))
    return hits / (20 * -(-len(x) // 20))


@pytest.mark.parametrize(("kind", "most", "sample"), [("none", 0.7, 2_560_000), ("clustered", 0.2, 2_560_000), ("none", 0.9, 64_000), ("wide", 0.45, 2_560_000)])
def test_neighbours_recall_and_scored_share(spark, monkeypatch, kind, most, sample):
    """Without any structure, in clusters, with a sample of a quarter, and with few strong directions; ranges and windows in several parts.

    ``most`` bounds all work of a query, products with window means and pairs scored, of a scan."""
    monkeypatch.setattr(neighbours, "RANGE", 700)
    monkeypatch.setattr(neighbours, "SAMPLE", sample)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    if kind == "clustered":
        x = rng.normal(size=(100, 64))[rng.integers(0, 100, 4000)] + 0.2 * x
    elif kind == "wide":
        x *= 1 / np.arange(1, 65)
    else:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").cache()
    assert recall_of(neighbours.nearest(frame), x) >= 0.9
    scored = neighbours.finds(frame)[0].agg(F.sum("scored")).first()[0]
    windows = max(1, min(4000, max(64, sample // 64), 4000 // neighbours.WINDOW))
    assert windows <= 4000 / 16  # products of a query with window means are a sixteenth of a scan at most
    assert windows / 4000 + scored / (200 * 4000) <= most


@pytest.mark.parametrize("n", [2000, 4000, 10_000])
def test_curves_find_what_random_orders_do_not(n, monkeypatch):
    """The place on the curves decides: orders by a random key need more than a scan for the same recall, at every size."""
    rng = np.random.default_rng(n)
    x, ids = rng.normal(size=(n, 64)), list(range(n))
    asked = rng.choice(n, 60, replace=False)
    near = []
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argsort(-s)[:20]
        near.append((top.tolist(), x[top]))
    curves = neighbours.Curves(x, ids, n)
    assert curves.windows <= n / 16
    share = curves.share_for(x[asked], near)
    monkeypatch.setattr(neighbours.Curves, "keys", lambda self, c, y, ids: np.array([words.hash64(f"{c} {i}".encode()) >> 1 for i in ids]))
    assert share < 0.85 and neighbours.Curves(x, ids, n).share_for(x[asked], near) == 1.0


def test_hilbert_keys_are_a_walk():
    """Every cell has its own key, and neighbours in key are neighbours in space."""
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(points, 3)
    walk = points[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    named = languages.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in named]) > 0.95


def test_models_on_odd_rows(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len(quality.quality_scores(docs, labels.limit(0)).collect()) == docs.count()
    named = languages.language_ids(docs).collect()
    assert len(named) == docs.count()
    assert all(r.lang_pred in ("en", "fr", "und") for r in named)
    texts = {r[0]: r[1] for r in corpus()}
    assert all((r.lang_pred == "und") == (not languages.has_letter((texts[r.doc_id] or "").encode())) for r in named if r.doc_id is not None)


def test_word_forms_read_whole_words():
    assert quality.word_form(b"AbcDefGhIjK1") != quality.word_form(b"AbcDefGhIj--9")
    assert quality.word_form(b"aaBB12--!") == b"aA0-!" and quality.word_form("éÉ１".encode()) == b"aA0"
    assert len(quality.word_form(b"aB" * 100_000)) == 200_000


def test_training_follows_the_regularised_leader():
    """Against the published per-coordinate updates, one coordinate at a time."""
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 12, 5)), int(rng.integers(0, 2))) for _ in range(40)]
    model = quality.FollowTheLeader(12)
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= model.l1 else -(z[i] - np.sign(z[i]) * model.l1) / ((model.beta + np.sqrt(n[i])) / model.alpha + model.l2)

    for at, y in rows:
        x = rng.uniform(0.2, 1, len(at))
        model.learn(at, x, y)
        pairs = [*zip(at.tolist(), x, strict=True), (12, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in pairs)))
        for i, v in pairs:
            g = (p - y) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / model.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(model.frozen(), [weight(i) for i in range(13)], atol=1e-6)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (64, 9, 31, 64, 1)]
    data, valid, _ = languages.windows_of(texts)
    label, net = np.array([0, 1, 2, 1, 0]), languages.Network(["a", "b", "c"])
    grads, _ = net.gradients(data, valid, label)
    for p, g in zip(net.params, grads, strict=True):
        size = float((g.astype(float) ** 2).sum())
        step = np.float32(0.02 / np.sqrt(size))
        held = p.copy()
        losses = []
        for sign in (1, -1):
            p[...] = held + sign * step * g
            losses.append(net.gradients(data, valid, label)[1])
        p[...] = held
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(size, rel=0.03)


def test_every_language_is_learnt(spark):
    rows = [(i, chr(97 + i % 26) * 3 + " " + str(i), f"l{i % 300:03d}") for i in range(1500)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "binary(text) AS text", "lang", "false AS held_out")
    names, slices = languages.examples(own, 400)
    seen = [x for _, label in slices() for x in label]
    assert names == [f"l{i:03d}" for i in range(300)] and set(seen) == set(range(300))
    odd = own.selectExpr("if(doc_id % 2 = 0, null, cast(doc_id AS string)) AS doc_id", "text", "lang", "held_out")
    assert sum(len(label) for _, label in languages.examples(odd, 400)[1]()) == 1500


def test_slices_do_not_change_what_is_learnt_from(docs, spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    own = docs.selectExpr("doc_id", "binary(text) AS text")
    read = lambda: sorted((y, a.tolist()) for part in quality.examples(own, labels, "doc_id", "quality", 40)()  for a, _, y in part)
    whole = read()
    monkeypatch.setattr(quality, "SLICE", 500)
    assert read() == whole and len(whole) > 30


def test_rows_of_one_id_are_bounded(spark):
    many = spark.range(50_000).selectExpr("7L AS doc_id", "binary(concat('w', id)) AS text")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1)], "doc_id long, quality int")
    assert sum(len(part) for part in quality.examples(many, labels, "doc_id", "quality", 100)()) == 100


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for made in (quality.quality_scores(empty, labels), languages.language_ids(empty), fp.fingerprints(empty), mixing.mix(empty), token_counts.token_counts(empty, path("word_bpe_49k.json")), jaccard.near_classes(empty), substrings.substring_dedup(empty), licences.licence_scan(empty), pieces.encode_pieces(empty, path("piece_bpe_32k.model"))):
        assert made.count() == 0
