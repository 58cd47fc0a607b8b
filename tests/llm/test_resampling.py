"""Importance resampling and near vectors against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoscape.llm import near_vectors as nv
from genoscape.llm import resampling

SCHEMA = "doc_id long, text string, score string, rank int, bucket string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts() -> list[tuple]:
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["É", "naïve", "日本", "x\x80y"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " ,;- "), (203, "WORD Word word " * 30), (204, "a" * 100_000), (None, "no id " * 40), (3, rows[3][1]), (3, rows[3][1]), (5, "other text of the same id " * 9)]
    return [(i, t, "s", 1, "b") for i, t in rows]


def brute(rows, target, least=1, most=1, buckets=10_000, least_words=20, percent=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        w = WORD.findall((t or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(least, most + 1) for k in range(len(w) - n + 1)]

    docs = [(i, *features(t)) for i, t, *_ in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return Counter((r[0], *r[2:]) for r in out)


@pytest.mark.parametrize("least,most,percent", [(1, 1, 10), (1, 2, 50), (2, 3, 100)])
def test_resampling(spark, least, most, percent):
    target = ["WORD abc, naïve", None, "", "日本 É " * 5]
    docs = spark.createDataFrame(texts(), SCHEMA).repartition(5)
    held = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(docs, held, least, most, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == brute(texts(), target, least, most, percent=percent)


def test_resampling_of_nothing(spark):
    docs, none = spark.createDataFrame(texts(), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert resampling.resampled(none, docs).count() == 0
    assert Counter(map(tuple, resampling.resampled(docs, none).collect())) == brute(texts(), [])


def test_ranks_of_one_value_in_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("score"), "id")
    placed, n = resampling.ranked(rows, F.col("id") >= 10, "score", "id")
    got = {r.id: r.rank for r in placed.collect()}
    want = {i: k + 1 for k, i in enumerate(sorted(range(10, 1000), key=lambda i: (-(i % 3), i)))}
    assert n.first()[0] == 990 and got == want | {i: None for i in range(10)}


def near(rows: list[tuple], cosine: float):
    """(id, links, component, kept) of rows (id, vector, label), all pairs by numpy."""

    def valid(r):
        x = r[1]
        return r[0] is not None and r[2] is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)

    use = [valid(r) for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if u else None for r, u in zip(rows, use, strict=True)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if use[i] and use[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                if a != b:
                    root[a] = b
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(r[0], low.get(top(i), r[0]))
    return Counter((r[0], links[i], None if r[0] is None else low[top(i)], r[0] is None or r[0] == low[top(i)]) for i, r in enumerate(rows))


VECTORS = "id long, x array<double>, kind string, n int, key string, label string"


def vectors(size: int = 24) -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = []
    for group in range(12):
        centre = rng.normal(size=size)
        for _ in range(rng.integers(1, 40)):
            rows.append((centre + rng.normal(size=size) * 0.1 * rng.random()).tolist())
    rows += rng.normal(size=(150, size)).tolist()
    labels = ["a", "a", "a", "b", None]
    out = [(1000 - 3 * i, x, labels[i % 5]) for i, x in enumerate(rows)]
    one = rows[0]
    out += [(5000 + i, one, "a") for i in range(30)] + [(5000, one, "a"), (5001, [2 * v for v in one], "a"), (5002, one, "b"), (5003, one[:-1], "a"), (5004, one[:-1], "a"), (5005, [*one, 1.0, 2.0], "a")]
    out += [(6000, None, "a"), (6001, [], "a"), (6002, [0.0] * size, "a"), (6003, [None, *one[1:]], "a"), (6004, [math.nan, *one[1:]], "a"), (6005, [math.inf, *one[1:]], "a"), (6006, one, None), (None, one, "a"), (None, None, None)]
    out += [(6007, [1e200 * v for v in one], "a"), (6008, [1e-200 * v for v in one], "a"), (6009, [-v for v in one], "a")]
    return [(i, x, k, 1, "k", "l") for i, x, k in out]


@pytest.mark.parametrize("cosine", [0.98, 0.9, 0.5])
@pytest.mark.parametrize("split", [False, True])
def test_near_vectors(spark, cosine, split, monkeypatch):
    if split:  # blocks are cut into grids, pairs come in small pieces
        monkeypatch.setattr(nv, "FAIR", 8)
        monkeypatch.setattr(nv, "BLOCK", 4)
        monkeypatch.setattr(nv, "PAIRS", 7)
    rows = [(i, x, k) for i, x, k, *_ in vectors()]
    got = nv.near_vectors(spark.createDataFrame(vectors(), VECTORS).repartition(3), cosine, "id", "x", "kind")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = near([(i, [v / max(abs(w) for w in x) for v in x] if i in (6007, 6008) else x, k) for i, x, k in rows], cosine)
    assert Counter(map(tuple, got.collect())) == want


def test_near_vectors_of_odd_tables(spark):
    assert nv.near_vectors(spark.createDataFrame([], VECTORS), 0.98, "id", "x", "kind").count() == 0
    lone = spark.createDataFrame([(1, None, None, 1, "k", "l"), (2, [0.0], "a", 1, "k", "l")], VECTORS)
    assert Counter(map(tuple, nv.near_vectors(lone, 0.98, "id", "x", "kind").collect())) == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1})
    short = [(i, [float(i % 3 - 1)], "a", 1, "k", "l") for i in range(30)]
    assert Counter(map(tuple, nv.near_vectors(spark.createDataFrame(short, VECTORS), 0.98, "id", "x", "kind").collect())) == near([r[:3] for r in short], 0.98)


def test_bits_are_balanced_and_lookups_lose_nothing():
    rng = np.random.default_rng(2)
    x = nv.unit_vectors(rng.normal(size=(3000, 96)) * np.linspace(2, 0.1, 96) + 1)
    rotation = nv.Rotation(x)
    y = rotation.of(x)
    assert np.allclose(rotation.axes.T @ rotation.axes, np.eye(64), atol=1e-9)
    assert np.abs((y >= 0).mean(0) - 0.5).max() < 0.1
    plain = (x - x.mean(0)) @ np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :64]

    def loss(z):
        return ((z - np.where(z >= 0, 1, -1) * np.abs(z).mean()) ** 2).sum()

    assert loss(y) < loss(plain)
    z = rotation.of(nv.unit_vectors(x + rng.normal(size=x.shape) * 0.01))
    budget = 0.02 / 4 + nv.SLACK
    for p, h in zip(y[:200], z[:200], strict=True):
        if ((p - h) ** 2).sum() <= 0.04:
            meet = False
            for bits in rotation.parts:
                for a, b in ((p, h), (h, p)):
                    _, keys, _ = nv.reached(a[None, bits], budget)
                    meet |= int(((b[bits] >= 0).astype(np.int64) << np.arange(len(bits))).sum()) in keys
            assert meet
