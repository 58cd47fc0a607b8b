"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Features of a text are its word n-grams, hashed to ``BUCKETS``: the words themselves
(1- and 2-grams) and word forms (1-, 2- and 3-grams), in which letters are told apart only
by case, digits are one sign and repeated signs count once, so that a form recurs in texts
that share no word; a word equal to the one before has a form of its own. A feature weighs
the square root of its share of the text's words. A score is the logistic function of one
sparse dot product; training follows the regularised leader, one text at a time.

Training reads a bounded sample: the ``SAMPLE`` labelled training rows with the smallest
hash of their id (documented parameter; every labelled row if there are fewer), each with its
whole text. Their features are made by the executors and come to the driver in slices of
about ``SLICE`` entries, so its memory does not depend on how long the texts are.

Defined results: null and empty texts have no features and get the score of the bias; very
long texts are read whole, one at a time. Labels that are null or not 0/1 are not learnt from;
several labels of an id all count, rows that are equal in id, text and label count once in
training. Without any label all scores are 0.5. Repeated rows are kept; an empty table gives
an empty result; only id, text and label are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, BoundedTable, cut, hash64, mix, reachable_by_workers, tidy, word_hashes

BUCKETS, SAMPLE, EPOCHS, SLICE = 1 << 20, 6000, 3, 1 << 22
_SALT = [U64(0xA24BAED4963EE407 * k % (1 << 64)) for k in range(1, 6)]
_SIGN = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUN, _RUN_OF_CHARS = re.compile(rb"(.)\1+", re.DOTALL), re.compile(r"(.)\1+", re.DOTALL)


def word_form(word: bytes) -> bytes:
    """The signs of the whole word, each run of one sign once."""
    if word.isascii():
        return _RUN.sub(rb"\1", word.translate(_SIGN))
    text = word.decode("utf-8", "replace")
    signs = {ord(c): ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c for c in set(text)}
    return _RUN_OF_CHARS.sub(r"\1", text.translate(signs)).encode("utf-8", "replace")


_FORMS = BoundedTable(lambda w: hash64(word_form(w)))
_AGAIN = U64(hash64(b"<again>"))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights; empty for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    w = word_hashes(words)
    f = np.fromiter(map(_FORMS.__getitem__, words), U64, n)
    f[1:][w[1:] == w[:-1]] = _AGAIN
    three = U64(3)
    grams = [mix(w + _SALT[0]), mix(f + _SALT[1]), mix(w[:-1] * three + w[1:] + _SALT[2]), mix(f[:-1] * three + f[1:] + _SALT[3]), mix((f[:-2] * three + f[1:-1]) * three + f[2:] + _SALT[4])]
    found, count = np.unique(np.concatenate(grams) % U64(BUCKETS), return_counts=True)
    return found.astype(np.int64), np.sqrt(count / n)


class FollowTheLeader:
    """FTRL-proximal logistic regression with per-coordinate rates."""

    def __init__(self, size: int = BUCKETS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)  # the bias stands last
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def frozen(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def score_of(weights: np.ndarray, text: bytes) -> float:
    at, x = features(text)
    return float(1 / (1 + np.exp(-np.clip(float(weights[-1]) + weights[at] @ x, -35, 35))))


def train(slices: Callable[[], Iterable[list[tuple[np.ndarray, np.ndarray, int]]]]) -> np.ndarray:
    """From examples (feature numbers, weights, label), read anew for every pass unless they are one slice."""
    model, kept = FollowTheLeader(), None
    for _ in range(EPOCHS):
        n = 0
        for n, held in enumerate(kept or slices(), 1):
            for at, x, y in held:
                model.learn(at, x, y)
        kept = [held] if n == 1 else None
    return model.frozen()


def held_out(doc_id: str, of: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of)) == rest, F.lit(False))


_EXAMPLE = "doc_id {}, th long, y int, at array<int>, x array<float>"


def examples(own: DataFrame, labels: DataFrame, doc_id: str, label: str, sample: int) -> Callable[[], Iterable[list]]:
    """The sample's examples, slice by slice; which rows are in a slice and in what order depends on their ids and texts alone."""
    spark = own.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id, 5, 0)).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).distinct()
    order = [F.xxhash64("doc_id"), "doc_id", "y"]
    ids = known.orderBy(*order).limit(sample)
    # an id may have many rows: the sample is cut again by rows, of which only hashes travel
    narrow = own.select("doc_id", F.xxhash64("text").alias("th")).join(F.broadcast(ids), "doc_id").distinct()
    picked = cut(narrow.orderBy(*order, "th").limit(sample))
    kind = own.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                found = [features(t or b"") for t in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([at.astype(np.int32) for at, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], names=["doc_id", "th", "y", "at", "x"])

    rows = own.select("doc_id", F.xxhash64("text").alias("th"), "text").join(F.broadcast(picked), ["doc_id", "th"]).select("doc_id", "th", "y", "text")
    held = cut(rows.mapInArrow(tidy(made), _EXAMPLE.format(kind)).dropDuplicates(["doc_id", "th", "y"]))
    entries = held.agg(F.sum(F.size("at") + 1)).first()[0] or 0
    n = max(1, -(-entries // SLICE))
    slice_of = F.pmod(F.xxhash64("doc_id", "th"), F.lit(n))

    def slices() -> Iterator[list]:
        for k in range(n):
            part = held.where(slice_of == k).orderBy(*order, "th").select("y", "at", "x").toArrow()
            yield [(np.array(a, np.int64), np.array(x, float), y) for y, a, x in zip(part["y"].to_pylist(), part["at"].to_numpy(), part["x"].to_numpy(), strict=True)]

    return slices


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document."""
    spark = docs.sparkSession
    reachable_by_workers(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), held_out(doc_id, 5, 0).alias("held_out"))
    weights = spark.sparkContext.broadcast(train(examples(own, labels, doc_id, label, sample)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            found = [score_of(w, t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(tidy(score), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, score double, predicted int")
