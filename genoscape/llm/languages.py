"""Language ID: a bidirectional gated recurrent network over bytes, written in numpy.

A text's bytes are cut into windows of ``WINDOW`` bytes. In each window one network of
``HIDDEN`` gated units reads forwards and one backwards; their states at a byte give a
probability of each language at that position (every position is labelled), and a
document's probabilities are the mean over all its positions. Training minimises the
cross-entropy of the position labels by backpropagation through time over whole windows,
with Adam steps, from a fixed seed.

Training reads a bounded sample (documented parameter): ``SAMPLE`` documents, shared evenly
among all languages that occur (at least ``LEAST`` of each, so no language is left out), those
with the smallest hash of their id and text, each with its whole text. The executors cut them
into windows; these come to the driver in slices of about ``SLICE``, so its memory does not
depend on how long the texts are. A document is held out of training if crc32 of its id
modulo 3 is 1.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
every text if no training row has a language. Languages with the same probability: the first
by name. Very long texts are read whole, one batch at a time. Rows that are equal in id, text
and language count once in training; repeated rows are kept in the result; an empty table
gives an empty result; columns other than id, text and language are not read and may have any
name. Ids may have any type.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import held_out
from .words import cut, reachable_by_workers, tidy

HIDDEN, WINDOW, SAMPLE, LEAST, EPOCHS, TOGETHER, SLICE = 8, 64, 400, 10, 4, 2048, 1 << 18
_ASCII, _LETTER = re.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and bool(_ASCII.search(text) or _LETTER.search(text.decode("utf-8", "replace")))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bytes [WINDOW, n], valid [WINDOW, n], number of windows of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = (np.cumsum(counts) - counts) * WINDOW
    data, valid = np.zeros(int(counts.sum()) * WINDOW, np.uint8), np.zeros(int(counts.sum()) * WINDOW, bool)
    at = np.arange(len(flat)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    data[at], valid[at] = flat, True
    return np.ascontiguousarray(data.reshape(-1, WINDOW).T), np.ascontiguousarray(valid.reshape(-1, WINDOW).T), counts


class Gated:
    """One direction. Gates are computed by tanh alone: sigmoid(a) = (1 + tanh(a / 2)) / 2, the halves are in the parameters' use."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.p = {"w": rng.normal(0, 0.3, (3 * h, 256)), "u": rng.normal(0, 0.3, (3 * h, h)), "b": np.zeros((h, 1))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, data: np.ndarray, valid: np.ndarray, keep: bool = False):
        """States [WINDOW, HIDDEN, n] in the order given; with keep, what going back needs."""
        h, (steps, n) = HIDDEN, data.shape
        w = np.concatenate((self.p["w"][: 2 * h] * np.float32(0.5), self.p["w"][2 * h :]))
        u = np.concatenate((self.p["u"][: 2 * h] * np.float32(0.5), self.p["u"][2 * h :]))
        out, state, kept = np.empty((steps, h, n), np.float32), np.zeros((h, n), np.float32), []
        whole = valid.all(axis=1)
        for t in range(steps):
            x = np.take(w, data[t], axis=1)
            rec = u @ state
            gates = np.tanh(x[: 2 * h] + rec[: 2 * h])
            gates += np.float32(1)
            gates *= np.float32(0.5)
            z, r, inner = gates[:h], gates[h:], rec[2 * h :] + self.p["b"]
            new = np.tanh(x[2 * h :] + r * inner)
            if keep:
                kept.append((state, z, r, inner, new))
            state = new + z * (state - new)
            if not whole[t]:
                state *= valid[t]
            out[t] = state
        return out, kept

    def back(self, data: np.ndarray, valid: np.ndarray, kept, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time; d_out: of the states."""
        h = HIDDEN
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_in = np.empty((len(data), 3 * h, data.shape[1]), np.float32)
        carry = np.zeros_like(d_out[0])
        for t in range(len(data) - 1, -1, -1):
            before, z, r, inner, new = kept[t]
            d = (d_out[t] + carry) * valid[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_inner = d_new * r
            d_in[t] = np.concatenate((d_z, d_r, d_new))
            d_rec = np.concatenate((d_z, d_r, d_inner))
            grad["u"] += d_rec @ before.T
            grad["b"] += d_inner.sum(axis=1, keepdims=True)
            carry = d * z + self.p["u"].T @ d_rec
        flat = data.ravel()
        grad["w"] = np.stack([np.bincount(flat, d_in[:, k].ravel(), 256) for k in range(3 * h)]).astype(np.float32)
        return grad


class Network:
    def __init__(self, names: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.names, self.ways = names, (Gated(rng), Gated(rng))
        self.v, self.c = rng.normal(0, 0.3, (len(names), 2 * HIDDEN)).astype(np.float32), np.zeros((len(names), 1), np.float32)

    def position_probabilities(self, data, valid, keep=False):
        """[WINDOW, languages, n], and what going back needs."""
        ahead, a = self.ways[0].run(data, valid, keep)
        behind, b = self.ways[1].run(data[::-1], valid[::-1], keep)
        both = np.concatenate((ahead, behind[::-1]), axis=1)
        logits = np.matmul(self.v, both) + self.c
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits, (both, a, b)

    def gradients(self, data: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy over all valid positions, in the order of ``params``; and that mean."""
        x, ok = np.ascontiguousarray(data), np.ascontiguousarray(valid)
        d, (both, ahead, behind) = self.position_probabilities(x, ok, keep=True)
        here = np.arange(len(label))
        share = ok / np.float32(max(1, ok.sum()))
        loss = float(-(np.log(d[:, label, here] + 1e-30) * share).sum())
        d[:, label, here] -= 1
        d *= share[:, None, :]
        g_v = np.einsum("tln,thn->lh", d, both)
        g_c = d.sum(axis=(0, 2))[:, None]
        d_both = np.matmul(self.v.T, d)
        one = self.ways[0].back(x, ok, ahead, d_both[:, :HIDDEN])
        two = self.ways[1].back(x[::-1], ok[::-1], behind, d_both[::-1, HIDDEN:])
        return [*one.values(), *two.values(), g_v, g_c], loss

    @property
    def params(self) -> list[np.ndarray]:
        return [*self.ways[0].p.values(), *self.ways[1].p.values(), self.v, self.c]

    def fit(self, slices: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], epochs: int = EPOCHS, size: int = 256, rate: float = 0.02) -> None:
        """Adam steps over slices (bytes, valid, label) of windows, which are read anew for every pass unless there is one."""
        rng = np.random.default_rng(11)
        params = self.params
        m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        kept = None
        for _ in range(epochs):
            n = 0
            for n, (data, valid, label) in enumerate(kept or slices(), 1):
                order = rng.permutation(data.shape[1])
                for a in range(0, len(order), size):
                    pick = order[a : a + size]
                    found, _ = self.gradients(data[:, pick], valid[:, pick], label[pick])
                    step += 1
                    for p, g, mm, ss in zip(params, found, m, s, strict=True):
                        mm += 0.1 * (g - mm)
                        ss += 0.01 * (g * g - ss)
                        p -= (rate * mm / (1 - 0.9**step) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                last = (data, valid, label)
            kept = [last] if n == 1 else None

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the position probabilities of each text, [texts, languages]; texts are not empty."""
        data, valid, counts = windows_of(texts)
        sums = np.empty((data.shape[1], len(self.names)))
        for a in range(0, data.shape[1], TOGETHER):
            x, ok = np.ascontiguousarray(data[:, a : a + TOGETHER]), np.ascontiguousarray(valid[:, a : a + TOGETHER])
            p, _ = self.position_probabilities(x, ok)
            sums[a : a + TOGETHER] = np.einsum("tln,tn->nl", p, ok.astype(np.float32))
        first = np.cumsum(counts) - counts
        return np.add.reduceat(sums, first, axis=0) / np.array([len(t) for t in texts])[:, None]


def train(names: list[str], slices: Callable[[], Iterable[tuple[list[bytes], list[int]]]]) -> Network | None:
    """From slices of windows and the numbers of their languages."""
    if not names:
        return None

    def arrays():
        for texts, label in slices():
            if texts:
                yield (*windows_of(texts)[:2], np.array(label))

    network = Network(names)
    network.fit(arrays)
    return network


def examples(own: DataFrame, sample: int) -> tuple[list[str], Callable[[], Iterable[tuple[list[bytes], list[int]]]]]:
    """All languages of the training rows, and the sample's windows, slice by slice; the sample depends on ids and texts alone."""
    rows = own.where(F.col("lang").isNotNull() & ~F.col("held_out") & (F.length("text") > 0)).select(F.xxhash64("doc_id", "text").alias("k"), "lang", "text")
    found = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("k").alias("low")).orderBy(F.col("lang").cast("binary")).collect()}  # one row a language
    names = list(found)
    each = max(LEAST, sample // max(1, len(names)))
    # a row needs a small hash to be looked at: of a language with very many rows about 8 times the sample's share are;
    # its smallest hash always is, so that a language whose rows are all alike is not lost
    reach = {k: min(1.0, 8 * each / r["n"]) for k, r in found.items()}
    limits = F.create_map(*[F.lit(x) for k, v in reach.items() for x in (k, max(found[k]["low"], (1 << 63) - 1 if v == 1 else int(v * 2.0**64) - (1 << 63)))])
    place = F.row_number().over(W.partitionBy("lang").orderBy("k"))
    narrow = rows.select("k", "lang").where(F.col("k") <= limits[F.col("lang")]) if names else rows.select("k", "lang")
    picked = cut(narrow.distinct().withColumn("place", place).where(F.col("place") <= each).drop("place"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    for a in range(0, len(text), WINDOW << 12):  # a long text goes out bit by bit
                        part = [text[b : b + WINDOW] for b in range(a, min(len(text), a + (WINDOW << 12)), WINDOW)]
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int64()), pa.array(range(a, a + len(part) * WINDOW, WINDOW), pa.int64()), pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary())], names=["k", "at", "lang", "bytes"])

    held = cut(rows.join(F.broadcast(picked), ["k", "lang"]).select("k", "lang", "text").mapInArrow(tidy(windows), "k long, at long, lang string, bytes binary").dropDuplicates(["k", "at", "lang"]))
    n = max(1, -(-held.count() // SLICE))
    number = {name: i for i, name in enumerate(names)}
    mixed = F.xxhash64("k", "at", "lang")

    def slices():
        for i in range(n):
            part = held.where(F.pmod(mixed, F.lit(n)) == i).orderBy(mixed, "k", "at", "lang").select("lang", "bytes").toArrow()
            yield part["bytes"].to_pylist(), [number[x] for x in part["lang"].to_pylist()]

    return names, slices


def language_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, with the columns of ``carry`` in front."""
    spark = docs.sparkSession
    reachable_by_workers(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang"), held_out(doc_id, 3, 1).alias("held_out"))
    network = train(*examples(own, sample))

    front = [F.col(c) for c in carry] if carry is not None else [F.col(doc_id).alias("doc_id"), held_out(doc_id, 3, 1).alias("held_out")]
    sent = carry is not None and text in carry  # then the text is read from its own column, not sent twice
    shown = docs.select(*front, *[] if sent else [F.col(text).alias("__text")])
    at, n = (carry.index(text) if sent else len(front)), len(front)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 400):
                batch = whole.slice(a, 400)
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                known = [k for k, t in enumerate(texts) if has_letter(t)] if network else []
                if known:
                    p = network.pooled([texts[k] for k in known])
                    for k, best in zip(known, p.argmax(axis=1).tolist(), strict=True):
                        names[k] = network.names[best]
                    for k, top in zip(known, p.max(axis=1).tolist(), strict=True):
                        scores[k] = min(1.0, top)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:n], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:n])
    return shown.mapInArrow(tidy(label), f"{schema}, lang_pred string, score double")
