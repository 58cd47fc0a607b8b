"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``CURVES`` curves projects the vectors to ``DIMS`` orthonormal directions (those of the
first curves are the principal axes of a sample, the others random), scales them by sample
quantiles, shifts them and orders them by their place on a Hilbert curve. The order is cut into
windows of at least ``WINDOW`` rows of the table, whose mean projections are known from the sample. A query takes the windows, of
all curves together, whose means promise the largest inner products with its own projections;
neighbouring windows lie in one range of the order, are read together and reranked by exact
inner products in double precision, and the finds of all curves merge. Equal vectors are
indexed once; a find stands for all of them, in order of their id.

How many windows a query takes is fitted: the share of all rows with which ``ASKED`` sampled
queries (fewer in small tables) find ``TARGET`` of their true neighbours, which one pass over
the table gives; if that share is the whole table, the windows of one curve are taken. The curves' sample has ``SAMPLE`` numbers (documented parameter: 40,000 vectors
of 64 dimensions, those with the smallest hash of their id, all if there are fewer); every
vector is indexed. Clustered data need a small share, data without structure a large one;
measured shares and recall are in the README. Ranges hold about ``RANGE`` rows at any size of
table: windows that hold more are dealt to several.

Defined results: vectors that are null or zero, hold null or non-finite components, or
have another length than most take no part, as queries or candidates; nor do null ids.
Repeated rows (equal id and vector) count once. Ties go to smaller ids. Fewer candidates than
k: all of them. Very long vectors only make the sample smaller. An empty table gives an empty
result. Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import cut, hash64, reachable_by_workers, tidy

CURVES, DIMS, BITS, SEED = 8, 8, 6, 5
#: Rows of the table in a window at least, rows in a range, numbers in the sample.
WINDOW, RANGE, SAMPLE = 16, 1 << 15, 2_560_000
ASKED, TARGET = 128, 0.93


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points [n, dims] (0 <= x < 2**bits) on the Hilbert curve of their cube.

    Axes are folded from the highest bit down: each bit decides whether the lower bits of the
    first axis are mirrored or swapped with its own; a Gray code over axes gives the place."""
    axes = [points[:, k].astype(np.int64).copy() for k in range(points.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k, axis in enumerate(axes):
            upper = (axis >> bit) & 1 == 1
            swap = np.where(upper, 0, (axes[0] ^ axis) & low)
            axes[0] ^= np.where(upper, low, swap)
            if k:
                axes[k] = axis ^ swap
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    turn = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    key = np.zeros(len(points), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ turn) >> bit) & 1).astype(np.uint64)
    return key


class Curves:
    """Projections, scales, window edges and the windows' means, fitted on sample vectors of a table of so many rows."""

    def __init__(self, sample: np.ndarray, ids: list[int], rows: int):
        rng, size = np.random.default_rng(SEED), sample.shape[1]
        dims, bases = min(DIMS, size), []
        axes = np.linalg.eigh(np.cov(sample.T).reshape(size, size))[1][:, ::-1]
        while len(bases) < CURVES:
            bases += [axes[:, a : a + dims] for a in range(0, size - dims + 1, dims)]
            axes = np.linalg.qr(rng.normal(size=(size, size)))[0]
        self.axes = bases[:CURVES]
        self.shift = rng.integers(0, 1 << BITS, (CURVES, dims))
        self.cuts = [np.quantile(sample @ a, np.linspace(0, 1, 1 << BITS)[1:-1], axis=0) for a in self.axes]
        self.windows = max(1, min(len(sample), rows // WINDOW))
        self.edges, self.means = [], []
        for c, a in enumerate(self.axes):
            keys = self.keys(c, sample, ids)
            self.edges.append(np.sort(keys)[(np.arange(1, self.windows) * len(keys)) // self.windows])
            at, y = np.searchsorted(self.edges[c], keys, "right"), sample @ a
            count = np.maximum(1, np.bincount(at, minlength=self.windows))
            # an axis' own mean is in every window alike, so only what is above it tells windows apart
            self.means.append(np.stack([np.bincount(at, y[:, k] - y[:, k].mean(), self.windows) / count for k in range(dims)], axis=1).astype(np.float32))

    def keys(self, c: int, x: np.ndarray, ids: list[int]) -> np.ndarray:
        """Place on curve c, then a hash of the id, so that equal places can be told apart."""
        y = x @ self.axes[c]
        cell = np.stack([np.searchsorted(self.cuts[c][:, k], y[:, k], "right") for k in range(y.shape[1])], axis=1)
        tie = np.array([hash64(str(i).encode()) & 0x7FFF for i in ids], np.int64)
        # the shift turns the cube, and so what the curve tears apart, without moving points out of it
        return (hilbert_keys(cell ^ self.shift[c], BITS).astype(np.int64) << 15) | tie

    def window(self, c: int, x: np.ndarray, ids: list[int]) -> np.ndarray:
        return np.searchsorted(self.edges[c], self.keys(c, x, ids), "right")

    def promise(self, q: np.ndarray) -> np.ndarray:
        """What each window's mean adds to a query's inner products, [curves, windows]."""
        return np.stack([self.means[c] @ (q @ self.axes[c]).astype(np.float32) for c in range(CURVES)])

    def taken(self, q: np.ndarray, share: float) -> np.ndarray:
        """Windows that a query takes, [curves, windows]."""
        if share >= 1:
            return np.repeat(np.arange(CURVES) == 0, self.windows).reshape(CURVES, -1)
        promise = self.promise(q)
        n = max(1, round(share * self.windows))
        return promise >= np.partition(promise, promise.size - n, axis=None)[promise.size - n]

    def share_for(self, queries: np.ndarray, near: list[tuple[list[int], np.ndarray]]) -> float:
        """The share with which queries find TARGET of their neighbours."""
        need = []
        for q, (ids, x) in zip(queries, near, strict=True):
            if not ids:
                continue
            promise = self.promise(q)
            best = np.max([promise[c, self.window(c, x, ids)] for c in range(CURVES)], axis=0)
            need += (promise.size - np.searchsorted(np.sort(promise, axis=None), best, "left")).tolist()
        return min(1.0, np.quantile(need, TARGET, method="higher") / self.windows) if need else 1.0


class Ranges:
    """Windows to ranges of a table of n rows: neighbouring windows share one, a window with too many rows has several."""

    def __init__(self, n: int, windows: int):
        want = max(1, -(-n // RANGE))
        self.windows, self.groups, self.parts = windows, min(want, windows), max(1, -(-want // windows))
        self.each = self.groups * self.parts

    def group(self, window):
        return window * self.groups // self.windows

    def of(self, curve: int, window, part):
        return (curve * self.groups + self.group(window)) * self.parts + part


_ENTRY = pa.schema([("range", pa.int32()), ("query", pa.bool_()), ("rep", pa.int64()), ("window", pa.int32()), ("vector", pa.binary()), ("taken", pa.binary())])
_FIND = pa.schema([("query_rep", pa.int64()), ("rep", pa.int64()), ("score", pa.float64()), ("scored", pa.int64())])


def _place(sent, ranges: Ranges, share: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = sent.value
        bounds = np.searchsorted(ranges.group(np.arange(ranges.windows)), np.arange(ranges.groups + 1))
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                ids, x = batch.column(0).to_pylist(), np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                raw = [v.tobytes() for v in x]
                rows = []
                for c in range(CURVES):
                    for i, w, v in zip(ids, curves.window(c, x, ids).tolist(), raw, strict=True):
                        rows.append((ranges.of(c, w, hash64(str(i).encode()) % ranges.parts), False, i, w, v, None))
                for k in np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)):
                    taken = curves.taken(x[k], share)
                    for c in range(CURVES):
                        for g in range(ranges.groups):
                            held = taken[c, bounds[g] : bounds[g + 1]]
                            if held.any():
                                bits = np.packbits(held).tobytes()
                                rows += [(ranges.of(c, int(bounds[g]), p), True, ids[k], int(bounds[g]), raw[k], bits) for p in range(ranges.parts)]
                yield pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY)

    return place


def _score(k: int):
    def best(ids: np.ndarray, x: np.ndarray, window: np.ndarray, rep: int, first: int, vector: bytes, bits: bytes):
        taken = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        at = np.flatnonzero(taken[window - first])
        if not len(at):
            return None
        score = x[at] @ np.frombuffer(vector)
        if len(at) > k:
            near = np.flatnonzero(score >= np.partition(score, len(at) - k)[len(at) - k])
        else:
            near = np.arange(len(at))
        near = near[np.lexsort((ids[at[near]], -score[near]))][:k]
        return np.full(len(near), rep), ids[at[near]], score[near], np.concatenate(([len(at)], np.zeros(len(near) - 1, np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out, held = None, [], [], None
        for batch in batches:
            for number, query, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now:
                    now, rows, held = number, [], None
                if not query:
                    rows.append(row[:3])
                elif rows:
                    if held is None:  # all rows of a range come before its queries
                        ids, window, vectors = zip(*rows, strict=True)
                        held = np.array(ids, np.int64), np.frombuffer(b"".join(vectors)).reshape(len(ids), -1), np.array(window, np.int64)
                        rows = [None]
                    if found := best(*held, *row):
                        out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_FIND)
                out = []

    return score


def _true_neighbours(reps: DataFrame, ids: list[int], queries: np.ndarray, k: int) -> list[tuple[list[int], np.ndarray]]:
    """Ids and vectors of the k nearest of each of a few queries, by one pass over the table; a task sends its k best."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[] for _ in ids]
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                rep, x = batch.column(0).to_numpy(), np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                scores = queries @ x.T
                for i, (own, line) in enumerate(zip(ids, scores, strict=True)):
                    near = np.argpartition(-line, k)[: k + 1] if len(line) > k + 1 else np.arange(len(line))
                    found[i] = sorted([*found[i], *((-line[j], int(rep[j]), x[j].tobytes()) for j in near if rep[j] != own)])[:k]
        rows = [(i, *r) for i, held in enumerate(found) for r in held]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.binary()), strict=True)], names=["q", "s", "rep", "v"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("q", pa.int32()), ("s", pa.float64()), ("rep", pa.int64()), ("v", pa.binary())]))

    sent = reps.select("rep", "v").mapInArrow(tidy(best), "q int, s double, rep long, v binary")
    first = sent.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("s", "rep"))).where(F.col("r") <= k).select("q", "rep", "v").collect()
    near: list[list] = [[] for _ in ids]
    for r in first:
        near[r["q"]].append((r["rep"], np.frombuffer(bytes(r["v"]))))
    return [([i for i, _ in held], np.array([x for _, x in held]).reshape(-1, queries.shape[1])) for held in near]


def finds(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(query_rep, rep, score, scored: pairs scored for these finds, at one of them), (rep, v, asks, members) and (id, v); None if no vector takes part."""
    spark = vectors.sparkSession
    v = F.col("v")
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    own = own.withColumn("square", square).where("square > 0 AND square < double('Infinity') AND NOT isnan(square)")
    sizes = own.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return None
    own = own.where(F.size("v") == sizes["size"]).select("id", "v").distinct()
    # each distinct vector keeps its k + 1 smallest ids, which is all that an answer can name; partial limits come before the shuffle
    low = own.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    asks = own.where(F.pmod("id", F.lit(every)) == 0).groupBy("v").agg(F.lit(True).alias("asks"))
    reps = low.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members"))
    reps = cut(reps.join(asks, "v", "left").select(F.col("members")[0].alias("rep"), "v", F.coalesce("asks", F.lit(False)).alias("asks"), "members"))
    n, most = reps.count(), max(64, SAMPLE // sizes["size"])
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(most).select("rep", "v").toArrow()
    ids, x = sample["rep"].to_pylist(), np.array(sample["v"].combine_chunks().flatten()).reshape(-1, sizes["size"])
    curves = Curves(x, ids, n)
    asked = np.linspace(0, len(ids) - 1, min(len(ids), ASKED, max(24, n // 100))).astype(int)
    share = curves.share_for(x[asked], _true_neighbours(reps, [ids[i] for i in asked], x[asked], k))
    ranges, sent = Ranges(n, curves.windows), spark.sparkContext.broadcast(curves)  # means, cuts and edges of a bounded sample
    del sample, x
    placed = reps.select("rep", "v", "asks").mapInArrow(tidy(_place(sent, ranges, share)), "range int, query boolean, rep long, window int, vector binary, taken binary")
    dealt = placed.repartitionById(CURVES * ranges.each, "range").sortWithinPartitions("range", "query")
    return dealt.mapInArrow(tidy(_score(k + 1)), "query_rep long, rep long, score double, scored long"), reps, own


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    reachable_by_workers(vectors.sparkSession)
    made = finds(vectors, k, every, vec_id, vector)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found, reps, own = made
    merged = found.groupBy("query_rep", "rep").agg(F.max("score").alias("score"))
    first = merged.withColumn("r", F.row_number().over(W.partitionBy("query_rep").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1)
    named = first.join(reps.select("rep", "members"), "rep").select("query_rep", "score", F.explode("members").alias("vec_id"))
    queries = own.where(F.pmod("id", F.lit(every)) == 0).join(reps.where("asks").select("v", F.col("rep").alias("query_rep")), "v").select(F.col("id").alias("query_id"), "query_rep")
    ranked = queries.join(named, "query_rep").where("query_id <> vec_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
