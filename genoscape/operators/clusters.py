"""Structure of a panel: principal components of genotypes and clusters of them, from markers that stay where they are.

Components come from a few passes over the markers (``kernels.leading``). Clusters are found for several numbers
and starts at once: each round is one pass over the genotypes' scores, in which a task returns sums of the
rows nearest to each centre. Starts are drawn by k-means++ on a bounded sample of rows (``SAMPLE``, those with
the smallest hash of their id), every row is clustered."""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Operator, cut, importable
from .kernels import leading
from .models import Panel

SAMPLE, STARTS, ROUNDS = 4096, 20, 60
#: Numbers of clusters that a registry chooses from, rows that a cluster needs.
CHOICES, LEAST_ROWS = (8, 12, 16), 100
#: The least uneven of the numbers whose smallest cluster has enough rows, else of all; ties to the larger smallest one, then the smaller number.
CHOICE = Operator.of(
    f"""SELECT k, smallest, imbalance, smallest >= {LEAST_ROWS} AS feasible, row_number() OVER (ORDER BY CASE WHEN smallest >= {LEAST_ROWS} THEN 0 ELSE 1 END, imbalance, -smallest, k) = 1 AS chosen
    FROM (SELECT k, min(w) AS smallest, stddev_pop(w) / avg(w) AS imbalance FROM (SELECT k, cluster, sum(n_rows) AS w FROM weighed GROUP BY k, cluster) AS c GROUP BY k) AS s""", weighed="weighed")  # fmt: skip


def standardised(min_maf: float = 0.0, max_missing: float = 1.0):
    """Mean-imputed, standardised rows of markers that vary and pass QC."""

    def prepare(d: np.ndarray) -> tuple[np.ndarray, float]:
        called = np.isfinite(d)
        n = called.sum(1)
        mean = np.where(called, d, 0).sum(1) / np.maximum(n, 1)
        x = np.where(called, d - mean[:, None], 0.0)
        sd = x.std(1)
        ok = (n > 0) & (sd > 1e-6) & (np.minimum(mean, 2 - mean) / 2 >= min_maf) & (1 - n / d.shape[1] <= max_missing)
        return x[ok] / sd[ok, None], float(ok.sum())

    return prepare


def scores(panel: Panel, most: int, min_maf: float = 0.0, max_missing: float = 1.0, seed: int = 3) -> tuple[DataFrame, list[float]]:
    """(genotype_id, scores) on at most ``most`` principal components, signs by the largest entry; and the share of variance of each."""
    panel = Panel(cut(panel.rows), panel.genotypes)  # every pass reads them
    left, values, diagonal, markers = leading(panel, [standardised(min_maf, max_missing)], min(most, max(1, len(panel.genotypes) - 1)), seed)[0]
    if not markers:
        raise ValueError("no marker varies and passes QC")
    left = left * np.sign(left[np.abs(left).argmax(0), np.arange(left.shape[1])])
    rows = [(g, x) for g, x in zip(panel.genotypes, (left * values).tolist(), strict=True)]
    return panel.rows.sparkSession.createDataFrame(rows, "genotype_id string, scores array<double>"), (values**2 / diagonal.sum()).tolist()


def _starts(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: some candidates are drawn in proportion to the squared distance from the centres before, the one that leaves the least stays."""
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        drawn = rng.choice(len(x), size=2 + int(np.log(k)), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x), size=1)
        left = np.minimum(near[:, None], ((x[:, None, :] - x[None, drawn, :]) ** 2).sum(2))
        best = int(left.sum(0).argmin())
        centres.append(x[drawn[best]])
        near = left[:, best]
    return np.array(centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at] + (x**2).sum(1)


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("scores").flatten()).reshape(batch.num_rows, -1)


def clustered(points: DataFrame, ks: list[int], starts: int = STARTS, seed: int = 3) -> DataFrame:
    """(genotype_id, k, cluster): of several starts the one with the least squared distance; clusters are numbered by their smallest id."""
    importable(points.sparkSession)
    points = cut(points.select("genotype_id", "scores"))
    sample = np.array([r["scores"] for r in points.orderBy(F.xxhash64("genotype_id"), "genotype_id").limit(SAMPLE).select("scores").collect()])
    if not len(sample):
        return points.select("genotype_id", F.lit(0).alias("k"), F.lit(0).alias("cluster")).limit(0)
    rng, width = np.random.default_rng(seed), sample.shape[1]
    now = [(k, _starts(sample, min(k, len(sample)), rng)) for k in ks for _ in range(starts)]
    cost = [inf] * len(now)
    going = set(range(len(now)))
    for _ in range(ROUNDS):
        tried = {i: now[i][1] for i in going}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {i: np.zeros((len(c), width + 2)) for i, c in tried.items()}
            for batch in batches:
                x = _points(batch)
                for i, c in tried.items():
                    at, d = _nearest(x, c)
                    sums[i] += (at == np.arange(len(c))[:, None]).astype(float) @ np.column_stack([x, np.ones(len(x)), d])
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["i", "sums"])

        total: dict[int, np.ndarray] = {}
        for r in points.mapInArrow(work, "i int, sums binary").collect():  # centres, one set a partition
            part = np.frombuffer(r["sums"]).reshape(-1, width + 2)
            total[r["i"]] = total[r["i"]] + part if r["i"] in total else part
        for i in list(going):
            s, (k, c) = total[i], now[i]
            moved = np.where(s[:, [width]] > 0, s[:, :width] / np.maximum(s[:, [width]], 1), c)
            own = float(s[:, width + 1].sum())
            if cost[i] < inf and own >= cost[i] - 1e-9 * abs(cost[i]):
                going.discard(i)
            cost[i] = own
            now[i] = k, moved
        if not going:
            break
    best = {k: now[min((i for i in range(len(now)) if now[i][0] == k), key=lambda i: (cost[i], i))][1] for k in ks}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _points(batch), batch.column("genotype_id").to_pylist()
            for k, centres in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([k] * len(ids), pa.int32()), pa.array(_nearest(x, centres)[0].astype(np.int32))], names=["genotype_id", "k", "raw"])

    raw = cut(points.mapInArrow(label, "genotype_id string, k int, raw int"))
    order = raw.groupBy("k", "raw").agg(F.min("genotype_id").alias("low")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("low", "raw"))).alias("o"))  # as many as clusters
    named = order.select("k", F.posexplode("o").alias("cluster", "x")).select("k", F.col("x.raw").alias("raw"), "cluster")
    return raw.join(F.broadcast(named), ["k", "raw"]).select("genotype_id", "k", "cluster")


def registry_clusters(panel: Panel, weights: DataFrame, components: int = 32, min_maf: float = 0.01, max_missing: float = 0.25, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(genotype_id, cluster, k, n_rows) of the chosen number of clusters, and the choice: k, smallest, imbalance, feasible, chosen.

    weights: (genotype_id, n_rows); a genotype without any counts no rows."""
    points, _ = scores(panel, components, min_maf, max_missing, seed)
    found = clustered(points, list(CHOICES), seed=seed).join(weights.select("genotype_id", "n_rows"), "genotype_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
    found = cut(found)
    choice = cut(CHOICE.on(points.sparkSession, weighed=found))
    return found.join(F.broadcast(choice.where("chosen").select("k")), "k").select("genotype_id", "cluster", "k", "n_rows"), choice
