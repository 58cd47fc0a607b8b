"""Genomic, environment and interaction kernels over many training sets at once, without iterations or kernels in memory.

The kernel of two cells is a sum of products of genotype components z (Z Z' = X X' over the panel's
markers, by a randomised range finder) and environment factors e, so the model is a ridge regression on
[z, e, z x e]. A genotype enters it only through C = sum of n * u u' and t = sum of n * y * u over its training cells,
u = (1, e): small sums that are made where the cells are. A fit is then

1. a few passes over the markers, for all distinct training sets together (``components``);
2. one aggregation of the cells to (fold, genotype);
3. sums of z z' * C[a, b] over genotypes, one group for each fold and a, accumulated in a stream;
4. one system of size components * (1 + factors) for each fold, solved in a task of its own.

The driver holds numbers of genotypes, environments and components, never cells, markers, observations or a
genotype by genotype matrix. Components are exact while the panel's rank does not exceed ``most``; beyond it the
share of the trace that they hold is reported as ``held``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import importable
from .models import Panel, centred_markers

#: Kernels of a model; ``rkhs`` differs from the reaction norm by the environment factor alone.
KERNELS = {"gblup": ("G",), "gblup_environment": ("G", "E"), "reaction_norm_gblup": ("G", "E", "GxE"), "rkhs": ("G", "E", "GxE")}
#: Most components, and how many more directions are tried to find them.
MOST, EXTRA = 256, 10
#: Passes over the markers at most, and the residual of a component, of the largest one, below which it is exact.
PASSES, EXACT = 12, 1e-8


@dataclass(frozen=True)
class Components:
    """Of a training set: z (genotypes by components), its left singular vectors and values, the diagonal of X X', the sum of 2p(1-p)."""

    left: np.ndarray
    values: np.ndarray
    diagonal: np.ndarray
    denominator: float

    @property
    def z(self) -> np.ndarray:
        return self.left * self.values / np.sqrt(self.denominator)

    @property
    def d(self) -> np.ndarray:
        return self.diagonal / self.denominator

    @property
    def held(self) -> float:
        return float((self.values**2).sum() / max(self.diagonal.sum(), 1e-300))

    def back(self, beta: np.ndarray) -> np.ndarray:
        """Weights of genotypes whose product with the markers gives marker effects: X' (X a) = z beta."""
        return (self.left / self.values) @ beta / np.sqrt(self.denominator)


def leading(panel: Panel, prepared: list, most: int, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Left singular vectors (genotypes by components) and values of X', the diagonal of X' X and a sum, for each of several matrices X.

    ``prepared`` has a function for each: markers by genotypes to (rows of X, a number that is summed). All of them share their passes over
    the markers: a pass multiplies X' X with one block of directions a matrix, the first random, the next ones what was new in the last products;
    the components are those of X' X within all blocks so far. Passes end when every component is exact to ``EXACT``, at most after
    ``PASSES``; partitions return sums of genotypes by directions, and no genotype by genotype matrix is made."""
    n = len(panel.genotypes)
    width = max(1, min(most + EXTRA, n, panel.rows.count()))
    rng = np.random.default_rng(seed)
    basis, image = [np.zeros((n, 0)) for _ in prepared], [np.zeros((n, 0)) for _ in prepared]
    new: list[np.ndarray | None] = [np.eye(n) if width == n else np.linalg.qr(rng.normal(size=(n, width)))[0] for _ in prepared]
    sums, out = np.zeros((len(prepared), n, 2)), [None] * len(prepared)
    for step in range(PASSES):
        tried = list(new)

        def work(d: np.ndarray) -> np.ndarray:
            got = np.zeros((len(prepared), n, width + 2))
            for k, (prepare, a) in enumerate(zip(prepared, tried, strict=True)):
                if a is not None:
                    x, extra = prepare(d)
                    got[k, :, : a.shape[1]] = x.T @ (x @ a)
                    got[k, :, width] = (x * x).sum(0)
                    got[k, 0, width + 1] = extra
            return got

        found = panel.summed(work, (len(prepared), n, width + 2))
        for k, a in enumerate(tried):
            if a is None:
                continue
            sums[k] = found[k, :, width:]
            y = found[k, :, : a.shape[1]]
            basis[k], image[k] = np.hstack([basis[k], a]), np.hstack([image[k], y])
            small = basis[k].T @ image[k]
            values, turn = np.linalg.eigh((small + small.T) / 2)
            top = max(float(values.max()), 1e-300)
            keep = np.argsort(-values)[:most]
            keep = keep[values[keep] > 1e-10 * top]
            left = basis[k] @ turn[:, keep]
            rest = y - basis[k] @ (basis[k].T @ y)
            rest -= basis[k] @ (basis[k].T @ rest)
            u, size, _ = np.linalg.svd(rest, full_matrices=False)
            fresh = u[:, size > 1e-9 * top][:, : n - basis[k].shape[1]]
            exact = np.linalg.norm(image[k] @ turn[:, keep] - left * values[keep], axis=0).max(initial=0.0) <= EXACT * top
            out[k] = left, np.sqrt(values[keep])
            new[k] = None if (exact and step) or not fresh.shape[1] else fresh
        if not any(a is not None for a in new):
            break
    return [(left, values, x[:, 0], float(x[0, 1])) for (left, values), x in zip(out, sums, strict=True)]


def components(panel: Panel, sets: list[np.ndarray], most: int = MOST, min_maf: float = 0.01, max_missing: float = 0.25, seed: int = 3) -> list[Components]:
    """For each training set (a mask of genotypes) the leading components of its centred markers."""

    def prepare(train: np.ndarray):
        def centred(d: np.ndarray) -> tuple[np.ndarray, float]:
            x, p, _ = centred_markers(d, train, min_maf, max_missing)
            return x, float((2 * p * (1 - p)).sum())

        return centred

    found = [Components(*x) for x in leading(panel, [prepare(t) for t in sets], most, seed)]
    if not all(x.denominator for x in found):
        raise ValueError("no marker passes QC on the training genotypes")
    return found


# --- sums over cells -------------------------------------------------------------------------


_SUMS = "fold string, a int, g int, c array<double>, t double, ss double"


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, genotype) with its cells to one row for each a: C[a, :] and t[a]."""
    for batch in batches:
        out = []
        for fold, g, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u = np.array([[1.0, *cell["factor"]] for cell in cells])
            n, y = (np.array([cell[k] for cell in cells], float) for k in ("n", "m"))
            c, t = (u * n[:, None]).T @ u, u.T @ (n * y)
            ss = float(sum(cell["ss"] for cell in cells))
            out += [(fold, a, g, c[a].tolist(), float(t[a]), ss if a == 0 else 0.0) for a in range(u.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64()), strict=True)], names=["fold", "a", "g", "c", "t", "ss"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("fold", pa.string()), ("a", pa.int32()), ("g", pa.int32()), ("c", pa.list_(pa.float64())), ("t", pa.float64()), ("ss", pa.float64())]))


class _Sums:
    """What one (fold, a) adds up to over genotypes: z z' C[a, b] for each b, z C[a, b], C[a, b], z t[a], t[a], y * y and d C[a, a]."""

    def __init__(self, k: int, width: int):
        self.zz, self.zc, self.c, self.zt, self.rest = np.zeros((width, k, k)), np.zeros((k, width)), np.zeros(width), np.zeros(k), np.zeros(3)

    def add(self, z: np.ndarray, d: np.ndarray, a: int, c: np.ndarray, t: np.ndarray, ss: np.ndarray) -> None:
        for b in range(a, c.shape[1]):
            self.zz[b] += z.T @ (z * c[:, b, None])
        self.zc += z.T @ c
        self.c += c.sum(0)
        self.zt += z.T @ t
        self.rest += t.sum(), ss.sum(), d @ c[:, a]

    def bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.zz, self.zc, self.c, self.zt, self.rest))

    @classmethod
    def read(cls, raw: bytes, k: int, width: int) -> _Sums:
        out, x, at = cls(k, width), np.frombuffer(raw), 0
        for name in ("zz", "zc", "c", "zt", "rest"):
            own = getattr(out, name)
            setattr(out, name, x[at : at + own.size].reshape(own.shape))
            at += own.size
        return out


def _summed(sent, of: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([len(sums.c)], pa.int32()), pa.array([sums.bytes()], pa.binary())], names=["fold", "a", "width", "sums"])

        for batch in batches:
            fold, a = batch.column("fold").to_pylist(), batch.column("a").to_numpy()
            edges = [0, *[i for i in range(1, batch.num_rows) if fold[i] != fold[i - 1] or a[i] != a[i - 1]], batch.num_rows]
            for first, last in zip(edges, edges[1:], strict=False):
                if first == last:
                    continue
                part = batch.slice(first, last - first)
                z, d = sent.value[of[fold[first]]]
                c = np.array(part.column("c").flatten()).reshape(part.num_rows, -1)
                if now != (fold[first], int(a[first])):
                    if sums is not None:
                        yield done()
                    now, sums = (fold[first], int(a[first])), _Sums(z.shape[1], c.shape[1])
                g = part.column("g").to_numpy()
                sums.add(z[g], d[g], now[1], c, part.column("t").to_numpy(), part.column("ss").to_numpy())
        if sums is not None:
            yield done()

    return run


def solved(rows: dict[int, _Sums], parts: tuple[str, ...], residual: float) -> tuple[float, np.ndarray, np.ndarray, dict[str, float]]:
    """mean, environment effects, component effects [k, 1 + factors] and variance shares, from the sums of one training set."""
    width, k = len(rows), len(rows[0].zt)
    c = np.array([rows[a].c for a in range(width)])
    zc = np.stack([rows[a].zc for a in range(width)], axis=1)  # [k, a, b]
    n, mu = c[0, 0], rows[0].rest[0] / c[0, 0]
    zt = np.stack([rows[a].zt for a in range(width)], axis=1) - mu * zc[:, :, 0]
    t = np.array([rows[a].rest[0] for a in range(width)]) - mu * c[:, 0]
    energy = max(rows[0].rest[1] - n * mu * mu, 1e-12)
    norm = {"G": max(rows[0].rest[2] / n, 1e-8), "E": max(np.trace(c[1:, 1:]) / n, 1e-8), "GxE": max(sum(rows[a].rest[2] for a in range(1, width)) / n, 1e-8)}
    fit = {"G": (zt[:, 0] ** 2).sum(), "E": (t[1:] ** 2).sum(), "GxE": (zt[:, 1:] ** 2).sum()}
    raw = {p: max(fit[p] / norm[p] / energy, 1e-6) for p in parts}
    signal = 1 - min(max(residual, 0.05), 0.8)
    share = {p: signal * raw[p] / sum(raw.values()) for p in parts} | {"Residual": 1 - signal}
    root = {p: np.sqrt(share[p] / norm[p]) for p in parts}
    used = range(width) if "GxE" in parts else range(1)
    scale = np.array([root["G"] if a == 0 else root["GxE"] for a in used])
    blocks = [[rows[min(a, b)].zz[max(a, b)] * scale[a] * scale[b] for b in used] for a in used]
    target = [zt[:, a] * scale[a] for a in used]
    if "E" in parts and width > 1:
        cross = [zc[:, a, 1:] * scale[a] * root["E"] for a in used]
        blocks = [[*line, x] for line, x in zip(blocks, cross, strict=True)] + [[*[x.T for x in cross], c[1:, 1:] * root["E"] ** 2]]
        target.append(t[1:] * root["E"])
    system = np.block(blocks) / share["Residual"]
    system[np.diag_indices_from(system)] += 1
    beta = np.linalg.solve(system, np.concatenate(target) / share["Residual"])
    effects = np.zeros((k, width))
    for i, a in enumerate(used):
        effects[:, a] = beta[i * k : (i + 1) * k] * scale[a]
    environment = beta[len(used) * k :] * root["E"] if "E" in parts and width > 1 else np.zeros(width - 1)
    return float(mu), environment, effects, share


@dataclass(frozen=True)
class Fitted:
    """Of one training set; ``effects`` belong to the components ``of`` names."""

    mean: float
    environment: np.ndarray
    effects: np.ndarray
    share: dict[str, float]
    of: int

    def predict(self, z: np.ndarray, factor: np.ndarray) -> np.ndarray:
        u = np.column_stack([np.ones(len(factor)), factor])
        return self.mean + ((z @ self.effects) * u).sum(1) + factor @ self.environment


def fit(cells: DataFrame, made: list[Components], of: dict[str, int], model: str, residual: float = 0.2) -> dict[str, Fitted]:
    """cells: (fold, g, n, m, ss, factor) of all training sets, g the genotype's place in the panel; of: fold to its components."""
    spark = cells.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast([(x.z, x.d) for x in made])  # genotypes by components, for each distinct training set
    parts, shapes = KERNELS[model], {f: made[k].z.shape[1] for f, k in of.items()}
    grouped = cells.groupBy("fold", "g").agg(F.collect_list(F.struct("n", "m", "ss", "factor")).alias("cells"))  # at most one entry an environment
    rows = grouped.select("fold", "g", "cells").mapInArrow(_flattened, _SUMS).repartition("fold", "a").sortWithinPartitions("fold", "a")
    sums = rows.mapInArrow(_summed(sent, of), "fold string, a int, width int, sums binary")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        fold, width = part["fold"].iloc[0], int(part["width"].iloc[0])
        mu, environment, effects, share = solved({int(r.a): _Sums.read(r.sums, shapes[fold], width) for r in part.itertuples()}, parts, residual)
        return pd.DataFrame({"fold": [fold], "mean": [mu], "environment": [environment.tolist()], "effects": [effects.ravel().tolist()], "share": [list(share.items())]})

    found = sums.groupBy("fold").applyInPandas(solve, "fold string, mean double, environment array<double>, effects array<double>, share array<struct<name:string,value:double>>")
    out = {}
    for r in found.collect():  # one row a training set, components by factors
        k = shapes[r["fold"]]
        out[r["fold"]] = Fitted(r["mean"], np.array(r["environment"]), np.array(r["effects"]).reshape(k, -1), {x["name"]: x["value"] for x in r["share"]}, of[r["fold"]])
    return out


def predicted(cells: DataFrame, made: list[Components], models: dict[str, Fitted]) -> DataFrame:
    """cells (fold, g, factor and any others) with their prediction."""
    importable(cells.sparkSession)
    sent = cells.sparkSession.sparkContext.broadcast(([x.z for x in made], models))
    names = [c for c in cells.columns if c != "factor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, fitted = sent.value
        for batch in batches:
            fold, g = np.array(batch.column("fold").to_pylist(), object), batch.column("g").to_numpy()
            factor, out = batch.column("factor").to_pylist(), np.zeros(batch.num_rows)
            for f in set(fold):
                at = np.flatnonzero(fold == f)
                out[at] = fitted[f].predict(z[fitted[f].of][g[at]], np.array([factor[i] for i in at], float).reshape(len(at), -1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], names=[*names, "prediction"])

    schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in names)
    return cells.mapInArrow(run, f"{schema}, prediction double")


def training_sets(rows: DataFrame, genotypes: list[str]) -> tuple[list[np.ndarray], dict[str, int], dict[str, list[str]]]:
    """Of (fold, genotype_id, environment_id) training rows: distinct masks of genotypes, each fold's mask, each fold's environments."""
    at = {g: i for i, g in enumerate(genotypes)}
    held: dict[str, np.ndarray] = {}
    for r in rows.groupBy("fold").agg(F.collect_set("genotype_id").alias("ids")).collect():
        mask = np.zeros(len(genotypes), bool)
        mask[[at[i] for i in r["ids"]]] = True
        held[r["fold"]] = mask
    sets: list[np.ndarray] = []
    of, seen = {}, {}
    for fold, mask in sorted(held.items()):
        of[fold] = seen.setdefault(mask.tobytes(), len(sets))
        if of[fold] == len(sets):
            sets.append(mask)
    environments = {r["fold"]: sorted(r["ids"]) for r in rows.groupBy("fold").agg(F.collect_set("environment_id").alias("ids")).collect()}
    return sets, of, environments


def must_be_known(rows: DataFrame, column: str, known: DataFrame) -> None:
    """An error that names the first ten values of a column that a table of known ones lacks."""
    absent = [r[0] for r in rows.select(column).distinct().join(known.select(column), column, "anti").orderBy(column).limit(10).collect()]
    if absent:
        raise KeyError(f"{column} absent: {absent}")
