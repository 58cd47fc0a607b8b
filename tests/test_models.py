"""Model operators against plain numpy; sources, sinks, service and stream by round trips."""

import itertools
import json
import shutil
import threading
import time
import urllib.error
import urllib.request

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from genoscape.__main__ import main
from genoscape.operators import clusters, kernels, models, protocols, training
from genoscape.operators.models import EnvironmentKernel, EnvironmentPCs, LocationScale, Panel, genomic_ridge, simplex_weights
from genoscape.operators.training import Model, stacking_weights
from genoscape.service import Models, serve, weather_features
from genoscape.sources import crops
from genoscape.streaming.scoring import read_request_stream, score_stream


def panel_of(spark, d):
    d = np.asarray(d)
    rows = [(f"g{i:02d}", j, None if d[i, j] < 0 else int(d[i, j])) for i in range(d.shape[0]) for j in range(d.shape[1])]
    return Panel.of(spark.createDataFrame(rows, "genotype_id string, marker_pos int, dosage int"))


def matrix(panel):
    return np.array([r.x for r in panel.rows.orderBy("marker_pos").collect()], dtype=float).T


def test_statistics_use_training_genotypes_alone(spark):
    panel = panel_of(spark, [[0, 0, 2], [2, 1, 0], [2, 2, 0]])
    got = [r.frequency for r in panel.statistics({"f": np.array([True, True, False])}).orderBy("marker_pos").collect()]
    assert got == [0.5, 0.25, 0.5]


def test_imputation_by_weight(spark):
    panel = panel_of(spark, [[0, -1, 2, 0], [1, 1, -1, 1], [2, 2, 0, -1], [1, 0, 1, 2]])
    mask = np.array([True, True, True, False])
    plain = matrix(panel.centred(mask, 0.0, 1.0)[0])
    assert np.allclose(matrix(panel.imputed(mask, 2, 0.0)), plain)
    half, full = matrix(panel.imputed(mask, 1, 0.5)), matrix(panel.imputed(mask, 1, 1.0))
    assert np.isfinite(full).all() and np.allclose(half[plain != 0], plain[plain != 0]) and not np.allclose(full, plain)
    x = plain[mask]
    u, s, v = np.linalg.svd(x, full_matrices=False)
    again = plain @ v[:1].T @ v[:1]
    assert np.allclose(full[0, 1], again[0, 1])
    with pytest.raises(ValueError):
        panel.imputed(mask, 2, 1.1)
    with pytest.raises(ValueError):
        panel.centred(np.zeros(4, dtype=bool))


@pytest.mark.parametrize("model", ["gblup", "gblup_environment", "reaction_norm_gblup", "rkhs"])
@pytest.mark.parametrize("markers", [12, 5])
def test_cell_solution_equals_that_over_observations(spark, model, markers):
    """With fewer markers than genotypes the components come from random directions."""
    rng = np.random.default_rng(3)
    panel = panel_of(spark, rng.integers(-1, 3, (8, markers)))
    made, denominator = panel.centred(np.ones(8, dtype=bool), 0.0, 1.0)
    x = matrix(made)
    envs = rng.normal(size=(3, 2))
    factor = EnvironmentKernel("rbf" if model == "rkhs" else "linear").fit(envs).transform(envs)
    cells = [(g, e) for g in range(8) for e in range(3) if (g + e) % 4]
    count = rng.integers(1, 4, len(cells))
    og, oe = (np.repeat([c[k] for c in cells], count) for k in (0, 1))
    y = rng.normal(size=len(og)) + x[og, 0] + oe
    # brute force over observations
    e = factor[oe]
    kg, ke = (x @ x.T / denominator)[np.ix_(og, og)], e @ e.T
    parts = {"G": kg / np.mean(np.diag(kg))}
    if model != "gblup":
        parts["E"] = ke / np.mean(np.diag(ke))
    if model in ("reaction_norm_gblup", "rkhs"):
        parts["GxE"] = kg * ke / np.mean(np.diag(kg * ke))
    c = y - y.mean()
    raw = {k: max(c @ m @ c / (c @ c), 1e-6) for k, m in parts.items()}
    k = sum(0.8 * raw[n] / sum(raw.values()) * m for n, m in parts.items())
    want = y.mean() + k @ np.linalg.solve(k + 0.2 * np.eye(len(y)), c)
    at = np.cumsum(count) - count
    means = np.add.reduceat(y, at) / count
    g, ce = np.array([p[0] for p in cells]), np.array([p[1] for p in cells])
    squares = np.add.reduceat(y * y, at)
    rows = [("all", int(i), int(n), float(m), float(q), f.tolist()) for i, n, m, q, f in zip(g, count, means, squares, factor[ce], strict=True)]
    cells = spark.createDataFrame(rows, "fold string, g int, n long, m double, ss double, factor array<double>")
    found = kernels.components(panel, [np.ones(8, dtype=bool)], 256, 0.0, 1.0)
    assert np.allclose(found[0].z @ found[0].z.T, x @ x.T / denominator) and found[0].held == pytest.approx(1)
    fitted = kernels.fit(cells, found, {"all": 0}, model)["all"]
    assert np.allclose(fitted.predict(found[0].z[og], e), want, atol=1e-8)
    again = {(r.g, tuple(r.f)): r.prediction for r in kernels.predicted(cells.withColumn("f", F.col("factor")), found, {"all": fitted}).collect()}
    assert all(again[i, tuple(f)] == pytest.approx(w) for i, f, w in zip(og, e, want, strict=True))
    effects = np.array([r.effect for r in made.effects(found[0].back(fitted.effects)).orderBy("marker_pos").collect()])
    own = x @ effects
    assert np.allclose(fitted.mean + own[og, 0] + e @ fitted.environment + (own[og, 1:] * e).sum(1), want, atol=1e-8)


def test_components_of_many_training_sets_are_the_leading_ones(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 3, (40, 3)) @ rng.integers(0, 2, (3, 60))
    panel = panel_of(spark, np.clip(base + rng.integers(-1, 2, (40, 60)), 0, 2))
    sets = [np.arange(40) % 4 != k for k in range(4)]
    for most, within in ((40, 1e-8), (6, 1e-2)):
        for mask, found in zip(sets, kernels.components(panel, sets, most, 0.01, 0.25), strict=True):
            made, denominator = panel.centred(mask)
            x = matrix(made)
            u, s, _ = np.linalg.svd(x, full_matrices=False)
            k = min(most, int((s > 1e-6).sum()))
            assert found.denominator == pytest.approx(denominator) and len(found.values) == k
            assert np.allclose(found.values, s[:k], rtol=within) and np.allclose(found.diagonal, (x * x).sum(1))
            angles = np.linalg.svd(found.left[:, :3].T @ u[:, :3])[1]
            assert angles.min() > 1 - within
            assert found.held == pytest.approx((s[:k] ** 2).sum() / (s**2).sum(), rel=within)
    with pytest.raises(ValueError, match="no marker"):
        kernels.components(panel, [np.ones(40, bool)], min_maf=0.6)


def test_a_kernel_in_every_fold_equals_dense_solves(spark):
    """All folds at once against numpy for each fold alone; genotypes or environments that are not known are named."""
    rng = np.random.default_rng(8)
    d = rng.integers(0, 3, (24, 30))
    rows = [(f"g{i:02d}", j, int(d[i, j])) for i in range(24) for j in range(30)]
    dosage = spark.createDataFrame(rows, "genotype_id string, marker_pos int, dosage int")
    values = {f"E{k}": {"a": float(k), "b": float(k * k % 5), "c": None if k == 2 else 1.0 + k % 3} for k in range(6)}
    labels = [(f"g{i:02d}", f"E{k}", str(i % 3), str(k % 3)) for i in range(24) for k in range(6) if (i + k) % 5]
    cells = [(g, e, 2, float(rng.normal() + int(e[1])), 0.0) for g, e, *_ in labels]
    cells = [(g, e, n, m, 2 * m * m + 0.5) for g, e, n, m, _ in cells]
    frame = spark.createDataFrame(cells, "genotype_id string, environment_id string, n long, m double, ss double")
    design = spark.createDataFrame(labels, "genotype_id string, environment_id string, fg string, fe string")
    got = {(r.fold, r.genotype_id, r.environment_id): r.prediction for r in training.kernel_predictions(dosage, values, frame, design, training.Member("rkhs", "rbf")).collect()}
    assert set(got) == {(fg, g, e) for g, e, fg, fe in labels if fg == fe}
    for fold in "012":
        train = [k for k, x in enumerate(labels) if fold not in x[2:]]
        held = [k for k, x in enumerate(labels) if x[2] == x[3] == fold]
        mask = np.array([i % 3 != int(fold) for i in range(24)])
        p = d[mask].mean(0) / 2
        ok = (np.minimum(p, 1 - p) >= 0.01) & (p > 0) & (p < 1)
        x = (d - 2 * p)[:, ok]
        grm = x @ x.T / (2 * p[ok] * (1 - p[ok])).sum()
        envs = sorted({labels[k][1] for k in train})
        pcs = EnvironmentPCs.fit(values, envs, 5)
        kernel = EnvironmentKernel("rbf").fit(pcs.transform(values, envs))
        f = {e: kernel.transform(pcs.transform(values, [e]))[0] for e in values}
        g = np.array([int(x[0][1:]) for x in labels])
        e = np.array([f[x[1]] for x in labels])
        full = {"G": grm[np.ix_(g, g)], "E": e @ e.T}
        full["GxE"] = full["G"] * full["E"]
        n, m, ss = (np.array([c[k] for c in cells]) for k in (2, 3, 4))
        mu = (n * m)[train].sum() / n[train].sum()
        c = m[train] - mu
        energy = ss[train].sum() - n[train].sum() * mu**2
        total = {k: v / ((n[train] * np.diag(v)[train]).sum() / n[train].sum()) for k, v in full.items()}
        raw = {k: (n[train] * c) @ v[np.ix_(train, train)] @ (n[train] * c) / energy for k, v in total.items()}
        k = sum(0.8 * raw[x] / sum(raw.values()) * v for x, v in total.items())
        want = mu + k[np.ix_(held, train)] @ np.linalg.solve(k[np.ix_(train, train)] + np.diag(0.2 / n[train]), c)
        assert np.allclose([got[fold, *labels[h][:2]] for h in held], want, atol=1e-8)
    with pytest.raises(KeyError, match="E5"):
        training.kernel_predictions(dosage, {k: v for k, v in values.items() if k != "E5"}, frame, design, training.Member())
    with pytest.raises(KeyError, match="g00"):
        training.kernel_predictions(dosage.where("genotype_id <> 'g00'"), values, frame, design, training.Member())


def test_several_scales_and_standardised_values_out_of_fold(spark):
    rng = np.random.default_rng(21)
    d = rng.integers(0, 3, (20, 25))
    dosage = spark.createDataFrame([(f"g{i:02d}", j, int(d[i, j])) for i in range(20) for j in range(25)], "genotype_id string, marker_pos int, dosage int")
    values = {f"E{k}": {"a": float(k), "b": float(k * k % 5)} for k in range(6)}
    labels = [(f"g{i:02d}", f"E{k}", "f" if k > 3 else "x", "f" if k > 3 else "y") for i in range(20) for k in range(6)]
    cells = [(g, e, 3, float(rng.normal() * (1 + int(e[1])) + 5 * int(e[1])), 0.0) for g, e, *_ in labels]
    cells = [(g, e, n, m, n * m * m + 0.7) for g, e, n, m, _ in cells]
    schema = "genotype_id string, environment_id string, n long, m double, ss double"
    design = spark.createDataFrame(labels, "genotype_id string, environment_id string, fg string, fe string")

    def run(rows, members):
        return {(r.genotype_id, r.environment_id): r.prediction for r in training.kernel_predictions(dosage, values, spark.createDataFrame(rows, schema), design, members).collect()}

    half, one = training.Member("rkhs", "rbf", 0.5), training.Member("rkhs", "rbf", 1.0, 3.0)
    apart, both = (run(cells, half), run(cells, one)), run(cells, [half, one])
    assert set(both) == {x[:2] for x in labels if x[2] == "f"} and all(both[k] == pytest.approx((apart[0][k] + 3 * apart[1][k]) / 4) for k in both)
    envs = ["E0", "E1", "E2", "E3"]
    n, m, ss = ({e: np.array([c[k] for c in cells if c[1] == e], float) for e in envs} for k in (2, 3, 4))
    mean = np.array([(n[e] * m[e]).sum() / n[e].sum() for e in envs])
    sd = np.array([np.sqrt((ss[e].sum() - n[e].sum() * mu**2) / (n[e].sum() - 1)) for e, mu in zip(envs, mean, strict=True)])
    every = np.concatenate([n[e] for e in envs])
    spread = np.sqrt(sum(ss[e].sum() for e in envs) / every.sum() - (np.concatenate([n[e] * m[e] for e in envs]).sum() / every.sum()) ** 2)
    pcs = EnvironmentPCs.fit(values, envs, 5)
    scaler = LocationScale().fit(envs, mean, sd, float(spread), pcs.transform(values, envs))
    mu, scale = ({e: float(v) for e, v in zip(sorted(values), x, strict=True)} for x in scaler.parameters(sorted(values), pcs.transform(values, sorted(values))))
    known = [(g, e, n, (m - mu[e]) / scale[e], (ss - 2 * mu[e] * m * n + n * mu[e] ** 2) / scale[e] ** 2) for g, e, n, m, ss in cells]
    plain = run(known, training.Member("rkhs", "rbf"))
    got = run(cells, training.Member("rkhs", "rbf", standardised=True))
    assert all(got[k] == pytest.approx(mu[k[1]] + scale[k[1]] * plain[k]) for k in plain) and len(got) == len(plain)


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    d = rng.integers(-1, 3, (10, 9))
    panel = panel_of(spark, d)
    y = {f"g{i:02d}": float(i % 4) for i in range(8)}
    got = {r.genotype_id: r.prediction for r in genomic_ridge(panel, {"0": y, "1": {"g00": 1.0, "g01": 3.0}}, 10.0, 512, 0.01, 0.6).where("fold = '0'").collect()}
    x = np.where(d >= 0, d, np.nan).astype(float)
    keep = [j for j in range(9) if np.isfinite(x[:8, j]).mean() >= 0.4 and len(set(x[:8, j][np.isfinite(x[:8, j])])) > 1]
    x = x[:, keep]
    x = np.where(np.isfinite(x), x, np.nanmean(x[:8], axis=0))
    z = (x - x[:8].mean(0)) / x[:8].std(0)
    t = np.array(list(y.values()))
    b = np.linalg.solve(z[:8].T @ z[:8] + 10 * np.eye(z.shape[1]), z[:8].T @ (t - t.mean()))
    assert np.allclose([got[f"g{i:02d}"] for i in range(10)], t.mean() + z @ b)


def test_too_few_genotypes_give_their_mean(spark):
    panel = panel_of(spark, [[0, 1], [1, 2], [2, 0]])
    assert {r.prediction for r in genomic_ridge(panel, {"1": {"g00": 1.0, "g01": 3.0}}).collect()} == {2.0}


@pytest.mark.parametrize("held", [2_000_000, 60])
def test_ridge_takes_all_markers_beyond_those_of_one_task(spark, monkeypatch, held):
    monkeypatch.setattr(models, "BLOCKS", held)  # 60: blocks of few genotypes, so that many steps are taken
    rng = np.random.default_rng(4)
    d = rng.integers(0, 3, (16, 90))
    d[:, 3], d[1:, 4] = 1, 0  # does not vary; varies in a genotype that only one fold trains on
    d[rng.random(d.shape) < 0.12] = -1
    names = [f"g{i:02d}" for i in range(16)]
    targets = {"0": {g: float(i % 5) for i, g in enumerate(names) if i > 2}, "1": {g: float(i * i) for i, g in enumerate(names) if i < 9}, "2": {g: 4.0 for g in names}, "few": {"g00": 1.0, "g01": 3.0}}
    panel = panel_of(spark, d)
    got = {(r.fold, r.genotype_id): r.prediction for r in genomic_ridge(panel, targets, most=7).collect()}
    kept = []
    assert len(got) == 4 * 16 and {v for (f, _), v in got.items() if f == "few"} == {2.0}
    x = np.where(d >= 0, d, np.nan).astype(float)
    for fold in ("0", "1", "2"):
        own = np.array([g in targets[fold] for g in names])
        called = np.isfinite(x[own])
        p = np.where(called, x[own], 0).sum(0) / (2 * called.sum(0))
        keep = (np.nanmax(x[own], 0) > np.nanmin(x[own], 0)) & (np.minimum(p, 1 - p) >= 0.01) & (1 - called.mean(0) <= 0.25)
        kept.append(int(keep.sum()))
        z = np.where(np.isfinite(x), x, np.nanmean(x[own], 0))[:, keep]
        z = (z - z[own].mean(0)) / z[own].std(0)
        t = np.array(list(targets[fold].values()))
        b = np.linalg.solve(z[own].T @ z[own] + 10 * np.eye(z.shape[1]), z[own].T @ (t - t.mean()))
        assert np.allclose([got[fold, g] for g in names], t.mean() + z @ b, rtol=0, atol=1e-7)
    assert 7 < min(kept) < max(kept)
    for most in (min(kept), 90):  # some folds by markers, all folds by markers
        other = {(r.fold, r.genotype_id): r.prediction for r in genomic_ridge(panel, targets, most=most).collect()}
        assert other.keys() == got.keys() and all(other[k] == pytest.approx(got[k], abs=1e-7) for k in got)


def test_thinning_keeps_the_ends(spark):
    rng = np.random.default_rng(0)
    panel = panel_of(spark, rng.integers(0, 3, (12, 40)))
    y = {f"g{i:02d}": float(i) for i in range(12)}
    assert genomic_ridge(panel, {"0": y}, most=7).count() == 12


def test_radial_factors_give_the_kernel():
    x = np.array([[0.0], [1.0], [2.0]])
    k = EnvironmentKernel("rbf").fit(x)
    d2 = (x - x.T) ** 2
    f = k.transform(x)
    assert np.allclose(f @ f.T, np.exp(-d2 / (2 * np.median(d2[d2 > 0]))))
    assert k.transform(np.array([[0.5]])).shape == (1, f.shape[1])


def test_environment_components_fill_missing_values_and_unknown_environments():
    values = {"a": {"x": 1.0, "y": None}, "b": {"x": 2.0, "y": 5.0}, "c": {"x": 4.0, "y": 7.0}}
    p = EnvironmentPCs.fit(values, ["a", "b", "c"], 2)
    assert np.isfinite(p.transform(values, ["a", "zz"])).all() and p.transform(values, ["a"]).shape == (1, 2)


def test_location_and_scale():
    y = np.array([[0, 1, 2], [10, 12, 14], [20, 23, 26]], dtype=float)
    pcs = np.array([[-1.0], [0.0], [1.0]])
    m = LocationScale().fit(["E1", "E2", "E3"], y.mean(1), y.std(1, ddof=1), float(y.std()), pcs)
    assert m.restore(np.zeros(1), ["E2"], pcs[1:2])[0] == 12.0
    assert np.isfinite(m.restore(np.zeros(1), ["new"], np.array([[5.0]]))).all()


def test_simplex_weights_beat_a_grid():
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(50, 3)), np.array([0.7, 0.3, 0.0])
    y = x @ w + rng.normal(size=50) * 0.1
    a, b = x.T @ x / 50, x.T @ y / 50
    loss = lambda v: v @ a @ v - 2 * b @ v + 0.05 * np.sum((v - 1 / 3) ** 2)
    found = simplex_weights(a, b)
    grid = [np.array(p) / 20 for p in itertools.product(range(21), repeat=3) if sum(p) == 20]
    assert abs(found.sum() - 1) < 1e-9 and (found >= 0).all() and loss(found) <= min(map(loss, grid)) + 1e-12


def test_stacking_gives_every_fold_and_all_folds(spark):
    rows = spark.createDataFrame([("cv_g", str(i % 3), float(i), float(i), 0.0) for i in range(12)], "protocol string, fold string, y double, a double, b double")
    got = {r.fold: r.a for r in stacking_weights(rows, ["a", "b"]).collect()}
    assert set(got) == {"0", "1", "2", "*"} and all(v > 0.8 for v in got.values())


def test_structure_separates_two_groups(spark):
    d = np.vstack([np.tile([0, 0, 0, 2, 2, 2], (5, 1)), np.tile([2, 2, 2, 0, 0, 0], (5, 1))])
    d[0, 0] = 1
    points, ratio = clusters.scores(panel_of(spark, d), 2)
    labels = {r.genotype_id: r.cluster for r in clusters.clustered(points, [2]).collect()}
    assert ratio[0] > 0.8 and {labels[f"g{i:02d}"] for i in range(5)} == {0} and {labels[f"g{i:02d}"] for i in range(5, 10)} == {1}


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(4)
    d = np.clip(rng.integers(0, 3, (50, 4)) @ rng.integers(0, 2, (4, 90)) + rng.integers(-1, 2, (50, 90)), -1, 2)
    panel = panel_of(spark, d)
    x = np.where(d >= 0, d, np.nan).astype(float)
    for (maf, missing), most in (((0.0, 1.0), 5), ((0.05, 0.2), 32)):
        mean = np.nanmean(x, axis=0)
        ok = (np.minimum(mean, 2 - mean) / 2 >= maf) & (np.isnan(x).mean(0) <= missing)
        z = np.where(np.isfinite(x), x, mean)[:, ok]
        z = z[:, z.std(0) > 1e-6]
        z = (z - z.mean(0)) / z.std(0)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        points, ratio = clusters.scores(panel, most, maf, missing)
        got = np.array([r.scores for r in points.orderBy("genotype_id").collect()])
        exact = np.linalg.svd((got / np.linalg.norm(got, axis=0)).T @ u[:, :3])[1]
        assert exact.min() > 1 - 1e-6 and np.allclose(ratio[:3], (s**2 / (s**2).sum())[:3], rtol=1e-4)


def test_registry_clusters_are_chosen_by_rows(spark):
    rng = np.random.default_rng(12)
    centres = rng.integers(0, 2, (12, 80)) * 2
    group = rng.integers(0, 12, 150)
    d = np.where(rng.random((150, 80)) < 0.05, 1, centres[group])
    panel = panel_of(spark, d)
    weights = spark.createDataFrame([(f"g{i:02d}", int(rng.integers(1, 60))) for i in range(0, 150)], "genotype_id string, n_rows long")
    found, choice = clusters.registry_clusters(panel, weights)
    rows = {r.k: r for r in choice.collect()}
    assert set(rows) == {8, 12, 16} and sum(r.chosen for r in rows.values()) == 1
    labels = {r.genotype_id: r.cluster for r in found.collect()}
    assert len(labels) == 150 and found.select("k").distinct().count() == 1
    points, _ = clusters.scores(panel, 32, 0.01, 0.25)
    twelve = {r.genotype_id: r.cluster for r in clusters.clustered(points, [12], seed=3).collect()}
    pairs = {(twelve[f"g{i:02d}"], int(group[i])) for i in range(150)}
    assert len(pairs) == 12  # the planted groups
    again = {r.genotype_id: r.cluster for r in clusters.clustered(points.repartition(7), [12], seed=3).collect()}
    assert again == twelve
    # the choice on a second engine
    db = duckdb.connect()
    table = found.unionByName(found.select("genotype_id", (F.col("cluster") % 3).alias("cluster"), (F.col("k") + 1).alias("k"), "n_rows")).toPandas()
    db.register("weighed", table)
    mine = {tuple(r) for r in clusters.CHOICE.on(spark, weighed=spark.createDataFrame(table)).collect()}
    near = lambda rows: sorted((k, int(w), round(float(i), 9), bool(f), bool(c)) for k, w, i, f, c in rows)
    assert near(mine) == near(db.execute(clusters.CHOICE.sql()).fetchall())


def test_clusters_of_few_and_equal_points(spark):
    points = spark.createDataFrame([(f"g{i}", [1.0, 2.0]) for i in range(5)], "genotype_id string, scores array<double>")
    assert {r.cluster for r in clusters.clustered(points, [3, 9]).collect()} == {0}
    assert clusters.clustered(points.limit(0), [3]).count() == 0


def test_the_registry_takes_clusters_from_markers(spark):
    rows = training.strict_registry_by_markers(spark, "/root/testdata/sf0.001")
    assert rows.columns == protocols.STRICT_REGISTRY.run(spark, "/root/testdata/sf0.001").columns
    found = {r.genotype_id: str(r.cluster) for r in training.registry_clusters(spark, "/root/testdata/sf0.001").collect()}
    held = rows.select("genotype_id", "cv_gcluster").distinct().collect()
    assert {r.genotype_id: r.cv_gcluster for r in held} == found and len(held) == len(found)


# --- files ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crop(tmp_path_factory):
    root = tmp_path_factory.mktemp("crops")
    d = root / "Rice" / "Rice"
    d.mkdir(parents=True)
    rng = np.random.default_rng(2)
    names = [f"S{i}" for i in range(12)]
    lines = ["Marker," + ",".join(names)]
    for m in range(20):
        codes = rng.integers(0, 3, 12)
        lines.append(f"M{m}," + ",".join((["AA", "AG", "GG"][c] if m % 2 else str(c)) for c in codes))
    lines[1] = "M0," + ",".join(["0", "1", "2", " NA ", "1.0"])
    (d / "Genotypes.csv").write_text("\n".join(lines) + "\n")
    (d / "Environment.csv").write_text("Environment,Date,Variable_1,Variable_2\n" + "".join(f"w{e},2020-01-{k:02d},{e + k * 0.1},{'NA' if k == 2 else e * k}\n" for e in range(4) for k in range(1, 7)))
    (d / "Phenotypes.csv").write_text("Environment,Sample,Trait_1,Trait_2\n" + "".join(f"p{e}, S{g} ,{g * 0.5 + e},{'-9' if g else 'x'}\n" for e in range(4) for g in range(12)))
    (root / "map.csv").write_text("crop,phenotype_environment_id,weather_environment_id,canonical_environment_id\n" + "Rice,p0,w0,old\n" + "".join(f"Rice,p{e},w{e},E{e}\n" for e in range(4)))
    (root / "asked.csv").write_text("genotype_id,environment_id,note\nS1,p0,a\nS2,w3,b\n")
    return root


def test_readers(spark, crop):
    p = crops.read_phenotypes(spark, str(crop), "Rice", str(crop / "map.csv"))
    rows = p.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(48)) and rows[0].environment_id == "E0" and rows[0].original_environment_id == "p0"
    assert rows[0].genotype_id == "S0" and rows[0].Trait_2 is None and rows[1].Trait_2 == -9.0
    w = crops.read_weather(spark, str(crop), "Rice", str(crop / "map.csv"))
    assert w.count() == 48 and w.where("value IS NULL").count() == 4 and {r[0] for r in w.select("environment_id").distinct().collect()} == {"E0", "E1", "E2", "E3"}
    first = {r.genotype_id: r.dosage for r in crops.read_dosage(spark, str(crop), "Rice").where("marker_id = 'M0'").collect()}
    assert [first[f"S{i}"] for i in range(6)] == [0, 1, 2, None, 1, None] and len(first) == 12
    again = crops.read_dosage(spark, str(crop), "Rice", str(crop / "cache"))
    assert again.count() == 240 and crops.read_dosage(spark, str(crop), "Rice", str(crop / "cache")).count() == 240


@pytest.mark.parametrize("text, want", [("1.5", 1.5), (" 2 ", 2.0), ("1_000", 1000.0), ("1.0d", None), ("inf", None), ("-9", -9.0), ("", None), ("1e3", 1000.0)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(crops.number(crops.F.col("t"))).first()[0] == want


def test_absent_files_and_bad_requests(spark, crop):
    assert crops.read_id_map(spark, None, "Rice").isEmpty() and crops.read_many(spark, [str(crop)], "none.csv") is None
    (crop / "bad.csv").write_text("genotype_id\nS1\n")
    with pytest.raises(ValueError):
        crops.read_requests(spark, str(crop / "bad.csv"))
    (crop / "empty.csv").write_text("genotype_id,environment_id\n")
    with pytest.raises(ValueError):
        crops.read_requests(spark, str(crop / "empty.csv"))


def test_registry_round_trip_and_tampering(spark, tmp_path):
    rows = spark.createDataFrame([(1, "G1", "0"), (2, None, "1")], "row_id long, genotype_id string, cv_g string")
    h = crops.write_registry(rows, str(tmp_path / "r"), "Rice", 1)
    assert h == crops.write_registry(rows.repartition(3), str(tmp_path / "r2"), "Rice", 1)
    assert crops.read_registry(spark, str(tmp_path / "r")).count() == 2
    rows.limit(1).write.mode("overwrite").parquet(str(tmp_path / "r" / "observations"))
    with pytest.raises(AssertionError):
        crops.read_registry(spark, str(tmp_path / "r"))


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "G1", "E1", "cv_ge", "0", "purge"), (2, "G2", "E1", "cv_ge", "0", "train")], "row_id long, genotype_id string, environment_id string, protocol string, fold string, role string")
    crops.write_manifest(rows, str(tmp_path / "m"))
    back = crops.read_text_csv(spark, str(tmp_path / "m"))
    assert back.columns == crops.MANIFEST_FIELDS and back.where("purge_reason IS NOT NULL").count() == 1
    with pytest.raises(AssertionError):
        crops.write_manifest(rows.withColumn("role", crops.F.lit("other")), str(tmp_path / "m2"))


def test_train_predict_serve_and_stream(spark, crop, tmp_path):
    common = ["--data", str(crop), "--crop", "Rice", "--id-map", str(crop / "map.csv")]
    assert main(["audit", *common, "--out", str(tmp_path / "audit")]) == 0
    reported = crops.read_text_csv(spark, str(tmp_path / "audit" / "rows")).collect()
    assert sorted((r.file, r.n_ragged, r.n_blank) for r in reported) == [("Environment.csv", "0", "0"), ("Phenotypes.csv", "0", "0")]
    assert main(["train", *common, "--trait", "Trait_1", "--out", str(tmp_path / "models")]) == 0
    assert main(["predict", *common, "--trait", "Trait_1", "--models", str(tmp_path / "models"), "--requests", str(crop / "asked.csv"), "--out", str(tmp_path / "out")]) == 0
    rows = {r.note: r for r in crops.read_text_csv(spark, str(tmp_path / "out")).collect()}
    assert rows["a"].environment_id == "E0" and rows["b"].environment_id == "E3" and float(rows["b"].prediction) > float(rows["a"].prediction) and float(rows["a"].gate_weight) == 0
    model = Model(spark, str(tmp_path / "models" / "Rice__Trait_1"))
    dosage, values = crops.read_dosage(spark, str(crop), "Rice"), weather_features(crops.read_weather(spark, str(crop), "Rice", str(crop / "map.csv")))
    with pytest.raises(KeyError):
        model.predict(spark.createDataFrame([("nobody", "E0")], "genotype_id string, environment_id string"), dosage, values)
    model.must_be_fitted_on(crops.read_phenotypes(spark, str(crop), "Rice", str(crop / "map.csv")).select("genotype_id"))
    with pytest.raises(AssertionError, match="other"):
        model.must_be_fitted_on(spark.createDataFrame([("S1",)], "genotype_id string"))
    folder = tmp_path / "models" / "Rice__Trait_1"
    crashed = folder / f"version={model.version + 1}" / "markers"
    shutil.copytree(folder / f"version={model.version}" / "markers", crashed)  # a training that died before its head
    assert Model(spark, str(folder)).version == model.version
    shutil.copytree(folder / f"version={model.version}", folder / "version=7")
    assert Model(spark, str(folder), 7).version == 7 and Model(spark, str(folder)).version == model.version
    spark.read.parquet(str(folder / "version=7" / "markers")).withColumn("frequency", F.col("frequency") + 0.01).write.parquet(str(tmp_path / "changed"))
    shutil.rmtree(folder / "version=7" / "markers")
    shutil.move(tmp_path / "changed", folder / "version=7" / "markers")
    with pytest.raises(AssertionError, match="markers"):
        Model(spark, str(folder), 7)
    text = spark.read.text(str(folder / "version=7" / "head")).first()[0].replace('"Rice"', '"Maize"')
    shutil.rmtree(folder / "version=7" / "head")
    spark.createDataFrame([(text,)], "value string").write.text(str(folder / "version=7" / "head"))
    with pytest.raises(AssertionError, match="head"):
        Model(spark, str(folder), 7)
    with pytest.raises(FileNotFoundError):
        Model(spark, str(folder), 8)
    far = values | {"new": {k: (v or 0) + 50 for k, v in values["E0"].items()}}
    new = model.predict(spark.createDataFrame([("S1", "new")], "genotype_id string, environment_id string"), dosage, far).first()
    assert new.gate_weight == 1.0 and np.isfinite(new.prediction)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("genotype_id,environment_id\nS1,E0\nnobody,E0\n")
    q = score_stream(model, read_request_stream(spark, str(tmp_path / "in")), dosage, values, str(tmp_path / "scored"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "scored")).collect()
    assert len(got) == 1 and abs(got[0].prediction - float(rows["a"].prediction)) < 1e-9
    server = serve(Models(spark, str(tmp_path / "models"), str(crop), str(crop / "map.csv")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    assert json.load(urllib.request.urlopen(url + "/health"))["status"] == "ok"

    def post(doc):
        try:
            return json.load(urllib.request.urlopen(urllib.request.Request(url + "/predict", json.dumps(doc).encode())))
        except urllib.error.HTTPError as e:
            return e.code

    ok = post({"crop": "Rice", "trait": "Trait_1", "records": [{"genotype_id": "S1", "environment_id": "E0"}]})
    assert abs(ok["predictions"][0]["prediction"] - float(rows["a"].prediction)) < 1e-9
    assert post({"crop": "Rice", "trait": "Trait_1", "records": []}) == 400 and post({"crop": "X", "trait": "T", "records": [1]}) == 404
    server.shutdown()


def test_a_panel_of_many_genotypes_takes_time_in_proportion(spark):
    began = time.time()
    dosage = spark.range(8 * 20_000).selectExpr("concat('g', id div 8) AS genotype_id", "cast(id % 8 AS int) AS marker_pos", "CASE WHEN id % 11 = 0 THEN NULL ELSE cast(id % 3 AS int) END AS dosage")
    panel = Panel.of(dosage)
    rows = {r.marker_pos: r.x for r in panel.rows.collect()}
    assert time.time() - began < 25  # looked up one by one in a map: the square of the genotypes
    for at in (0, 7, 19_999):
        for pos in range(8):
            i = int(panel.genotypes[at][1:]) * 8 + pos
            assert rows[pos][at] == (None if i % 11 == 0 else i % 3)
