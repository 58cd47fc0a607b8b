"""Quantiles by selection and scans by ranges, held to numpy and pandas on groups of odd shapes."""

import random

import numpy as np
import pytest

from genoscape.operators import study
from genoscape.plans import quantiles, series


def groups():
    draw = random.Random(3)
    yield "spread", [draw.gauss(0, 1) for _ in range(3000)]
    yield "far", [draw.choice([1e300, -1e300, 0.0, draw.random()]) for _ in range(2000)]
    yield "tied", [draw.choice([1.0, 2.0]) for _ in range(2500)]
    yield "hot", [5.0] * 1500 + [draw.random() * 10 for _ in range(1500)]
    yield "equal", [7.0] * 2000
    yield "two", [1.0, 4.0]
    yield "one", [3.0]
    yield "infinite", [float("inf"), float("-inf"), 1.0, 2.0, 3.0]
    yield None, [draw.random() for _ in range(1200)]


@pytest.mark.parametrize("limit, grid, sent", [(40, 200, 100_000), (100, 20, 0), (10**6, 200, 0)])
def test_quantiles_are_exact(spark, monkeypatch, limit, grid, sent):
    """In one pass, by many refinements, and with targets joined by a shuffle."""
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    monkeypatch.setattr(quantiles, "GRID", grid)
    monkeypatch.setattr(quantiles, "SENT", sent)
    held = dict(groups())
    rows = [(g, v) for g, values in held.items() for v in values] + [("none", None), ("one", None)]
    random.Random(1).shuffle(rows)
    at = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    found = quantiles.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", at).collect()
    assert {r.g for r in found} == set(held) and len(found) == len(held)
    for r in found:
        if r.g != "infinite":
            assert np.allclose(r.q, np.quantile(held[r.g], at), rtol=1e-12)
        else:
            assert (r.q[0], r.q[3], r.q[5]) == (float("-inf"), 2.0, float("inf"))


def test_quantiles_of_all_rows_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LIMIT", 50)
    rows = spark.range(1001).selectExpr("cast(id AS double) AS x")
    assert quantiles.quantiles(rows, [], "x", [0.5, 0.123]).first().q == pytest.approx([500.0, 123.0])
    assert quantiles.quantiles(rows.limit(0), [], "x", [0.5]).count() == 0


def test_summaries_by_selection_are_those_of_one_pass(spark, monkeypatch):
    def all_of():
        return [sorted(map(tuple, op.run(spark, "/root/testdata/sf0.001").collect())) for op in (study.TRAIT_SUMMARY, study.TRAIT_BY_ENVIRONMENT)]

    want = all_of()
    monkeypatch.setattr(quantiles, "LIMIT", 100)
    assert all_of() == want


def test_scans_by_ranges(spark, monkeypatch):
    """Groups within one range and over many, one row, a null key, unsorted input."""
    draw = random.Random(9)
    held = {"long": 2000, "mid": 90, "one": 1, None: 70}
    rows = [(g, k, draw.random()) for g, n in held.items() for k in draw.sample(range(10**6), n)]
    want = sorted(((g, k, x, i, len(own), own[i - 1][2] if i else None) for g in held for own in [sorted(r for r in rows if r[0] == g)] for i, (_, k, x) in enumerate(own)), key=str)
    frame = spark.createDataFrame(rows, "g string, at long, x double").repartition(5)
    for size, sent in ((10**6, 10**6), (64, 10**6), (64, 0)):
        monkeypatch.setattr(series, "RANGE", size)
        monkeypatch.setattr(series, "SENT", sent)
        got = series.scanned(frame, ["g"], ["at"], "x").select("g", "at", "x", "place", "n_group", "previous").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert series.scanned(frame.limit(0), ["g"], ["at"], "x").count() == 0


def test_weather_by_ranges_is_that_of_windows(spark, monkeypatch):
    def all_of():
        return sorted(map(tuple, study.WEATHER_DYNAMIC.run(spark, "/root/testdata/sf0.001").collect()))

    want = all_of()
    monkeypatch.setattr(series, "RANGE", 50)
    monkeypatch.setattr(quantiles, "LIMIT", 20)
    got = all_of()
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=2e-6)


def test_thirds_of_short_series(spark):
    rows = [(f"E{n}", "v", i, float(i)) for n in range(1, 9) for i in range(n)]
    got = study.STEPS.on(spark, seen_series=spark.createDataFrame(rows, "environment_id string, variable string, obs_seq long, value double"))
    for n in range(1, 9):
        mine = [int(r.third) for r in got.where(f"environment_id = 'E{n}'").orderBy("obs_seq").collect()]
        assert mine == [k + 1 for k, part in enumerate(np.array_split(range(n), 3)) for _ in part]
