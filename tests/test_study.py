import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from genoscape.operators import alignment, protocols, study
from genoscape.plans import grades, ranks
from genoscape.plans.dialect import Operator, written

SF = "/root/testdata/sf0.001"
OPERATORS = study.OPERATORS | protocols.OPERATORS | alignment.OPERATORS
TABLES = "lineitem events embeddings".split()


def near(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return "nan" if math.isnan(float(v)) else f"{float(v):.3f}"


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_both_engines_agree(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    op = OPERATORS[name]
    mine = op.run(spark, SF)
    other = db.sql(op.sql())
    order = sorted(mine.columns)
    assert order == sorted(other.columns)
    at = [other.columns.index(c) for c in order]
    assert sorted(tuple(near(r[c]) for c in order) for r in mine.collect()) == sorted(tuple(near(r[i]) for i in at) for r in other.fetchall())


def test_bucket_is_the_leading_bits_of_sha256(spark):
    got = spark.sql("SELECT " + written("BUCKET('7|G1', 5)", 0) + " AS b").first().b
    assert got == int(hashlib.sha256(b"7|G1").hexdigest()[:8], 16) % 5


def test_ranks_of_ties_are_averages(spark):
    rows = spark.createDataFrame([("m", "0", "E", float(y), 1.0) for y in (3, 1, 3, 2)], "model string, fold string, environment_id string, y double, yhat double")
    got = sorted((r.y, float(r.ry), float(r.rp)) for r in study.RANKED.on(spark, oof_long=rows).collect())
    assert got == [(1.0, 1.0, 2.5), (2.0, 2.0, 2.5), (3.0, 3.5, 2.5), (3.0, 3.5, 2.5)]


def test_constant_prediction_scores_zero(spark):
    rows = spark.createDataFrame([("m", "0", "E", float(y), 1.0) for y in (3, 1, 2)], "model string, fold string, environment_id string, y double, yhat double")
    ranked = study.RANKED.on(spark, oof_long=rows)
    row = study.FOLD_METRICS.on(spark, ranked=ranked).first()
    assert (row.pearson, row.spearman) == (0.0, 0.0)


def test_ranks_by_ranges_are_exact(spark, monkeypatch):
    """Many ranges, far outliers and a value that a third of the rows share."""
    monkeypatch.setattr(ranks, "PER_BIN", 3)
    draw = random.Random(5)
    rows = [("m", str(k % 2), "E", draw.choice([0.0, draw.gauss(0, 1), draw.gauss(0, 1e9)]), float(draw.randint(0, 40))) for k in range(1500)] + [(None, "0", "E", 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "model string, fold string, environment_id string, y double, yhat double")
    got = Operator.of(ranks.ranked("model, fold", "environment_id", "rows_in"), rows_in=frame).on(spark, rows_in=frame).toPandas()
    assert len(got) == len(rows)
    groups = got.fillna({"model": "-"}).groupby(["model", "fold"])
    assert (groups["y"].rank() == got["ry"]).all() and (groups["yhat"].rank() == got["rp"]).all()
    graded = Operator.of(ranks.graded("model, fold", "rows_in"), rows_in=frame).on(spark, rows_in=frame).where("model = 'm'").toPandas()
    for row in graded.itertuples():
        mine = got[(got.model == "m") & (got.fold == row.fold)]
        assert row.n == len(mine) and row.pearson == pytest.approx(mine.y.corr(mine.yhat)) and row.spearman == pytest.approx(mine.ry.corr(mine.rp))
        assert row.mse == pytest.approx(((mine.y - mine.yhat) ** 2).mean()) and row.mae == pytest.approx((mine.y - mine.yhat).abs().mean())


@pytest.mark.parametrize("per_range", [3, 200, 10**6])
def test_grades_by_cell_are_those_of_observations(spark, monkeypatch, per_range):
    """Many ranges, far outliers, a value that a third of the rows share, ties of predictions, a constant model, cells without prediction, a null key and groups of one."""
    monkeypatch.setattr(grades, "PER_RANGE", per_range)
    draw = random.Random(7)
    names = [(f"G{g}", f"E{e}") for g in range(12) for e in range(4)]
    rows = [(*draw.choice(names), draw.choice([0.0, draw.gauss(0, 1), draw.gauss(0, 1e9)])) for _ in range(900)] + [("G0", "lone", 2.0), ("other", "E0", 1.0)]
    cells = [(p, f"{e}" if p == "a" else None, g, e, 3.5, float(draw.randint(0, 5)) / 3) for p in "ab" for g, e in [*names, ("G0", "lone"), ("unseen", "E1")] if p == "a" or g < "G4"]
    observed = spark.createDataFrame(rows, "genotype_id string, environment_id string, y double")
    predictions = spark.createDataFrame(cells, "protocol string, fold string, genotype_id string, environment_id string, same double, other double")
    got = {(r.protocol, r.fold, r.model): r for r in grades.by_cell(observed, predictions, ["protocol", "fold"], ["same", "other"]).collect()}
    every = observed.toPandas().merge(predictions.toPandas().fillna({"fold": "-"}), on=["genotype_id", "environment_id"])
    assert len(got) == 2 * len(every.groupby(["protocol", "fold"])) == 12
    for (protocol, fold), own in every.groupby(["protocol", "fold"]):
        for model in ("same", "other"):
            r, yhat = got[protocol, None if fold == "-" else fold, model], own[model]
            varied = model == "other" and len(own) > 1
            assert (r.n, r.defined) == (len(own), varied)
            assert r.pearson == pytest.approx(own.y.corr(yhat) if varied else 0, abs=1e-9)
            assert r.spearman == pytest.approx(own.y.rank().corr(yhat.rank()) if varied else 0, abs=1e-9)
            assert r.mse == pytest.approx(((own.y - yhat) ** 2).mean()) and r.mae == pytest.approx((own.y - yhat).abs().mean())


def test_duplicate_markers_are_found(spark):
    codes = {0: "012.", 1: "012.", 2: "0120"}
    rows = [(f"G{g}", m, None if c == "." else int(c)) for m, line in codes.items() for g, c in enumerate(line)]
    found = study.DUPLICATE_MARKERS.on(spark, dosage_long=spark.createDataFrame(rows, "genotype_id string, marker_pos int, dosage int")).collect()
    assert sorted((r.n, r.first_marker, r.duplicated) for r in found) == [(1, 2, False), (2, 0, True)]


def test_presence_is_thinned_evenly(spark):
    rows = spark.range(2000).selectExpr("concat('G', lpad(cast(id AS string), 4, '0')) AS genotype_id", "'E1' AS environment_id")
    kept = study.PRESENCE.on(spark, genotype_presence=study.GENOTYPE_PRESENCE.on(spark, phenotypes=rows))
    want = np.linspace(0, 1999, 650).astype(int).tolist()
    assert sorted(r.place for r in kept.collect()) == want


def test_tokens_are_stripped_and_type_letters_are_no_numbers(spark):
    want = {"1d": "categorical", "2f": "categorical", "NN\t": "missing", "\tAA": "categorical", "1_0": "categorical", " 1.0 ": "numeric", "2\n": "numeric", "+1e0": "numeric", "": "missing", "nan": "missing"}
    rows = spark.createDataFrame([("G", i, t) for i, t in enumerate(want)], "genotype_id string, marker_pos int, token string")
    got = protocols.PARSED.on(spark, tokens=rows).collect()
    assert {list(want)[r.marker_pos]: r.kind for r in got} == want


def test_allele_tables(spark):
    """Numeric, categorical, mixed, multi-allelic, monomorphic and all-missing markers."""
    markers = {0: ["0", "1", "1.0", "2", "NA"], 1: ["AA", "AG", "GG", "AG", "NN"], 2: ["AA", "CT", "G", "TT", "?"], 3: ["AA", "AA", "", "AA", "AA"], 4: ["NA"] * 5, 5: ["1", "AG", "0", "GG", "."], 6: ["1", "1.0", "1", "+1", " 1 "]}
    rows = [(f"g{g}", m, t) for m, line in markers.items() for g, t in enumerate(line)]
    tokens = protocols.MARKER_TOKENS.on(spark, parsed=protocols.PARSED.on(spark, tokens=spark.createDataFrame(rows, "genotype_id string, marker_pos int, token string")))
    alleles = protocols.ALLELE_COUNTS.on(spark, marker_tokens=tokens)
    got = {r.marker_pos: (r.encoding, r.n_called, r.n_alleles, r.multiallelic, r.polymorphic, r.maf, r.heterozygosity) for r in protocols.ALLELE_TABLE.on(spark, marker_tokens=tokens, allele_counts=alleles).collect()}
    assert got == {
        0: ("numeric", 4, 2, False, True, 0.5, 0.5),
        1: ("categorical", 4, 2, False, True, 0.5, 0.5),
        2: ("categorical", 4, 4, True, True, round(1 / 7, 9), 0.25),
        3: ("categorical", 4, 1, False, False, 0.0, 0.0),
        4: ("categorical", 0, 0, False, False, None, None),
        5: ("categorical", 2, 2, False, True, 0.25, 0.5),
        6: ("numeric", 5, 2, False, False, 0.5, 1.0),
    }
