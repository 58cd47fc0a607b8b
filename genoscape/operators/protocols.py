"""Strict protocols, out-of-fold means under all of them, independent test roles, tokens, selection and kernel sums.

Labels of all protocols depend on genotype and environment alone, so observations are summed once
to (genotype, environment) cells; folds, their training means and predictions are made from cells,
and rows meet their cell again only where a row is reported."""

from __future__ import annotations

from ..plans import ranks
from ..plans.dialect import Operator, Sent, Twofold, Written
from ..plans.folds import Greedy
from ..plans.grades import ByCell
from ..plans.roles import DOSAGE, ID_MAP, PHENOTYPES
from .study import CENTERED, FEATURES, GATE, MARKER_QC_B, OOD_ENVIRONMENTS, SEED, STANDARDIZED, _corr, summary

# --- greedy folds --------------------------------------------------------------------------

#: Heaviest first into the least loaded of five folds, ties to the lowest fold.
_GREEDY_OTHER = """WITH RECURSIVE ordered AS (SELECT k, w, row_number() OVER (ORDER BY w DESC, k) AS i FROM weights),
    placed AS (SELECT cast(0 AS bigint) AS i, cast(NULL AS varchar) AS k, cast(-1 AS bigint) AS f, cast([0, 0, 0, 0, 0] AS bigint[]) AS loads
    UNION ALL SELECT o.i, o.k, list_position(p.loads, list_min(p.loads)) - 1,
    [CASE WHEN j = list_position(p.loads, list_min(p.loads)) THEN p.loads[j] + o.w ELSE p.loads[j] END FOR j IN range(1, 6)]
    FROM placed AS p JOIN ordered AS o ON o.i = p.i + 1) SELECT k, cast(f AS varchar) AS fold FROM placed WHERE i > 0"""


def _greedy(weights: Operator, name: str) -> Operator:
    return Greedy("", ((name, weights),), _GREEDY_OTHER.replace("weights", name))


def _kept(text: str, **inputs: Operator) -> Operator:
    """Small beside the observations and read many times over: written once, so that these are not summed again for every reader."""
    return Written(text, tuple(inputs.items()), text)


CELLS = _kept("SELECT genotype_id, environment_id, count(*) AS n_rows, sum(trait_1) AS s, count(trait_1) AS n FROM phenotypes GROUP BY genotype_id, environment_id", phenotypes=PHENOTYPES)
CLUSTERS = Operator.of("SELECT 'G' || cast(vec_id AS string) AS genotype_id, cast(label AS string) AS cluster FROM embeddings", embeddings="embeddings")
GENOTYPE_WEIGHTS = Operator.of("SELECT genotype_id AS k, cast(sum(n_rows) AS bigint) AS w FROM cells GROUP BY genotype_id", cells=CELLS)
ENVIRONMENT_WEIGHTS = Operator.of("SELECT environment_id AS k, cast(sum(n_rows) AS bigint) AS w FROM cells GROUP BY environment_id", cells=CELLS)
CLUSTER_WEIGHTS = Operator.of("SELECT cluster AS k, cast(sum(n_rows) AS bigint) AS w FROM cells JOIN clusters ON cells.genotype_id = clusters.genotype_id GROUP BY cluster", cells=CELLS, clusters=CLUSTERS)
GREEDY_GENOTYPE_FOLDS = _greedy(GENOTYPE_WEIGHTS, "genotype_weights")
GREEDY_ENVIRONMENT_FOLDS = _greedy(ENVIRONMENT_WEIGHTS, "environment_weights")
GREEDY_CLUSTER_FOLDS = _greedy(CLUSTER_WEIGHTS, "cluster_weights")
#: Hashed genotype folds by greedy environment folds: validation where both are the fold, training where neither is, else purged.
CV_GE = Operator.of(
    f"""SELECT row_id, genotype_id, environment_id, fold, CASE WHEN g = fold AND e = fold THEN 'validation' WHEN g <> fold AND e <> fold THEN 'train' ELSE 'purge' END AS role
    FROM (SELECT p.row_id, p.genotype_id, p.environment_id, cast(BUCKET('{SEED}|genotype|' || p.genotype_id, 5) AS string) AS g, f.fold AS e FROM phenotypes AS p
    JOIN environment_folds AS f ON p.environment_id = f.k) AS h CROSS JOIN (SELECT cast(k AS string) AS fold FROM (SELECT SERIES(0, 4) AS k) AS s) AS folds""",
    phenotypes=PHENOTYPES, environment_folds=GREEDY_ENVIRONMENT_FOLDS)
SPLIT_SUMMARY = Operator.of("SELECT fold, role, count(*) AS n_rows, count(DISTINCT genotype_id) AS n_genotypes, count(DISTINCT environment_id) AS n_environments FROM cv_ge GROUP BY fold, role", cv_ge=CV_GE)
LEAKS = Operator.of(
    """SELECT v.fold, count(*) AS n_shared FROM (SELECT DISTINCT fold, genotype_id FROM cv_ge WHERE role = 'validation') AS v
    JOIN (SELECT DISTINCT fold, genotype_id FROM cv_ge WHERE role = 'train') AS t ON v.fold = t.fold AND v.genotype_id = t.genotype_id GROUP BY v.fold""", cv_ge=CV_GE)  # fmt: skip
#: Number of clusters: the least uneven of those whose smallest has 100 rows, else of all.
CLUSTER_CHOICE = Operator.of(
    """SELECT k, smallest, round(imbalance, 9) AS imbalance, smallest >= 100 AS feasible,
    row_number() OVER (ORDER BY CASE WHEN smallest >= 100 THEN 0 ELSE 1 END, imbalance, -smallest, k) = 1 AS chosen
    FROM (SELECT n AS k, min(w) AS smallest, stddev_pop(w) / avg(w) AS imbalance FROM (SELECT cast(sum(c.w) AS bigint) AS w, g.n AS n
    FROM cluster_weights AS c CROSS JOIN (SELECT SERIES(4, 6) AS n) AS g GROUP BY g.n, cast(c.k AS bigint) % g.n) AS p GROUP BY n) AS q""", cluster_weights=CLUSTER_WEIGHTS)  # fmt: skip

# --- distances from the centre -------------------------------------------------------------

GENOTYPE_PCS = Operator.of(
    """SELECT genotype_id, pc, cast(ELEMENT(embedding, pc) AS double) AS value
    FROM (SELECT 'G' || cast(vec_id AS string) AS genotype_id, embedding, SERIES(1, 4) AS pc FROM embeddings) AS e""", embeddings="embeddings")  # fmt: skip
OOD_GENOTYPES = Operator.of(
    """SELECT genotype_id, pct FROM (SELECT genotype_id, row_number() OVER (ORDER BY norm DESC, genotype_id) AS place, count(*) OVER () AS n
    FROM (SELECT p.genotype_id, round(sqrt(sum(power((p.value - c.center) / c.scale, 2))), 6) AS norm FROM genotype_pcs AS p
    JOIN (SELECT pc, avg(value) AS center, CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM genotype_pcs GROUP BY pc) AS c ON p.pc = c.pc
    GROUP BY p.genotype_id) AS d) AS r JOIN (SELECT 5 * k AS pct FROM (SELECT SERIES(2, 4) AS k) AS s) AS tails ON place <= ceil(n * pct / 100.0)""",
    genotype_pcs=GENOTYPE_PCS)


def _radius(entity: str, axis: str, table: str) -> str:
    """Root of the mean square distance from the medians, missing values at the median, in units of the spread."""
    return f"""SELECT v.{entity}, round(sqrt(avg(power((coalesce(v.value, c.mid) - c.mid) / c.scale, 2))), 6) AS radius FROM {table} AS v
    JOIN (SELECT {axis}, PCT(value, 0.5) AS mid, CASE WHEN stddev_pop(value) < 1e-8 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM {table} GROUP BY {axis}) AS c
    ON v.{axis} = c.{axis} WHERE c.mid IS NOT NULL GROUP BY v.{entity}"""


GENOTYPE_NOVELTY = Operator.of(_radius("genotype_id", "pc", "genotype_pcs"), genotype_pcs=GENOTYPE_PCS)
ENVIRONMENT_NOVELTY = Operator.of(_radius("environment_id", "feature", "features"), features=FEATURES)
HARD_ENVIRONMENTS = Operator.of(
    """SELECT environment_id FROM (SELECT environment_id, row_number() OVER (ORDER BY radius DESC, environment_id DESC) AS place, count(*) OVER () AS n FROM environment_novelty) AS r
    WHERE place <= least(greatest(1, HALF_EVEN(n * 0.2)), greatest(1, n - 1))""", environment_novelty=ENVIRONMENT_NOVELTY)  # fmt: skip
#: The farthest tenth of the genotypes seen in a hard environment (of all, if too few are).
HARD_GENOTYPES = Operator.of(
    """SELECT genotype_id, radius FROM (SELECT genotype_id, radius, tail, seen, enough, row_number() OVER (ORDER BY CASE WHEN enough AND NOT seen THEN 1 ELSE 0 END, radius DESC, genotype_id DESC) AS place
    FROM (SELECT n.genotype_id, n.radius, s.genotype_id IS NOT NULL AS seen, greatest(1, HALF_EVEN(count(*) OVER () * 0.1)) AS tail,
    count(s.genotype_id) OVER () >= greatest(1, HALF_EVEN(count(*) OVER () * 0.1)) AS enough FROM genotype_novelty AS n
    LEFT JOIN (SELECT DISTINCT c.genotype_id FROM cells AS c JOIN hard_environments AS h ON c.environment_id = h.environment_id) AS s ON n.genotype_id = s.genotype_id) AS q) AS r
    WHERE place <= tail""", genotype_novelty=GENOTYPE_NOVELTY, cells=CELLS, hard_environments=HARD_ENVIRONMENTS)  # fmt: skip
EASY_GENOTYPES = Operator.of(
    """SELECT genotype_id FROM (SELECT n.genotype_id, row_number() OVER (ORDER BY CASE WHEN h.genotype_id IS NULL THEN 0 ELSE 1 END, n.radius, n.genotype_id) AS place,
    greatest(1, HALF_EVEN(count(*) OVER () * 0.1)) AS tail, h.genotype_id IS NULL AS free FROM genotype_novelty AS n
    LEFT JOIN hard_genotypes AS h ON n.genotype_id = h.genotype_id) AS r WHERE place <= tail AND free""", genotype_novelty=GENOTYPE_NOVELTY, hard_genotypes=HARD_GENOTYPES)  # fmt: skip
CELL_ROLES = Operator.of(
    """SELECT c.genotype_id, c.environment_id, c.n_rows, CASE WHEN e.genotype_id IS NOT NULL AND v.environment_id IS NOT NULL THEN 'purge_mixed'
    WHEN e.genotype_id IS NOT NULL THEN 'test_easy_g' WHEN h.genotype_id IS NOT NULL AND v.environment_id IS NOT NULL THEN 'test_hard_ge' WHEN h.genotype_id IS NOT NULL THEN 'test_hard_g'
    WHEN v.environment_id IS NOT NULL THEN 'test_hard_e' ELSE 'development' END AS role
    FROM cells AS c LEFT JOIN easy_genotypes AS e ON c.genotype_id = e.genotype_id LEFT JOIN hard_genotypes AS h ON c.genotype_id = h.genotype_id
    LEFT JOIN hard_environments AS v ON c.environment_id = v.environment_id""",
    cells=CELLS, easy_genotypes=EASY_GENOTYPES, hard_genotypes=HARD_GENOTYPES, hard_environments=HARD_ENVIRONMENTS)
INDEPENDENT_ROLES = Operator.of(
    """SELECT p.row_id, p.genotype_id, p.environment_id, r.role FROM phenotypes AS p
    JOIN cell_roles AS r ON p.genotype_id = r.genotype_id AND p.environment_id = r.environment_id""", phenotypes=PHENOTYPES, cell_roles=CELL_ROLES)  # fmt: skip
ROLE_SUMMARY = Operator.of("SELECT role, cast(sum(n_rows) AS bigint) AS n_rows, count(DISTINCT genotype_id) AS n_genotypes, count(DISTINCT environment_id) AS n_environments FROM cell_roles GROUP BY role", cell_roles=CELL_ROLES)
#: Genotypes or environments that development shares with a test that must not have them; empty when the design holds.
ROLE_LEAKS = Operator.of(
    """SELECT t.role, count(*) AS n_shared FROM (SELECT DISTINCT role, genotype_id AS k FROM cell_roles WHERE role IN ('test_easy_g', 'test_hard_g', 'test_hard_ge')
    UNION SELECT DISTINCT role, environment_id AS k FROM cell_roles WHERE role IN ('test_hard_e', 'test_hard_ge')) AS t
    JOIN (SELECT DISTINCT genotype_id AS k FROM cell_roles WHERE role = 'development' UNION SELECT DISTINCT environment_id AS k FROM cell_roles WHERE role = 'development') AS d
    ON t.k = d.k GROUP BY t.role""", cell_roles=CELL_ROLES)  # fmt: skip

# --- all protocols at once -----------------------------------------------------------------

_TAILS = (10, 15, 20)
_HELD = ", ".join(f"max(CASE WHEN pct = {t} THEN 1 ELSE 0 END) AS t{t}" for t in _TAILS)
CELL_LABELS = Operator.of(
    f"""SELECT c.genotype_id, c.environment_id, c.n_rows, c.s, c.n, cast(BUCKET('{SEED}|genotype|' || c.genotype_id, 5) AS string) AS hash_g, g.fold AS greedy_g, k.cluster, kf.fold AS greedy_cluster, e.fold AS greedy_e,
    {", ".join(f"coalesce(og.t{t}, 0) AS g{t}, coalesce(oe.t{t}, 0) AS e{t}" for t in _TAILS)}
    FROM cells AS c JOIN genotype_folds AS g ON c.genotype_id = g.k JOIN clusters AS k ON c.genotype_id = k.genotype_id JOIN cluster_folds AS kf ON k.cluster = kf.k
    JOIN environment_folds AS e ON c.environment_id = e.k LEFT JOIN (SELECT genotype_id, {_HELD} FROM ood_genotypes GROUP BY genotype_id) AS og ON c.genotype_id = og.genotype_id
    LEFT JOIN (SELECT environment_id, {_HELD} FROM ood_environments GROUP BY environment_id) AS oe ON c.environment_id = oe.environment_id""",
    cells=CELLS, genotype_folds=GREEDY_GENOTYPE_FOLDS, clusters=CLUSTERS, cluster_folds=GREEDY_CLUSTER_FOLDS, environment_folds=GREEDY_ENVIRONMENT_FOLDS,
    ood_genotypes=OOD_GENOTYPES, ood_environments=OOD_ENVIRONMENTS)


def _inner(key: str, seed: int) -> str:
    return f"BUCKET('{seed}|' || {key}, 4)"


_PAIR = "p.genotype_id || '|' || p.environment_id"
_OUTER = ", ".join(f"CASE WHEN g{t} = 1 THEN 'validation' ELSE 'train' END AS ood_g_{t}, CASE WHEN e{t} = 1 THEN 'validation' ELSE 'train' END AS ood_e_{t}, CASE WHEN g{t} = 1 AND e{t} = 1 THEN 'validation' WHEN g{t} + e{t} = 1 THEN 'purge' ELSE 'train' END AS ood_ge_{t}" for t in _TAILS)
#: One row an observation with its fold under every protocol and its inner fold for choices within training rows.
STRICT_REGISTRY = Operator.of(
    f"""SELECT p.row_id, p.genotype_id, p.environment_id, greedy_g AS cv_g, cluster AS cv_gcluster, p.environment_id AS cv_e, greedy_cluster || '|' || greedy_e AS cv_ge, {_OUTER},
    {_inner("p.genotype_id", SEED + 1)} AS inner_cv_g, {_inner("cluster", SEED + 1)} AS inner_cv_gcluster, {_inner("p.environment_id", SEED + 1)} AS inner_cv_e, {_inner(_PAIR, SEED + 1)} AS inner_cv_ge,
    {", ".join(f"{_inner('p.genotype_id', SEED + t)} AS inner_ood_g_{t}, {_inner('p.environment_id', SEED + t)} AS inner_ood_e_{t}, {_inner(_PAIR, SEED + t)} AS inner_ood_ge_{t}" for t in _TAILS)}
    FROM phenotypes AS p JOIN cell_labels AS c ON p.genotype_id = c.genotype_id AND p.environment_id = c.environment_id""", phenotypes=PHENOTYPES, cell_labels=CELL_LABELS)  # fmt: skip

#: Two labels a cell and protocol: a cell is validated in fold f where both are f, trains where neither is, else is purged.
_LABELS = [("cv_g", "greedy_g", "greedy_g"), ("cv_gcluster", "cluster", "cluster"), ("cv_e", "environment_id", "environment_id"), ("cv_ge", "greedy_cluster", "greedy_e"), ("library_cv_g", "hash_g", "hash_g"), ("library_cv_ge", "hash_g", "greedy_e")]
for _t in _TAILS:
    _g, _e = f"CASE WHEN g{_t} = 1 THEN 'held' ELSE 'left' END", f"CASE WHEN e{_t} = 1 THEN 'held' ELSE 'right' END"
    _LABELS += [(f"ood_g_{_t}", _g, _g.replace("left", "right")), (f"ood_e_{_t}", _e.replace("right", "left"), _e), (f"ood_ge_{_t}", _g, _e)]


def _by_protocol(k: int) -> str:
    return "CASE i " + " ".join(f"WHEN {n} THEN " + (f"'{row[0]}'" if k == 0 else row[k]) for n, row in enumerate(_LABELS)) + " END"


DESIGN = _kept(
    f"""SELECT {_by_protocol(0)} AS protocol, genotype_id, environment_id, n_rows, s, n, {_by_protocol(1)} AS fg, {_by_protocol(2)} AS fe
    FROM (SELECT *, SERIES(0, {len(_LABELS) - 1}) AS i FROM cell_labels) AS x""", cell_labels=CELL_LABELS)  # fmt: skip
PROTOCOL_SUMMARY = Operator.of(
    """SELECT protocol, fg AS fold, cast(sum(n_rows) AS bigint) AS n_validation, count(DISTINCT genotype_id) AS n_genotypes, count(DISTINCT environment_id) AS n_environments, sum(n_rows) >= 100 AS eligible
    FROM design WHERE fg = fe GROUP BY protocol, fg""", design=DESIGN)  # fmt: skip
#: Sums of what a fold leaves out (and of all, fold '*'), overall, by environment and by genotype in one scan of the cells.
LEFT_OUT = Operator.of(
    """SELECT protocol, f, environment_id, genotype_id, grouping(environment_id) AS no_e, grouping(genotype_id) AS no_g, sum(s) AS s, sum(n) AS n
    FROM (SELECT protocol, CASE i WHEN 1 THEN '*' WHEN 2 THEN fg ELSE fe END AS f, environment_id, genotype_id, s, n FROM (SELECT *, SERIES(1, 3) AS i FROM design) AS d WHERE i < 3 OR fg <> fe) AS t
    GROUP BY GROUPING SETS ((protocol, f), (protocol, f, environment_id), (protocol, f, genotype_id))""", design=DESIGN)  # fmt: skip
TRAIN_MEANS = Operator.of(
    """SELECT x.protocol, x.f AS fold, x.environment_id, x.genotype_id, x.no_e, x.no_g, (coalesce(t.s, 0) - coalesce(x.s, 0)) / nullif(t.n - x.n, 0) AS m
    FROM (SELECT * FROM left_out WHERE f <> '*') AS x JOIN (SELECT * FROM left_out WHERE f = '*') AS t ON x.protocol = t.protocol AND x.no_e = t.no_e AND x.no_g = t.no_g
    AND x.environment_id IS NOT DISTINCT FROM t.environment_id AND x.genotype_id IS NOT DISTINCT FROM t.genotype_id""", left_out=LEFT_OUT)  # fmt: skip
CELL_PREDICTIONS = _kept(
    """SELECT protocol, fold, genotype_id, environment_id, s, n, round(mu, 8) AS global_mean, round(coalesce(em, mu), 8) AS environment_mean, round(coalesce(gm, mu), 8) AS genotype_mean,
    round(mu + coalesce(gm - mu, 0) + coalesce(em - mu, 0), 8) AS additive_mean
    FROM (SELECT v.protocol, v.fg AS fold, v.genotype_id, v.environment_id, v.s, v.n, coalesce(a.m, 0) AS mu, e.m AS em, g.m AS gm
    FROM (SELECT * FROM design WHERE fg = fe) AS v JOIN (SELECT * FROM train_means WHERE no_e = 1 AND no_g = 1) AS a ON v.protocol = a.protocol AND v.fg = a.fold
    LEFT JOIN (SELECT * FROM train_means WHERE no_e = 0) AS e ON v.protocol = e.protocol AND v.fg = e.fold AND v.environment_id = e.environment_id
    LEFT JOIN (SELECT * FROM train_means WHERE no_g = 0) AS g ON v.protocol = g.protocol AND v.fg = g.fold AND v.genotype_id = g.genotype_id) AS j""",
    design=DESIGN, train_means=TRAIN_MEANS)
OOF_PROTOCOLS = Sent(
    """SELECT c.protocol, c.fold, p.row_id, p.genotype_id, p.environment_id, p.trait_1 AS y, c.global_mean, c.environment_mean, c.genotype_mean, c.additive_mean
    FROM (SELECT * FROM phenotypes WHERE trait_1 IS NOT NULL) AS p JOIN cell_predictions AS c ON p.genotype_id = c.genotype_id AND p.environment_id = c.environment_id""",
    (("phenotypes", PHENOTYPES), ("cell_predictions", CELL_PREDICTIONS)), "c", "cell_predictions")
_EACH_MODEL = """SELECT protocol, fold, environment_id, y, CASE i WHEN 1 THEN 'global_mean' WHEN 2 THEN 'environment_mean' WHEN 3 THEN 'genotype_mean' ELSE 'additive_mean' END AS model,
    CASE i WHEN 1 THEN global_mean WHEN 2 THEN environment_mean WHEN 3 THEN genotype_mean ELSE additive_mean END AS yhat FROM (SELECT *, SERIES(1, 4) AS i FROM {0}) AS o"""
MEANS = ("global_mean", "environment_mean", "genotype_mean", "additive_mean")
VALUES = Operator.of("SELECT genotype_id, environment_id, trait_1 AS y FROM phenotypes WHERE trait_1 IS NOT NULL", phenotypes=PHENOTYPES)
#: What the second engine grades; Spark grades by cell and multiplies no observation by models.
OBSERVED = Operator.of(
    "SELECT genotype_id, environment_id, trait_1 AS y, count(*) AS m FROM phenotypes WHERE trait_1 IS NOT NULL GROUP BY genotype_id, environment_id, trait_1", phenotypes=PHENOTYPES)
MODEL_ROWS = Operator.of(_EACH_MODEL.format("oof_protocols"), observed=OBSERVED, cell_predictions=CELL_PREDICTIONS, oof_protocols=OOF_PROTOCOLS)


def _graded(keys: str, rows: str) -> str:
    """Metrics within groups of keys; ranks of ties are averages."""
    return f"""SELECT {keys}, count(*) AS n, {_corr("y", "yhat")} AS pearson, {_corr("ry", "rp")} AS spearman, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae,
    stddev_pop(y) > 1e-12 AND stddev_pop(yhat) > 1e-12 AS defined FROM (SELECT {keys}, y, yhat, rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY {keys} ORDER BY yhat) + (count(*) OVER (PARTITION BY {keys}, yhat) - 1) / 2.0 AS rp FROM {rows}) AS r GROUP BY {keys}"""


def _shown(keys: str) -> str:
    return f"SELECT {keys}, n, round(pearson, 5) AS pearson, round(spearman, 5) AS spearman, round((pearson + spearman) / 2, 5) AS score, round(mse, 4) AS mse, round(sqrt(mse), 5) AS rmse, round(mae, 5) AS mae, defined FROM graded"


def _graded_by_cell(keys: str) -> ByCell:
    return ByCell("", (("model_rows", MODEL_ROWS),), _graded(keys, "model_rows"), VALUES, CELL_PREDICTIONS, tuple(k.strip() for k in keys.split(",") if k.strip() != "model"), MEANS)


def _graded_on(keys: str, name: str, rows: Operator, weight: str = "count(*)") -> Operator:
    """The first engine ranks counted ties in ranges of values; the second follows the definition."""
    return Twofold(ranks.graded(keys, name, weight), ((name, rows),), _graded(keys, name))


BY_FOLD = _graded_by_cell("protocol, model, fold")
BY_ENVIRONMENT = _graded_by_cell("protocol, model, environment_id")
POOLED = _graded_by_cell("protocol, model")
METRICS_BY_FOLD = Operator.of(_shown("protocol, model, fold"), graded=BY_FOLD)
METRICS_BY_ENVIRONMENT = Operator.of(_shown("protocol, model, environment_id"), graded=BY_ENVIRONMENT)
METRICS_BY_PROTOCOL = Operator.of(_shown("protocol, model"), graded=POOLED)
ENVIRONMENT_MACRO = Operator.of(
    """SELECT protocol, model, count(*) AS n_environments, round(avg((pearson + spearman) / 2), 5) AS macro_score, round(sum(n * (pearson + spearman) / 2) / sum(n), 5) AS weighted_score,
    round(avg(pearson), 5) AS macro_pearson, round(avg(spearman), 5) AS macro_spearman, round(PCT((pearson + spearman) / 2, 0.5), 5) AS median_score, round(min((pearson + spearman) / 2), 5) AS worst_score
    FROM by_environment GROUP BY protocol, model""", by_environment=BY_ENVIRONMENT)  # fmt: skip
_CORE = "'cv_g', 'cv_gcluster', 'cv_e', 'cv_ge'"
STRICT_LEADERBOARD = Operator.of(
    f"""SELECT p.model, {", ".join(f"round(max(CASE WHEN protocol = '{c}' THEN score END), 5) AS {c}" for c in ("cv_g", "cv_gcluster", "cv_e", "cv_ge"))},
    {", ".join(f"round(avg(CASE WHEN protocol LIKE '{o.replace('_', '!_')}!_%' ESCAPE '!' THEN score END), 5) AS {o}" for o in ("ood_g", "ood_e", "ood_ge"))},
    round(avg(CASE WHEN protocol IN ({_CORE}) THEN score END), 5) AS robust_score, max(f.worst) AS worst_score, max(f.sd) AS fold_sd, max(f.rmse) AS rmse, max(f.n_folds) AS n_folds,
    CASE WHEN count(CASE WHEN protocol IN ({_CORE}) THEN 1 END) = 4 THEN 'complete' ELSE 'partial' END AS status
    FROM (SELECT protocol, model, (pearson + spearman) / 2 AS score FROM pooled) AS p
    JOIN (SELECT model, round(min((pearson + spearman) / 2), 5) AS worst, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp((pearson + spearman) / 2) END, 5) AS sd, round(avg(sqrt(mse)), 5) AS rmse, count(*) AS n_folds
    FROM by_fold WHERE protocol NOT LIKE 'library%' GROUP BY model) AS f ON p.model = f.model GROUP BY p.model""", pooled=POOLED, by_fold=BY_FOLD)  # fmt: skip
#: For every fold the model that is best on the mean of the other folds, ties by name.
NESTED_SELECT = Operator.of(
    """SELECT protocol, fold, model FROM (SELECT protocol, fold, model, row_number() OVER (PARTITION BY protocol, fold ORDER BY others DESC, model) AS place
    FROM (SELECT protocol, fold, model, round((sum(score) OVER (PARTITION BY protocol, model) - score) / nullif(count(*) OVER (PARTITION BY protocol, model) - 1, 0), 7) AS others
    FROM (SELECT protocol, fold, model, (pearson + spearman) / 2 AS score FROM by_fold WHERE protocol NOT LIKE 'ood%') AS b) AS o) AS r WHERE place = 1""", by_fold=BY_FOLD)  # fmt: skip

# --- blends --------------------------------------------------------------------------------

EQUAL_ENSEMBLE = Operator.of("SELECT protocol, fold, row_id, genotype_id, environment_id, y, round((environment_mean + genotype_mean) / 2, 7) AS prediction FROM oof_protocols", oof_protocols=OOF_PROTOCOLS)
_GRID = """SELECT c.genotype_id, h.held, w.w, c.s / c.n AS y, w.w * c.genotype_mean + (1 - w.w) * c.environment_mean AS yhat FROM (SELECT * FROM cell_predictions WHERE protocol = 'cv_g' AND n > 0) AS c
    JOIN (SELECT DISTINCT fold AS held FROM cell_predictions WHERE protocol = 'cv_g') AS h ON c.fold <> h.held CROSS JOIN (SELECT cast(k AS double) / 20 AS w FROM (SELECT SERIES(0, 20) AS k) AS s) AS w"""
GRID_ROWS = Written(_GRID, (("cell_predictions", CELL_PREDICTIONS),), _GRID)
GRID_SCORES = _graded_on("held, w", "grid_rows", GRID_ROWS)
#: Weight of a two-model blend for a fold, chosen on the cells of the others; the first best of 21.
CROSSFIT_WEIGHT = Operator.of(
    """SELECT held AS fold, w, score FROM (SELECT held, w, score, row_number() OVER (PARTITION BY held ORDER BY score DESC, w) AS place
    FROM (SELECT held, w, round((pearson + spearman) / 2, 6) AS score FROM grid_scores) AS g) AS r WHERE place = 1""", grid_scores=GRID_SCORES)  # fmt: skip
CROSSFIT_BLEND = Operator.of(
    """SELECT c.fold, c.genotype_id, c.environment_id, round(w.w * c.genotype_mean + (1 - w.w) * c.environment_mean, 6) AS prediction FROM (SELECT * FROM cell_predictions WHERE protocol = 'cv_g') AS c
    JOIN crossfit_weight AS w ON c.fold = w.fold""", cell_predictions=CELL_PREDICTIONS, crossfit_weight=CROSSFIT_WEIGHT)  # fmt: skip
GATED_BLEND = Operator.of(
    """SELECT c.fold, c.genotype_id, c.environment_id, g.weight, round((1 - g.weight) * c.additive_mean + g.weight * c.global_mean, 6) AS prediction
    FROM (SELECT * FROM cell_predictions WHERE protocol = 'cv_e') AS c JOIN gate AS g ON c.environment_id = g.environment_id""", cell_predictions=CELL_PREDICTIONS, gate=GATE)  # fmt: skip
#: Early-stopping rows within the training rows of each fold; too small a pair of parts falls back to genotypes, then to rows.
INNER_ROWS = Sent(
    f"""SELECT d.fold, p.row_id, BUCKET('{SEED + 17}|inner-genotype|' || p.genotype_id, 5) = 0 AS g, BUCKET('{SEED + 19}|inner-environment|' || p.environment_id, 5) = 0 AS e,
    BUCKET('{SEED + 23}|row|' || cast(p.row_id AS string), 5) = 0 AS r FROM phenotypes AS p
    JOIN (SELECT c.genotype_id, c.environment_id, f.fold FROM design AS c CROSS JOIN (SELECT cast(k AS string) AS fold FROM (SELECT SERIES(0, 4) AS k) AS s) AS f
    WHERE c.protocol = 'library_cv_ge' AND c.fg <> f.fold AND c.fe <> f.fold) AS d ON p.genotype_id = d.genotype_id AND p.environment_id = d.environment_id""", (("phenotypes", PHENOTYPES), ("design", DESIGN)), "d", "design")  # fmt: skip
_INNER = """SELECT i.fold, i.row_id, CASE WHEN least(both_n, none_n) >= 8 THEN CASE WHEN g AND e THEN 'validation' WHEN NOT g AND NOT e THEN 'train' ELSE 'unused' END
    WHEN least(g_n, n - g_n) >= 8 THEN CASE WHEN g THEN 'validation' ELSE 'train' END ELSE CASE WHEN r THEN 'validation' ELSE 'train' END END AS role FROM inner_rows AS i
    JOIN (SELECT fold, count(*) AS n, count(CASE WHEN g AND e THEN 1 END) AS both_n, count(CASE WHEN NOT g AND NOT e THEN 1 END) AS none_n, count(CASE WHEN g THEN 1 END) AS g_n FROM inner_rows GROUP BY fold) AS c
    ON i.fold = c.fold"""
#: The counts are one row a fold: by their fold the rows would meet in as few tasks as there are folds.
INNER_SPLIT = Twofold(_INNER.replace("SELECT ", "SELECT /*+ BROADCAST(c) */ ", 1), (("inner_rows", INNER_ROWS),), _INNER)

# --- tokens, similarity, kernel sums -------------------------------------------------------

TOKENS = Operator.of(
    """SELECT genotype_id, marker_pos, CASE WHEN marker_pos % 4 = 0 THEN coalesce(cast(dosage AS string) || '.0', ' NA ')
    WHEN marker_pos = 1 AND dosage = 2 THEN '2' ELSE CASE dosage WHEN 0 THEN 'AA' WHEN 1 THEN 'AG' WHEN 2 THEN 'GG' ELSE 'NN' END END AS token FROM dosage_long""", dosage_long=DOSAGE)  # fmt: skip
#: Tokens that stand for no call.
MISSING = "'', 'NA', 'N/A', 'N', 'NN', '-9', '.', '?', 'nan', 'NaN'"
#: What counts as a number: digits with single underscores between them, a point, an exponent; no type letters (1d).
_NUMERAL = "'^[+-]?([0-9]+(_[0-9]+)*[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
PARSED = Operator.of(
    f"""SELECT genotype_id, marker_pos, token, CASE WHEN token IN ({MISSING}) THEN 'missing' WHEN MATCHES(token, {_NUMERAL}) AND NUMBER(replace(token, '_', '')) IN (0, 1, 2) THEN 'numeric' ELSE 'categorical' END AS kind
    FROM (SELECT genotype_id, marker_pos, STRIPPED(token) AS token FROM tokens) AS t""", tokens=TOKENS)  # fmt: skip
#: The rarest character of a marker's categorical tokens, ties by character.
MINOR = Operator.of(
    """SELECT marker_pos, allele AS minor FROM (SELECT marker_pos, allele, row_number() OVER (PARTITION BY marker_pos ORDER BY n, allele) AS place
    FROM (SELECT marker_pos, substr(token, i, 1) AS allele, count(*) AS n FROM (SELECT marker_pos, token, SERIES(1, length(token)) AS i FROM parsed WHERE kind = 'categorical') AS c
    GROUP BY marker_pos, substr(token, i, 1)) AS a) AS r WHERE place = 1""", parsed=PARSED)  # fmt: skip
#: A marker with any categorical token is categorical, and its numeric tokens are missing.
TOKEN_CODES = Operator.of(
    """SELECT p.genotype_id, p.marker_pos, CASE WHEN p.kind = 'missing' THEN NULL WHEN m.minor IS NULL THEN cast(NUMBER(replace(p.token, '_', '')) AS integer) WHEN p.kind = 'numeric' THEN NULL
    WHEN substr(p.token, 1, 1) = m.minor THEN 1 ELSE 0 END + CASE WHEN m.minor IS NOT NULL AND length(p.token) > 1 AND substr(p.token, 2, 1) = m.minor THEN 1 ELSE 0 END AS dosage
    FROM parsed AS p LEFT JOIN minor ON p.marker_pos = minor.marker_pos""".replace("m.minor", "minor.minor"), parsed=PARSED, minor=MINOR)  # fmt: skip
#: Tokens of a marker with their counts: all that the tables below read, whatever the number of genotypes.
MARKER_TOKENS = Operator.of(
    """SELECT marker_pos, token, kind, n, CASE WHEN kind = 'numeric' THEN cast(cast(NUMBER(replace(token, '_', '')) AS integer) AS string) WHEN kind = 'categorical' THEN token END AS value
    FROM (SELECT marker_pos, token, kind, count(*) AS n FROM parsed GROUP BY marker_pos, token, kind) AS t""", parsed=PARSED)  # fmt: skip
TOKEN_COUNTS = Operator.of("SELECT token, kind, cast(sum(n) AS bigint) AS n, count(DISTINCT marker_pos) AS n_markers FROM marker_tokens GROUP BY token, kind", marker_tokens=MARKER_TOKENS)
ENCODING_COUNTS = Operator.of("SELECT kind, cast(sum(n) AS bigint) AS n, count(DISTINCT marker_pos) AS n_markers FROM marker_tokens GROUP BY kind", marker_tokens=MARKER_TOKENS)
ALLELE_COUNTS = Operator.of(
    """SELECT marker_pos, substr(token, i, 1) AS allele, cast(sum(n) AS bigint) AS n FROM (SELECT marker_pos, token, n, SERIES(1, length(token)) AS i FROM marker_tokens WHERE kind = 'categorical') AS c
    GROUP BY marker_pos, substr(token, i, 1)""", marker_tokens=MARKER_TOKENS)  # fmt: skip
#: A marker with numeric tokens alone is numeric and has two alleles; else its alleles are the characters of its categorical tokens.
ALLELE_TABLE = Operator.of(
    """SELECT t.marker_pos, CASE WHEN is_numeric THEN 'numeric' ELSE 'categorical' END AS encoding, n_tokens, CASE WHEN is_numeric THEN n_numeric ELSE n_categorical END AS n_called,
    round(1 - CASE WHEN is_numeric THEN n_numeric ELSE n_categorical END / cast(n_tokens AS double), 9) AS missing_rate, CASE WHEN is_numeric THEN 2 ELSE coalesce(a.n_alleles, 0) END AS n_alleles,
    CASE WHEN is_numeric THEN false ELSE coalesce(a.n_alleles, 0) > 2 END AS multiallelic, n_values > 1 AS polymorphic,
    round(CASE WHEN is_numeric THEN least(dosages / (2 * cast(n_numeric AS double)), 1 - dosages / (2 * cast(n_numeric AS double))) ELSE least(a.fewest, a.n - a.fewest) / cast(a.n AS double) END, 9) AS maf,
    round(CASE WHEN is_numeric THEN ones / cast(n_numeric AS double) WHEN n_categorical > 0 THEN hets / cast(n_categorical AS double) END, 9) AS heterozygosity
    FROM (SELECT *, n_numeric > 0 AND n_categorical = 0 AS is_numeric FROM (SELECT marker_pos, cast(sum(n) AS bigint) AS n_tokens, cast(sum(CASE WHEN kind = 'numeric' THEN n ELSE 0 END) AS bigint) AS n_numeric,
    cast(sum(CASE WHEN kind = 'categorical' THEN n ELSE 0 END) AS bigint) AS n_categorical, count(DISTINCT value) AS n_values, sum(CASE WHEN kind = 'numeric' THEN NUMBER(value) * n ELSE 0 END) AS dosages,
    cast(sum(CASE WHEN kind = 'numeric' AND value = '1' THEN n ELSE 0 END) AS bigint) AS ones, cast(sum(CASE WHEN kind = 'categorical' AND length(token) > 1 AND substr(token, 1, 1) <> substr(token, 2, 1) THEN n ELSE 0 END) AS bigint) AS hets
    FROM marker_tokens GROUP BY marker_pos) AS s) AS t
    LEFT JOIN (SELECT marker_pos, count(*) AS n_alleles, cast(sum(n) AS bigint) AS n, min(n) AS fewest FROM allele_counts GROUP BY marker_pos) AS a ON t.marker_pos = a.marker_pos""",
    marker_tokens=MARKER_TOKENS, allele_counts=ALLELE_COUNTS)
#: At most 400 genotypes in hash order, each with its next 75 on the ring; similarity over markers called in both.
RING = Operator.of(
    f"""SELECT genotype_id, place, least(n, 400) AS n FROM (SELECT genotype_id, row_number() OVER (ORDER BY SHA('{SEED}|' || genotype_id), genotype_id) - 1 AS place, count(*) OVER () AS n
    FROM (SELECT DISTINCT genotype_id FROM dosage_long) AS g) AS r WHERE place < 400""", dosage_long=DOSAGE)  # fmt: skip
_SIMILARITIES = """SELECT a.genotype_id AS a, b.genotype_id AS b, round(avg(1 - abs(x.dosage - y.dosage) / cast(2 AS double)), 9) AS y FROM (SELECT genotype_id, (place + k) % n AS other FROM (SELECT genotype_id, place, n, SERIES(1, 75) AS k FROM ring) AS r WHERE k <= (n - 1) / 2) AS a
    JOIN ring AS b ON a.other = b.place JOIN dosage_long AS x ON a.genotype_id = x.genotype_id JOIN dosage_long AS y ON b.genotype_id = y.genotype_id AND x.marker_pos = y.marker_pos
    WHERE x.dosage IS NOT NULL AND y.dosage IS NOT NULL GROUP BY a.genotype_id, b.genotype_id"""
SIMILARITIES = Written(_SIMILARITIES, (("ring", RING), ("dosage_long", DOSAGE)), _SIMILARITIES)
SIMILARITY_SUMMARY = summary((), "similarities", SIMILARITIES)
VANRADEN = Operator.of("SELECT count(*) AS n_markers, round(sum(2 * frequency * (1 - frequency)), 8) AS denominator FROM marker_qc_b", marker_qc_b=MARKER_QC_B)
TARGET_SUMS = Operator.of("SELECT c.genotype_id, sum(c.s - c.n * g.mu) AS a FROM cells AS c CROSS JOIN (SELECT sum(s) / sum(n) AS mu FROM cells) AS g WHERE c.n > 0 GROUP BY c.genotype_id", cells=CELLS)
#: Genomic kernel times the centred target: to markers and back, the kernel itself is never formed.
GENOMIC_OP = Operator.of(
    """SELECT x.genotype_id, round(sum(x.x * t.t) / max(v.denominator), 5) AS g FROM centered AS x
    JOIN (SELECT c.marker_pos, sum(c.x * s.a) AS t FROM centered AS c JOIN target_sums AS s ON c.genotype_id = s.genotype_id GROUP BY c.marker_pos) AS t ON x.marker_pos = t.marker_pos
    CROSS JOIN vanraden AS v GROUP BY x.genotype_id""", centered=CENTERED, target_sums=TARGET_SUMS, vanraden=VANRADEN)  # fmt: skip
KERNEL_ALIGNMENT = Operator.of(
    """SELECT round(sum(g.g * s.a) / max(e.energy), 6) AS alignment FROM genomic_op AS g JOIN target_sums AS s ON g.genotype_id = s.genotype_id
    CROSS JOIN (SELECT sum(power(p.trait_1 - m.mu, 2)) AS energy FROM phenotypes AS p CROSS JOIN (SELECT avg(trait_1) AS mu FROM phenotypes) AS m) AS e""",
    genomic_op=GENOMIC_OP, target_sums=TARGET_SUMS, phenotypes=PHENOTYPES)
#: Prediction from effect tables: marker effects, environment effects and their interaction by feature.
PORTABLE_PREDICT = Operator.of(
    """SELECT c.genotype_id, c.environment_id, round(max(g.main) + sum(z.z * (0.1 + g.inter / 10)), 4) AS prediction FROM cells AS c
    JOIN standardized AS z ON c.environment_id = z.environment_id JOIN (SELECT genotype_id, feature, sum(x * (marker_pos % 7 - 3) / cast(10 AS double)) AS main, sum(x * ((marker_pos + length(feature)) % 5 - 2) / cast(10 AS double)) AS inter
    FROM centered CROSS JOIN (SELECT DISTINCT feature FROM standardized) AS f GROUP BY genotype_id, feature) AS g ON c.genotype_id = g.genotype_id AND z.feature = g.feature
    GROUP BY c.genotype_id, c.environment_id""", cells=CELLS, standardized=STANDARDIZED, centered=CENTERED)  # fmt: skip
#: Canonical ids with more than one source; empty when the map is one to one.
MAP_CHECK = Operator.of("SELECT canonical_id, count(DISTINCT source_id) AS n FROM id_map GROUP BY canonical_id HAVING count(DISTINCT source_id) > 1", id_map=ID_MAP)
MARKER_PANEL_HASH = Operator.of("SELECT SHA(JOINED('M' || lpad(cast(marker_pos AS string), 6, '0'), '\n')) AS panel, count(*) AS n FROM marker_qc_b", marker_qc_b=MARKER_QC_B)

_REPORTED = (
    "CV_GE SPLIT_SUMMARY LEAKS GREEDY_GENOTYPE_FOLDS GREEDY_ENVIRONMENT_FOLDS GREEDY_CLUSTER_FOLDS CLUSTER_CHOICE OOD_GENOTYPES GENOTYPE_NOVELTY ENVIRONMENT_NOVELTY INDEPENDENT_ROLES ROLE_SUMMARY ROLE_LEAKS STRICT_REGISTRY "
    "PROTOCOL_SUMMARY CELL_PREDICTIONS OOF_PROTOCOLS METRICS_BY_FOLD METRICS_BY_ENVIRONMENT METRICS_BY_PROTOCOL ENVIRONMENT_MACRO STRICT_LEADERBOARD NESTED_SELECT EQUAL_ENSEMBLE CROSSFIT_WEIGHT CROSSFIT_BLEND "
    "GATED_BLEND INNER_SPLIT TOKEN_CODES TOKEN_COUNTS ENCODING_COUNTS ALLELE_COUNTS ALLELE_TABLE SIMILARITY_SUMMARY VANRADEN GENOMIC_OP KERNEL_ALIGNMENT PORTABLE_PREDICT MAP_CHECK MARKER_PANEL_HASH"
)
OPERATORS: dict[str, Operator] = {name.lower(): globals()[name] for name in _REPORTED.split()}
