"""Audit, weather, splits, baselines, metrics, gating and scoring as composable operators."""

from ..plans import ranks
from ..plans.dialect import Operator, Twofold, Written
from ..plans.quantiles import Quantiled
from ..plans.roles import DOSAGE, LONG_SERIES, PHENOTYPES, SERIES, TIMED, WEATHER
from ..plans.series import Scanned

SEED = 20260922

# --- audit -------------------------------------------------------------------------------

TRAITS = Operator.of(
    """SELECT row_id, genotype_id, environment_id, 'trait_1' AS trait, trait_1 AS y FROM phenotypes
    UNION ALL SELECT row_id, genotype_id, environment_id, 'trait_2' AS trait, trait_2 AS y FROM phenotypes""", phenotypes=PHENOTYPES)  # fmt: skip

_SUMMARY = """count(*) AS n_rows, count(*) - count(y) AS n_missing, min(y) AS y_min, round(PCT(y, 0.05), 6) AS y_p05, round(PCT(y, 0.5), 6) AS y_median,
    round(PCT(y, 0.95), 6) AS y_p95, max(y) AS y_max, round(avg(y), 6) AS y_mean, round(CASE WHEN count(y) = 1 THEN 0.0 ELSE stddev_samp(y) END, 6) AS y_sd"""

_MOMENTS = """count(*) AS n_rows, count(*) - count(y) AS n_missing, min(y) AS y_min, max(y) AS y_max, round(avg(y), 6) AS y_mean,
    round(CASE WHEN count(y) = 1 THEN 0.0 ELSE stddev_samp(y) END, 6) AS y_sd"""


def summary(keys: tuple[str, ...], source: str, of: Operator) -> Operator:
    """Counts, moments and exact quantiles of y in each group."""
    by = ", ".join(keys)
    group = f" GROUP BY {by}" if keys else ""
    own = "".join(f"m.{k}, " for k in keys)
    same = " AND ".join(f"m.{k} <=> q.{k}" for k in keys) or "true"
    mine = f"""SELECT {own}n_rows, n_missing, y_min, round(q.q[0], 6) AS y_p05, round(q.q[1], 6) AS y_median, round(q.q[2], 6) AS y_p95, y_max, y_mean, y_sd
    FROM (SELECT {by + ", " if keys else ""}{_MOMENTS} FROM {source}{group}) AS m LEFT JOIN quantiled AS q ON {same}"""
    return Quantiled(mine, ((source, of),), f"SELECT {by + ', ' if keys else ''}{_SUMMARY} FROM {source}{group}", keys, "y", (0.05, 0.5, 0.95))


TRAIT_SUMMARY = summary(("trait",), "traits", TRAITS)
TRAIT_BY_ENVIRONMENT = summary(("trait", "environment_id"), "traits", TRAITS)
DUPLICATE_PLOTS = Operator.of("SELECT environment_id, genotype_id, count(*) AS n FROM phenotypes GROUP BY environment_id, genotype_id HAVING count(*) > 1", phenotypes=PHENOTYPES)
COVERAGE = Operator.of(
    """SELECT n_environments, count(*) AS n_genotypes FROM (SELECT genotype_id, count(DISTINCT environment_id) AS n_environments
    FROM phenotypes GROUP BY genotype_id) AS g GROUP BY n_environments""", phenotypes=PHENOTYPES)  # fmt: skip
GENOTYPE_PRESENCE = Operator.of(
    """SELECT genotype_id, count(*) AS n_environments, JOINED(environment_id, ' ') AS environments FROM (SELECT DISTINCT genotype_id, environment_id FROM phenotypes) AS g GROUP BY genotype_id""", phenotypes=PHENOTYPES)  # fmt: skip
#: Rows of the presence matrix: genotypes by number of environments, thinned evenly to 650 at most.
PRESENCE = Operator.of(
    """SELECT place, genotype_id, n_environments, environments FROM (SELECT genotype_id, n_environments, environments, row_number() OVER (ORDER BY n_environments, genotype_id) - 1 AS place FROM genotype_presence) AS g
    JOIN (SELECT CASE WHEN i = k - 1 THEN n - 1 ELSE cast(floor(i * ((n - 1) / (k - cast(1 AS double)))) AS bigint) END AS kept
    FROM (SELECT SERIES(0, 649) AS i) AS s CROSS JOIN (SELECT count(*) AS n, least(count(*), 650) AS k FROM genotype_presence) AS c WHERE i < k) AS t ON g.place = t.kept""", genotype_presence=GENOTYPE_PRESENCE)  # fmt: skip
WEATHER_AUDIT = Operator.of(
    """SELECT environment_id, variable, count(*) AS n_rows, count(*) - count(value) AS n_missing, min(value) AS low, max(value) AS high,
    min_by(value, CASE WHEN value IS NOT NULL THEN obs_seq END) AS first_value, max_by(value, CASE WHEN value IS NOT NULL THEN obs_seq END) AS last_value FROM long_series GROUP BY environment_id, variable""", long_series=LONG_SERIES)  # fmt: skip
HISTOGRAM = Operator.of(
    """SELECT bin, count(*) AS n FROM (SELECT least(floor((y - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 20), 19) AS bin
    FROM (SELECT trait_2 AS y FROM phenotypes WHERE trait_2 IS NOT NULL) AS p
    CROSS JOIN (SELECT min(trait_2) AS lo, max(trait_2) AS hi FROM phenotypes) AS r) AS b GROUP BY bin""", phenotypes=PHENOTYPES)  # fmt: skip
LINKAGE = Operator.of(
    """SELECT CASE WHEN p.environment_id IS NULL THEN 'weather only' WHEN w.environment_id IS NULL THEN 'phenotype only' ELSE 'both' END AS linkage, count(*) AS n
    FROM (SELECT DISTINCT environment_id FROM phenotypes) AS p FULL OUTER JOIN (SELECT DISTINCT environment_id FROM series) AS w
    ON p.environment_id = w.environment_id GROUP BY 1""", phenotypes=PHENOTYPES, series=SERIES)  # fmt: skip
_NORMALIZED = "CASE WHEN MATCHES(id, '^[0-9][0-9][0-9][0-9][-_].+$') THEN REPLACED(id, '^([0-9][0-9][0-9][0-9])[-_](.+)$') ELSE translate(id, '-', '_') END"
NORMALIZED_IDS = Operator.of(
    f"""SELECT id, {_NORMALIZED} AS normalized
    FROM (SELECT DISTINCT '2024-' || environment_id AS id FROM phenotypes UNION SELECT DISTINCT environment_id || '-2023' AS id FROM phenotypes) AS d""", phenotypes=PHENOTYPES)  # fmt: skip

#: Every stored id of an environment: whether the weather has it as it is, and which weather ids share its normalised form.
ENVIRONMENT_MATCH = Operator.of(
    f"""SELECT p.id AS environment_id, p.normalized, CASE WHEN w.id IS NOT NULL THEN 'direct' WHEN m.ids IS NOT NULL THEN 'normalized' ELSE 'none' END AS linkage, m.ids AS weather_ids
    FROM (SELECT id, {_NORMALIZED} AS normalized FROM (SELECT DISTINCT environment_id || CASE WHEN environment_id = 'E1' THEN '-2023' ELSE '-2024' END AS id FROM phenotypes UNION SELECT '2024-E2' AS id) AS d) AS p
    LEFT JOIN (SELECT DISTINCT source_id AS id FROM weather) AS w ON p.id = w.id
    LEFT JOIN (SELECT normalized, JOINED(id, ' ') AS ids FROM (SELECT id, {_NORMALIZED} AS normalized FROM (SELECT DISTINCT source_id AS id FROM weather) AS s) AS k GROUP BY normalized) AS m ON p.normalized = m.normalized""",
    phenotypes=PHENOTYPES, weather=WEATHER)
DATED = Scanned(
    "SELECT 'E' || cast(env AS string) AS environment_id, place AS obs_seq, cast(cast(ts AS date) AS string) AS day, value, props FROM scanned", (("timed", TIMED),),
    "SELECT 'E' || cast(env AS string) AS environment_id, row_number() OVER (PARTITION BY env ORDER BY ts, event_id) - 1 AS obs_seq, cast(cast(ts AS date) AS string) AS day, value, props FROM timed",
    ("env",), ("ts", "event_id"))
#: First and last day in file order, days, and rows that repeat an earlier one in full.
WEATHER_DATES = Operator.of(
    """SELECT environment_id, cast(sum(n) AS bigint) AS n_rows, min_by(day, first_at) AS first_day, max_by(day, last_at) AS last_day, count(DISTINCT day) AS n_days, cast(sum(n) - count(*) AS bigint) AS n_repeated
    FROM (SELECT environment_id, day, value, props, count(*) AS n, min(obs_seq) AS first_at, max(obs_seq) AS last_at FROM dated GROUP BY environment_id, day, value, props) AS d GROUP BY environment_id""", dated=DATED)  # fmt: skip

# --- markers -----------------------------------------------------------------------------

MARKER_STATS = Operator.of(
    """SELECT marker_pos, n, n_called, round(1 - cast(n_called AS double) / n, 9) AS missing_rate, round(p, 9) AS frequency, round(least(p, 1 - p), 9) AS maf,
    round(heterozygosity, 9) AS heterozygosity, n_codes, n_codes > 1 AS polymorphic
    FROM (SELECT marker_pos, count(*) AS n, count(dosage) AS n_called, cast(sum(dosage) AS double) / (2 * nullif(count(dosage), 0)) AS p,
    cast(count(CASE WHEN dosage = 1 THEN 1 END) AS double) / nullif(count(dosage), 0) AS heterozygosity, count(DISTINCT dosage) AS n_codes
    FROM dosage_long GROUP BY marker_pos) AS m""", dosage_long=DOSAGE)  # fmt: skip
SAMPLE_MISSING = Operator.of("SELECT genotype_id, round(1 - cast(count(dosage) AS double) / count(*), 9) AS missing_rate FROM dosage_long GROUP BY genotype_id", dosage_long=DOSAGE)
WORST_SAMPLES = Operator.of("SELECT genotype_id, missing_rate FROM sample_missing ORDER BY missing_rate DESC, genotype_id LIMIT 20", sample_missing=SAMPLE_MISSING)
WORST_MARKERS = Operator.of("SELECT marker_pos, missing_rate FROM marker_stats ORDER BY missing_rate DESC, marker_pos LIMIT 20", marker_stats=MARKER_STATS)
MARKER_QC = Operator.of("SELECT marker_pos, maf, missing_rate FROM marker_stats WHERE polymorphic AND maf >= 0.47 AND missing_rate <= 0.06", marker_stats=MARKER_STATS)
MARKER_QC_B = Operator.of("SELECT marker_pos, frequency FROM marker_stats WHERE n_called > 0 AND maf >= 0.47 AND missing_rate <= 0.08 AND frequency > 0 AND frequency < 1", marker_stats=MARKER_STATS)
MARKER_THINNED = Operator.of(
    """SELECT kept.marker_pos FROM (SELECT marker_pos, row_number() OVER (ORDER BY marker_pos) - 1 AS place, count(*) OVER () AS n FROM marker_qc) AS kept
    JOIN (SELECT SERIES(0, 7) AS i) AS grid ON kept.place = CASE WHEN i = 7 THEN n - 1 ELSE cast(floor(i * ((n - 1) / 7.0)) AS bigint) END WHERE n > 7""", marker_qc=MARKER_QC)  # fmt: skip
DUPLICATE_SAMPLES = Operator.of(
    """SELECT digest, count(*) AS n FROM (SELECT genotype_id, SHA(JOINED(lpad(cast(marker_pos AS string), 4, '0') || ':' || coalesce(cast(dosage AS string), '.'), '|')) AS digest
    FROM dosage_long GROUP BY genotype_id) AS d GROUP BY digest""", dosage_long=DOSAGE)  # fmt: skip
#: Markers with the same codes in all genotypes share a digest.
DUPLICATE_MARKERS = Operator.of(
    """SELECT digest, count(*) AS n, min(marker_pos) AS first_marker, count(*) > 1 AS duplicated FROM (SELECT marker_pos, SHA(JOINED(genotype_id || ':' || coalesce(cast(dosage AS string), '.'), '|')) AS digest
    FROM dosage_long GROUP BY marker_pos) AS d GROUP BY digest""", dosage_long=DOSAGE)  # fmt: skip
PANEL_COUNTS = Operator.of(
    """SELECT count(*) AS n_markers, count(CASE WHEN NOT polymorphic AND n_called > 0 THEN 1 END) AS n_monomorphic, count(CASE WHEN n_called = 0 THEN 1 END) AS n_all_missing,
    count(CASE WHEN n_called < n THEN 1 END) AS n_with_missing, round(avg(maf), 8) AS mean_maf, round(avg(missing_rate), 8) AS mean_missing FROM marker_stats""", marker_stats=MARKER_STATS)  # fmt: skip
CENTERED = Operator.of(
    """SELECT d.genotype_id, d.marker_pos, round(coalesce(d.dosage - 2 * q.frequency, 0.0), 8) AS x FROM dosage_long AS d
    JOIN marker_qc_b AS q ON d.marker_pos = q.marker_pos""", dosage_long=DOSAGE, marker_qc_b=MARKER_QC_B)  # fmt: skip
GENOTYPE_FINGERPRINT = Operator.of("SELECT SHA(JOINED(genotype_id, '\n')) AS fingerprint, count(*) AS n FROM (SELECT DISTINCT genotype_id FROM dosage_long) AS g", dosage_long=DOSAGE)

# --- weather features --------------------------------------------------------------------

WEATHER_BASIC = Operator.of(
    """SELECT environment_id, variable, count(*) AS n_days, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high,
    min_by(value, CASE WHEN value IS NOT NULL THEN obs_seq END) AS first_seen, max_by(value, CASE WHEN value IS NOT NULL THEN obs_seq END) AS last_seen,
    round(1 - cast(count(value) AS double) / count(*), 9) AS missing FROM long_series GROUP BY environment_id, variable""", long_series=LONG_SERIES)  # fmt: skip
SEEN_SERIES = Operator.of("SELECT environment_id, variable, obs_seq, value FROM long_series WHERE value IS NOT NULL", long_series=LONG_SERIES)
#: Steps are taken over gaps; thirds are of what was observed, longer ones first.
STEPS = Scanned(
    """SELECT environment_id, variable, cast(obs_seq AS double) AS obs_seq, value, value - previous AS step,
    CASE WHEN place < n_group % 3 * (n_group div 3 + 1) THEN place div (n_group div 3 + 1) ELSE (place - n_group % 3) div greatest(n_group div 3, 1) END + 1 AS third FROM scanned""",
    (("seen_series", SEEN_SERIES),),
    """SELECT environment_id, variable, cast(obs_seq AS double) AS obs_seq, value, value - lag(value) OVER (PARTITION BY environment_id, variable ORDER BY obs_seq) AS step,
    ntile(3) OVER (PARTITION BY environment_id, variable ORDER BY obs_seq) AS third FROM seen_series""", ("environment_id", "variable"), ("obs_seq",), "value")  # fmt: skip
_DYNAMICS = """round(CASE WHEN count(value) > 1 THEN regr_slope(value, obs_seq) ELSE 0.0 END, 9) AS trend,
    round(coalesce(avg(step), 0.0), 6) AS step_mean, round(coalesce(stddev_pop(step), 0.0), 6) AS step_sd,
    round(coalesce(avg(CASE WHEN third = 1 THEN value END), avg(value)), 6) AS early, round(coalesce(avg(CASE WHEN third = 2 THEN value END), avg(value)), 6) AS middle,
    round(coalesce(avg(CASE WHEN third = 3 THEN value END), avg(value)), 6) AS late FROM steps GROUP BY environment_id, variable"""
WEATHER_DYNAMIC = Quantiled(
    f"""SELECT m.environment_id, m.variable, round(q.q[0], 6) AS q10, round(q.q[1], 6) AS q25, round(q.q[2], 6) AS q50, round(q.q[3], 6) AS q75, round(q.q[4], 6) AS q90, trend, step_mean, step_sd, early, middle, late
    FROM (SELECT environment_id, variable, {_DYNAMICS}) AS m JOIN quantiled AS q ON m.environment_id <=> q.environment_id AND m.variable <=> q.variable""",
    (("steps", STEPS),),
    f"""SELECT environment_id, variable, round(PCT(value, 0.1), 6) AS q10, round(PCT(value, 0.25), 6) AS q25, round(PCT(value, 0.5), 6) AS q50,
    round(PCT(value, 0.75), 6) AS q75, round(PCT(value, 0.9), 6) AS q90, {_DYNAMICS}""", ("environment_id", "variable"), "value", (0.1, 0.25, 0.5, 0.75, 0.9), True)  # fmt: skip
FEATURES = Operator.of(
    """SELECT environment_id, variable || '_mean' AS feature, mean AS value FROM weather_basic UNION ALL SELECT environment_id, variable || '_sd', sd FROM weather_basic
    UNION ALL SELECT environment_id, variable || '_missing', missing FROM weather_basic""", weather_basic=WEATHER_BASIC)  # fmt: skip
FEATURE_SCALE = Operator.of(
    """SELECT feature, PCT(value, 0.5) AS fill, avg(coalesce(value, mid)) AS center, CASE WHEN stddev_pop(coalesce(value, mid)) < 1e-6 THEN 1.0 ELSE stddev_pop(coalesce(value, mid)) END AS scale
    FROM (SELECT f.feature, f.value, m.mid FROM features AS f JOIN (SELECT feature, PCT(value, 0.5) AS mid FROM features GROUP BY feature) AS m ON f.feature = m.feature) AS x
    GROUP BY feature""", features=FEATURES)  # fmt: skip
STANDARDIZED = Operator.of(
    """SELECT f.environment_id, f.feature, (coalesce(f.value, s.fill) - s.center) / s.scale AS z FROM features AS f
    JOIN feature_scale AS s ON f.feature = s.feature WHERE s.fill IS NOT NULL""", features=FEATURES, feature_scale=FEATURE_SCALE)  # fmt: skip
FEATURE_REPORT = Operator.of("SELECT environment_id, feature, round(z, 5) AS z FROM standardized", standardized=STANDARDIZED)
#: Environments are few by nature (tens), so their pairs are formed by a join on the feature.
DISTANCES = Operator.of(
    """SELECT a.environment_id AS env_a, b.environment_id AS env_b, sum((a.z - b.z) * (a.z - b.z)) AS d2 FROM standardized AS a
    JOIN standardized AS b ON a.feature = b.feature GROUP BY a.environment_id, b.environment_id""", standardized=STANDARDIZED)  # fmt: skip
RBF_KERNEL = Operator.of(
    """SELECT env_a, env_b, round(exp(-d2 / greatest(2 * bw2, 1e-12)), 6) AS k FROM distances
    CROSS JOIN (SELECT coalesce(PCT(CASE WHEN d2 > 1e-12 THEN d2 END, 0.5), 1.0) AS bw2 FROM distances) AS b""", distances=DISTANCES)  # fmt: skip
NEAREST_ENVIRONMENT = Operator.of(
    """SELECT env_a AS environment_id, round(sqrt(min(d2)), 6) AS distance FROM distances WHERE d2 > 1e-12 GROUP BY env_a""", distances=DISTANCES)  # fmt: skip
GATE = Operator.of(
    """SELECT n.environment_id, n.distance, round(CASE WHEN cast(substr(n.environment_id, 2) AS integer) % 3 <> 0 THEN 0.0
    ELSE greatest(0.0, least(1.0, 4 * (n.distance - t.threshold) / t.threshold)) END, 6) AS weight FROM nearest_environment AS n
    CROSS JOIN (SELECT greatest(PCT(distance, 0.9), 1e-6) AS threshold FROM nearest_environment WHERE cast(substr(environment_id, 2) AS integer) % 3 <> 0) AS t""",
    nearest_environment=NEAREST_ENVIRONMENT)
OOD_ENVIRONMENTS = Operator.of(
    """SELECT environment_id, pct FROM (SELECT environment_id, row_number() OVER (ORDER BY norm DESC, environment_id) AS place, count(*) OVER () AS n
    FROM (SELECT environment_id, round(sqrt(sum(z * z)), 6) AS norm FROM standardized GROUP BY environment_id) AS e) AS r
    JOIN (SELECT 5 * k AS pct FROM (SELECT SERIES(2, 4) AS k) AS s) AS tails ON place <= ceil(n * pct / 100.0)""", standardized=STANDARDIZED)  # fmt: skip

# --- splits ------------------------------------------------------------------------------

CV0 = Operator.of(f"SELECT row_id, genotype_id, environment_id, cast(BUCKET('{SEED}|row|' || cast(row_id AS string), 5) AS string) AS fold FROM phenotypes", phenotypes=PHENOTYPES)
CV_G = Operator.of(f"SELECT row_id, genotype_id, environment_id, trait_1, cast(BUCKET('{SEED}|genotype|' || genotype_id, 5) AS string) AS fold FROM phenotypes", phenotypes=PHENOTYPES)
CV_E = Operator.of("SELECT row_id, genotype_id, environment_id, environment_id AS fold FROM phenotypes", phenotypes=PHENOTYPES)
ELIGIBLE_FOLDS = Operator.of("SELECT fold, count(*) AS n, count(trait_1) AS n_observed FROM cv_g GROUP BY fold HAVING count(*) >= 100 AND count(trait_1) >= 100", cv_g=CV_G)

#: How far the validation rows of a fold are from its training rows (totals less the fold's own).
SHIFT_REPORT = Operator.of(
    """SELECT f.fold, f.n AS n_validation, a.n - f.n AS n_train, round(1 - cast(f.seen AS double) / f.n, 8) AS missing_validation, round(1 - cast(a.seen - f.seen AS double) / nullif(a.n - f.n, 0), 8) AS missing_train,
    round(f.s / nullif(f.seen, 0) - (a.s - f.s) / nullif(a.seen - f.seen, 0), 6) AS mean_shift, e.n_environments, round(e.shift, 6) AS environment_shift
    FROM (SELECT fold, count(*) AS n, count(trait_1) AS seen, sum(trait_1) AS s FROM cv_g GROUP BY fold) AS f CROSS JOIN (SELECT count(*) AS n, count(trait_1) AS seen, sum(trait_1) AS s FROM cv_g) AS a
    JOIN (SELECT x.fold, count(*) AS n_environments, avg(abs(x.s / nullif(x.seen, 0) - (t.s - x.s) / nullif(t.seen - x.seen, 0))) AS shift
    FROM (SELECT fold, environment_id, count(trait_1) AS seen, sum(trait_1) AS s FROM cv_g GROUP BY fold, environment_id) AS x
    JOIN (SELECT environment_id, count(trait_1) AS seen, sum(trait_1) AS s FROM cv_g GROUP BY environment_id) AS t ON x.environment_id = t.environment_id GROUP BY x.fold) AS e ON f.fold = e.fold""", cv_g=CV_G)  # fmt: skip

# --- baselines and metrics ---------------------------------------------------------------

#: Out-of-fold means: those of a fold are totals less the fold's own, so no fold is scanned again for another.
OOF = Operator.of(
    """SELECT p.fold, p.row_id, p.environment_id, p.trait_1 AS y, round((a.s - f.s) / (a.n - f.n), 8) AS global_mean,
    round(coalesce((e.s - coalesce(ef.s, 0)) / nullif(e.n - coalesce(ef.n, 0), 0), (a.s - f.s) / (a.n - f.n)), 8) AS environment_mean
    FROM (SELECT * FROM cv_g WHERE trait_1 IS NOT NULL) AS p
    CROSS JOIN (SELECT sum(trait_1) AS s, count(trait_1) AS n FROM cv_g) AS a
    JOIN (SELECT fold, sum(trait_1) AS s, count(trait_1) AS n FROM cv_g GROUP BY fold) AS f ON p.fold = f.fold
    JOIN (SELECT environment_id, sum(trait_1) AS s, count(trait_1) AS n FROM cv_g GROUP BY environment_id) AS e ON p.environment_id = e.environment_id
    LEFT JOIN (SELECT environment_id, fold, sum(trait_1) AS s, count(trait_1) AS n FROM cv_g GROUP BY environment_id, fold) AS ef ON p.environment_id = ef.environment_id AND p.fold = ef.fold""",
    cv_g=CV_G)
_OOF_LONG = "SELECT fold, row_id, environment_id, 'global_mean' AS model, y, global_mean AS yhat FROM oof UNION ALL SELECT fold, row_id, environment_id, 'environment_mean' AS model, y, environment_mean AS yhat FROM oof"
OOF_LONG = Written(_OOF_LONG, (("oof", OOF),), _OOF_LONG)
#: Average ranks for ties: rank plus half of the other ties.
RANKED = Twofold(ranks.ranked("model, fold", "environment_id", "oof_long"), (("oof_long", OOF_LONG),),
    """SELECT model, fold, environment_id, y, yhat, rank() OVER (PARTITION BY model, fold ORDER BY y) + (count(*) OVER (PARTITION BY model, fold, y) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY model, fold ORDER BY yhat) + (count(*) OVER (PARTITION BY model, fold, yhat) - 1) / 2.0 AS rp FROM oof_long""")  # fmt: skip


def _corr(a: str, b: str) -> str:
    """Correlation, 0 where either side is constant or alone."""
    return f"CASE WHEN count(*) >= 2 AND stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) ELSE 0.0 END"


FOLD_METRICS = Operator.of(
    f"""SELECT model, fold, count(*) AS n, {_corr("y", "yhat")} AS pearson, {_corr("ry", "rp")} AS spearman, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae
    FROM ranked GROUP BY model, fold""", ranked=RANKED)  # fmt: skip
FOLD_REPORT = Operator.of("SELECT model, fold, n, round(pearson, 5) AS pearson, round(spearman, 5) AS spearman, round((pearson + spearman) / 2, 5) AS score, round(mse, 4) AS mse, round(sqrt(mse), 5) AS rmse, round(mae, 5) AS mae FROM fold_metrics", fold_metrics=FOLD_METRICS)
LEADERBOARD = Operator.of(
    """SELECT model, count(*) AS n_folds, round(avg((pearson + spearman) / 2), 5) AS score, round(min((pearson + spearman) / 2), 5) AS worst, round(max((pearson + spearman) / 2), 5) AS best,
    round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp((pearson + spearman) / 2) END, 5) AS fold_sd, round(avg(sqrt(mse)), 5) AS rmse FROM fold_metrics GROUP BY model""", fold_metrics=FOLD_METRICS)  # fmt: skip
BLEND_SEARCH = Operator.of(
    """SELECT w, round(avg((y - (1 - w) * global_mean - w * environment_mean) * (y - (1 - w) * global_mean - w * environment_mean)), 4) AS mse
    FROM oof CROSS JOIN (SELECT cast(k AS double) / 20 AS w FROM (SELECT SERIES(0, 20) AS k) AS s) AS grid GROUP BY w""", oof=OOF)  # fmt: skip
ENVIRONMENT_SCALE = Operator.of(
    """SELECT e.environment_id, round(e.m, 6) AS center, round(greatest(coalesce(e.sd, 0.0), 0.05 * g.sd, 1e-6), 6) AS scale
    FROM (SELECT environment_id, avg(trait_1) AS m, stddev_samp(trait_1) AS sd FROM phenotypes GROUP BY environment_id) AS e
    CROSS JOIN (SELECT stddev_samp(trait_1) AS sd FROM phenotypes) AS g""", phenotypes=PHENOTYPES)  # fmt: skip

# --- scoring requests from a marker effect table -----------------------------------------

EFFECTS = Operator.of("SELECT marker_pos, frequency, cast(marker_pos % 7 - 3 AS double) / 10 AS effect FROM marker_qc_b", marker_qc_b=MARKER_QC_B)
SCORED = Operator.of(
    """SELECT genotype_id, round(sum(coalesce(d.dosage - 2 * e.frequency, cast(0 AS double)) * e.effect), 4) AS prediction, round(1 - cast(count(d.dosage) AS double) / count(*), 6) AS missing_fraction
    FROM dosage_long AS d JOIN effects AS e ON d.marker_pos = e.marker_pos GROUP BY genotype_id""", dosage_long=DOSAGE, effects=EFFECTS)  # fmt: skip
ABSENT_REQUESTS = Operator.of(
    """SELECT DISTINCT p.genotype_id FROM phenotypes AS p LEFT ANTI JOIN (SELECT genotype_id FROM dosage_long WHERE marker_pos = 0 AND dosage IS NOT NULL) AS d
    ON p.genotype_id = d.genotype_id ORDER BY p.genotype_id LIMIT 10""".replace("LEFT ANTI", "ANTI"), phenotypes=PHENOTYPES, dosage_long=DOSAGE)  # fmt: skip

_REPORTED = (
    "TRAIT_SUMMARY TRAIT_BY_ENVIRONMENT DUPLICATE_PLOTS COVERAGE WEATHER_AUDIT HISTOGRAM LINKAGE ENVIRONMENT_MATCH WEATHER_DATES NORMALIZED_IDS SERIES MARKER_STATS SAMPLE_MISSING WORST_SAMPLES WORST_MARKERS MARKER_QC MARKER_QC_B "
    "MARKER_THINNED DUPLICATE_SAMPLES DUPLICATE_MARKERS PANEL_COUNTS PRESENCE SHIFT_REPORT CENTERED GENOTYPE_FINGERPRINT WEATHER_BASIC WEATHER_DYNAMIC FEATURE_REPORT RBF_KERNEL NEAREST_ENVIRONMENT GATE OOD_ENVIRONMENTS CV0 CV_G CV_E "
    "ELIGIBLE_FOLDS OOF FOLD_REPORT LEADERBOARD BLEND_SEARCH ENVIRONMENT_SCALE SCORED ABSENT_REQUESTS"
)
OPERATORS: dict[str, Operator] = {name.lower(): globals()[name] for name in _REPORTED.split()}
