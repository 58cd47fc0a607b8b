"""The stored tables in the roles of a genotype x environment study."""

from .dialect import Operator
from .series import Scanned

#: Plots: one row per observation. The row key is made from the stored key, so no global order is needed.
PHENOTYPES = Operator.of(
    """SELECT l_orderkey * 100 + l_linenumber AS row_id, 'G' || cast(l_partkey % 500 AS string) AS genotype_id,
    'E' || cast(l_suppkey % 15 AS string) AS environment_id,
    CASE WHEN (l_partkey + l_suppkey) % 97 = 0 THEN NULL ELSE l_quantity END AS trait_1, l_extendedprice AS trait_2
    FROM lineitem""", lineitem="lineitem")  # fmt: skip

TIMED = Operator.of("SELECT user_id % 15 AS env, ts, event_id, value, props FROM events", events="events")
_SEEN = """CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS variable_1, CASE WHEN env = 3 THEN NULL ELSE NUMBER(FIELD(props, k)) END AS variable_2"""
#: One row per observation, environment, variable in series order; E3 lacks its second variable.
WEATHER = Scanned(
    f"SELECT '2024-E' || cast(env AS string) AS source_id, place AS obs_seq, {_SEEN} FROM scanned", (("timed", TIMED),),
    f"SELECT '2024-E' || cast(env AS string) AS source_id, row_number() OVER (PARTITION BY env ORDER BY ts, event_id) - 1 AS obs_seq, {_SEEN} FROM timed", ("env",), ("ts", "event_id"))

ID_MAP = Operator.of("SELECT source_id, 'E' || substr(source_id, 7) AS canonical_id FROM (SELECT DISTINCT '2024-E' || cast(user_id % 15 AS string) AS source_id FROM events) AS d", events="events")

#: Canonical environment ids by a left join; an id without an entry stays itself.
SERIES = Operator.of(
    """SELECT coalesce(id_map.canonical_id, weather.source_id) AS environment_id, obs_seq, variable_1, variable_2
    FROM weather LEFT JOIN id_map ON weather.source_id = id_map.source_id""", weather=WEATHER, id_map=ID_MAP)  # fmt: skip

LONG_SERIES = Operator.of(
    """SELECT environment_id, obs_seq, 'variable_1' AS variable, variable_1 AS value FROM series
    UNION ALL SELECT environment_id, obs_seq, 'variable_2' AS variable, variable_2 AS value FROM series""", series=SERIES)  # fmt: skip


class _Markers(Operator):
    """Marker by genotype in long form; the two engines unnest arrays with their positions in different ways."""

    def built(self, spark, sf_dir, made):
        held = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        return spark.sql(self.text.replace("UNNESTED", "SELECT vec_id, pos AS marker_pos, cast(x AS double) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) AS pos, x"), embeddings=held)


_DOSAGE = """SELECT 'G' || cast(vec_id AS string) AS genotype_id, cast(marker_pos AS integer) AS marker_pos, x,
    CASE WHEN abs(x) < 0.01 THEN NULL WHEN x < -0.05 THEN 0 WHEN x < 0.05 THEN 1 ELSE 2 END AS dosage FROM (UNNESTED) AS u"""


class _Dosage(_Markers):
    def __init__(self):
        super().__init__(_DOSAGE)

    def sql_text(self):
        return _DOSAGE.replace("UNNESTED", "SELECT vec_id, i - 1 AS marker_pos, cast(embedding[i] AS double) AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) AS e")


DOSAGE = _Dosage()
