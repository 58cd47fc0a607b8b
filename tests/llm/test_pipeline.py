"""The pipeline against a brute-force version of its exact stages, and on odd rows."""

import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import SCHEMA, brute_classes, corpus  # noqa: E402

from genoscape.llm import languages, substrings  # noqa: E402


def brute_near(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)


def test_near_copies_with_one_id_or_none(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:i], "edit", *words[i:]]) for i in (3, 30)]
    rows = [(5, near[0]), (5, near[1]), (None, near[1]), (None, " ".join(words)), (None, "other words"), (None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert Counter((r.doc_id, None if r.text in near else r.text) for r in got) == Counter({(5, None): 1, (None, "other words"): 1, (None, None): 1, (7, ""): 1})


def test_stages_on_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, empty, "")
        assert made.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    known, near, dedup, mixed, coded = (f for _, f in corpus_pipeline.STAGES)

    def step(stage, frame, name):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    one = step(known, docs, "1")
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} <= {r[0] for r in corpus() if languages.has_letter((r[1] or "").encode())}

    two = step(near, one, "2")
    rows = [tuple(r) for r in one.collect()]
    groups = {c for _, size, c in brute_classes(rows, 5, 80) if size}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} >= groups - {None}
    assert two.count() == len({(r.doc_id, r.text) for r in two.collect()})
    left = [tuple(r) for r in two.collect()]
    assert not [1 for a, b in combinations(left, 2) if brute_near(a[1], b[1])]

    three = step(dedup, two, "3")
    words = [(r.doc_id, (r.text or "").encode().split()) for r in two.collect()]
    count = Counter(tuple(w[p : p + 35]) for _, w in words for p in range(len(w) - 34))
    sizes = Counter((i, sum(not g for g in substrings.covered_words(len(w), [p for p in range(len(w) - 34) if count[tuple(w[p : p + 35])] > 1], 35))) for i, w in words)
    assert Counter((r.doc_id, len((r.text or "").encode().split())) for r in three.collect()) == sizes

    four = step(mixed, three, "4")
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    five = step(coded, four, "5")
    assert five.count() == four.count() and five.where("NOT round_trip").count() == 0
