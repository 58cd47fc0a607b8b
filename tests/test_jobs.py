"""The jobs: equal to their SQL, rerun, killed and gone on, and fed with growing input."""

import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from genoscape.operators import training
from genoscape.plans.roles import PHENOTYPES
from jobs import benchmark, text_manifest

SF = "/root/testdata/sf0.001"
SMALL = {"crop": "c", "traits": {"trait_1": 1, "trait_2": 1000}, "protocols": ["cv_g", "cv_e"], "models": ["global_mean", "genotype_mean"], "at_once": 1}
TEXTS = {"table": "documents", "id": "doc_id", "text": "text", "group": "source", "files_at_once": 1}


def other(sql: str, folder: str, tables: list[str], columns: list[str]) -> list[tuple]:
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet*/**', union_by_name = true)" if t == "documents" and folder != SF else f"create view {t} as select * from '{folder}/{t}.parquet'")
    return sorted((tuple(r) for r in db.execute(f"SELECT {', '.join(columns)} FROM ({sql}) AS q").fetchall()), key=repr)


def rows(frame, columns: list[str] | None = None) -> list[tuple]:
    return sorted(map(tuple, frame.select(*(columns or frame.columns)).collect()), key=repr)


@pytest.mark.parametrize("job,tables", [(benchmark, ["lineitem", "events", "embeddings"]), (text_manifest, ["documents"])])
def test_query_equals_its_sql(spark, job, tables):
    before = rows(spark.sql("SET"))
    mine = job.query(spark, SF)
    assert rows(mine) == other(job.sql(), SF, tables, mine.columns)
    assert rows(spark.sql("SET")) == before


@pytest.fixture
def calls(monkeypatch):
    made, real = [], benchmark.fitted

    def fitted(spark, tables, design, observed, fits):
        made.append(sorted(r[0] for r in design.select("protocol").distinct().collect()))
        if made[-1] == fitted.fails_on:
            raise RuntimeError("killed")
        return real(spark, tables, design, observed, fits)

    fitted.fails_on = None
    monkeypatch.setattr(benchmark, "fitted", fitted)
    return made, fitted


METRICS = ["trait", "protocol", "model", *benchmark.METRICS]


def test_a_killed_benchmark_goes_on(spark, tmp_path, calls):
    made, fitted = calls
    out = str(tmp_path / "out")
    fitted.fails_on = ["cv_g"]
    with pytest.raises(RuntimeError):
        benchmark.run(spark, SF, out, SMALL)
    assert made == [["cv_e"], ["cv_g"]] and {r.protocol for r in benchmark.ledger(spark, out).collect()} == {"cv_e"}
    fitted.fails_on = None
    made.clear()
    done = rows(benchmark.run(spark, SF, out, SMALL), METRICS)
    assert made == [["cv_g"], ["cv_e"], ["cv_g"]]  # what was committed is not fitted again
    made.clear()
    assert rows(benchmark.run(spark, SF, out, SMALL), METRICS) == done and not made
    more = SMALL | {"models": [*SMALL["models"], "additive_mean"], "at_once": 2}
    grown = rows(benchmark.run(spark, SF, out, more), METRICS)
    assert made == [["cv_e", "cv_g"]] * 2 and [r for r in grown if r[2] != "additive_mean"] == done
    board = spark.read.parquet(f"{out}/leaderboard").collect()
    assert len(board) == 6 and all(r.status == "partial" and set(r.scores) == {"cv_e", "cv_g"} and r.crop == "c" for r in board)
    assert {(r.trait, r.model): r.n_folds for r in board} == {(t, m): sum(x[:1] == (t,) and x[2] == m for x in grown) for t in SMALL["traits"] for m in more["models"]}


def test_a_benchmark_of_grown_tables_is_a_new_one(spark, tmp_path, calls):
    made, _ = calls
    small = tmp_path / "tables"
    small.mkdir()
    for t in ("events", "embeddings"):
        shutil.copy(f"{SF}/{t}.parquet", small)
    whole = pq.read_table(f"{SF}/lineitem.parquet")
    pq.write_table(whole.slice(0, 4000), small / "lineitem.parquet")
    config = SMALL | {"traits": {"trait_1": 1}, "at_once": 2}
    before = rows(benchmark.run(spark, str(small), str(tmp_path / "out"), config), METRICS)
    pq.write_table(whole, small / "lineitem.parquet")
    after = rows(benchmark.run(spark, str(small), str(tmp_path / "out"), config), METRICS)
    assert made == [["cv_e", "cv_g"]] * 2 and before != after
    assert after == rows(benchmark.run(spark, SF, str(tmp_path / "fresh"), config), METRICS)


def test_a_benchmark_writes_cells_and_not_observations(spark, tmp_path):
    """Sixteen times the observations of the same cells leave no more on the disk."""
    whole, left = pq.read_table(f"{SF}/lineitem.parquet"), []
    for k, times in enumerate((1, 16)):
        tables, shared = tmp_path / f"tables{k}", tmp_path / f"shared{k}"
        tables.mkdir()
        for t in ("events", "embeddings"):
            shutil.copy(f"{SF}/{t}.parquet", tables)
        pq.write_table(pa.concat_tables([whole] * times), tables / "lineitem.parquet")
        before = spark.sparkContext.getCheckpointDir()
        spark.sparkContext.setCheckpointDir(str(shared))
        try:
            done = benchmark.run(spark, str(tables), str(tmp_path / f"out{k}"), SMALL | {"traits": {"trait_2": 1000}, "protocols": ["cv_e"]})
        finally:
            spark.sparkContext.setCheckpointDir(before.removeprefix("file:").rsplit("/", 1)[0])
        left.append((done.agg(F.sum("n")).first()[0], sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())))
    assert left[1][0] == 16 * left[0][0] and left[1][1] < 1.2 * left[0][1]


def test_a_benchmark_of_kernels(spark, tmp_path):
    """A kernel's folds are graded like those of the means, and equal the query's predictions graded alone."""
    config = {"crop": "c", "traits": {"trait_1": 1}, "protocols": ["cv_g"], "models": ["global_mean", "gblup"], "at_once": 1}
    got = {(r.model, r.fold): r for r in benchmark.run(spark, SF, str(tmp_path / "out"), config).collect()}
    assert len(got) == 10
    found = training.kernel_oof(spark, SF, training.Member("gblup", "linear")).toPandas()
    plots = PHENOTYPES.run(spark, SF).where("trait_1 IS NOT NULL").toPandas().merge(found, on=["genotype_id", "environment_id"])
    for fold, rows_of in plots.groupby("fold"):
        own = got["gblup", fold]
        assert own.n == len(rows_of) and own.pearson == pytest.approx(rows_of.trait_1.corr(rows_of.prediction), abs=1e-4)
        assert own.rmse == pytest.approx(float(((rows_of.trait_1 - rows_of.prediction) ** 2).mean() ** 0.5), abs=1e-3)


def documents(folder, name: str, table: pa.Table) -> None:
    (folder / "documents.parquet").mkdir(parents=True, exist_ok=True)
    pq.write_table(table, folder / "documents.parquet" / name)


def test_the_manifest_takes_only_new_texts(spark, tmp_path):
    tables, out = tmp_path / "tables", str(tmp_path / "out")
    whole = pq.read_table(f"{SF}/documents.parquet")
    documents(tables, "a.parquet", whole.slice(0, 90))
    documents(tables, "b.parquet", whole.slice(90, 30))
    text_manifest.run(spark, str(tables), out, TEXTS)
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "manifest").rglob("*.parquet")}
    once = text_manifest.report(spark, out)
    assert once.count() == 120 and {r.batch for r in text_manifest.manifest(spark, out).collect()} == {0, 1}
    odd = pa.table({"doc_id": [1, None, 9001, 9002, 9003], "text": [None, "", "NA . -9 nan 12 -3.5 1e5 AC ACG G\tT\x0bnn", whole["text"][3].as_py(), whole["text"][3].as_py()], "lang": [None, "en", "en", "en", None], "source": [None, None, "src0", "src0", "src1"], "n_chars": [0, 0, 1, 1, 1]}, schema=whole.schema)
    documents(tables, "c.parquet", pa.concat_tables([whole.slice(120), odd]))
    text_manifest.run(spark, str(tables), out, TEXTS)
    mine = text_manifest.report(spark, out)
    assert {p: p.stat().st_mtime_ns for p in first} == first and {r.batch for r in text_manifest.manifest(spark, out).collect()} == {0, 1, 2}
    got = rows(mine)
    assert got == other(text_manifest.sql(), str(tables), ["documents"], mine.columns) and len(got) == 205
    line = mine.where("id = 9001").first()
    assert (line.n_words, line.missing_tokens, line.numbers, line.calls, line.is_null) == (12, 4, 3, 3, False)
    assert len({r.fold for r in mine.where(f"digest = '{mine.where('id = 9002').first().digest}'").collect()}) == 1
    again = text_manifest.run(spark, str(tables), out, TEXTS)
    assert again.count() == 205 and rows(text_manifest.report(spark, out)) == got


def test_a_killed_batch_replaces_itself(spark, tmp_path, monkeypatch):
    tables, out = tmp_path / "tables", str(tmp_path / "out")
    whole = pq.read_table(f"{SF}/documents.parquet")
    documents(tables, "a.parquet", whole.slice(0, 100))
    documents(tables, "b.parquet", whole.slice(100))
    real, seen = text_manifest.manifest, []

    def dies_after_writing(*a):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("killed")
        return real(*a)

    monkeypatch.setattr(text_manifest, "manifest", dies_after_writing)
    with pytest.raises(Exception, match="killed"):
        text_manifest.run(spark, str(tables), out, TEXTS)
    monkeypatch.setattr(text_manifest, "manifest", real)
    text_manifest.run(spark, str(tables), out, TEXTS)
    mine = text_manifest.report(spark, out)
    assert rows(mine) == other(text_manifest.sql(), str(tables), ["documents"], mine.columns)


def test_texts_of_an_empty_table(spark, tmp_path):
    documents(tmp_path, "a.parquet", pq.read_table(f"{SF}/documents.parquet").slice(0, 0))
    assert text_manifest.run(spark, str(tmp_path), str(tmp_path / "out"), TEXTS).count() == 0
