"""File order and broken rows of CSV files that are read in many ranges."""

import pytest

from genoscape.sources import crops


@pytest.fixture
def small_ranges(spark):
    """Ranges of 200 bytes, several to a partition."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_places_follow_the_file(spark, tmp_path, small_ranges, monkeypatch):
    for part, n in (("a", 300), ("b", 7), ("c", 120)):
        (tmp_path / f"{part}.csv").write_text("name,x\n" + "".join(f"{part}{i},{'y' * (i % 40)}\n" for i in range(n)))
    want = [f"{p}{i}" for p, n in (("a", 300), ("b", 7), ("c", 120)) for i in range(n)]
    for sent in (100_000, 0):
        monkeypatch.setattr(crops, "SENT", sent)
        rows = crops.numbered(crops.read_text_csv(spark, str(tmp_path)), "at")
        assert crops.read_text_csv(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        assert [r.name for r in sorted(rows.collect(), key=lambda r: r["at"])] == want
        assert [r["at"] for r in rows.where("name = 'c3'").collect()] == [310]  # a filter above does not move places
    lines = crops.numbered(spark.read.text(str(tmp_path / "b.csv")), "at")
    assert [r["value"].split(",")[0] for r in lines.orderBy("at").collect()] == ["name"] + [f"b{i}" for i in range(7)]


def test_no_rows_have_no_places(spark, tmp_path):
    (tmp_path / "e.csv").write_text("name,x\n")
    assert crops.numbered(crops.read_text_csv(spark, str(tmp_path / "e.csv")), "at").count() == 0


def test_broken_rows_are_named(spark, tmp_path, small_ranges):
    lines = [f"E{i},G{i},{i}" for i in range(100)]
    lines[17], lines[40], lines[63], lines[80] = "E17,G17", "E40,G40,1,2", " ,G63,1", 'E80,"G,80",1'
    path = tmp_path / "p.csv"
    path.write_text("Environment,Sample,Trait_1\n" + "\n".join(lines) + "\n")
    checked = crops.checked_rows(spark, str(path), ["Environment", "Sample"])
    found = crops.row_report(checked).first()
    assert (found.n_rows, found.n_ragged, found.n_blank, found.first_bad) == (100, 2, 1, [17, 40, 63])
    assert checked.where("row_no = 80").first().Sample == "G,80"
    with pytest.raises(ValueError, match=r"2 rows of another length, 1 without .* first rows \[17, 40, 63\]"):
        crops.must_be_whole(spark, str(path), ["Environment", "Sample"])
    good = tmp_path / "g.csv"
    good.write_text("Environment,Sample,Trait_1\nE1,G1,\n")
    crops.must_be_whole(spark, str(good), ["Environment", "Sample"])


def test_id_columns():
    assert crops.id_column(["Environment", "Trait_1", "Plot", "Sample"]) == "Plot"
    with pytest.raises(ValueError):
        crops.id_column(["Environment", "Trait_1"])
