"""Command line: audit, train, predict and serve on crop directories."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import study
from .operators.models import Panel
from .operators.training import Model, Settings, cell_sums, train
from .service import Models, serve, weather_features
from .sources import crops


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="genoscape", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("audit", "train", "predict", "serve"):
        p = sub.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--id-map")
        if name != "serve":
            p.add_argument("--crop", required=True)
            p.add_argument("--out", required=True)
        if name in ("train", "predict"):
            p.add_argument("--trait", required=True)
        if name in ("predict", "serve"):
            p.add_argument("--models", required=True)
        if name == "predict":
            p.add_argument("--requests", required=True)
        if name == "serve":
            p.add_argument("--port", type=int, default=8000)
    a = top.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "serve":
        serve(Models(spark, a.models, a.data, a.id_map), port=a.port).serve_forever()
    elif a.command == "audit":
        traits = crops.long_traits(crops.read_phenotypes(spark, a.data, a.crop, a.id_map))
        where = f"{a.data}/{a.crop}/{a.crop}"
        checked = crops.checked_rows(spark, f"{where}/Phenotypes.csv", ["Environment"])
        reports = [crops.row_report(checked).withColumn("file", F.lit("Phenotypes.csv")), crops.row_report(crops.checked_rows(spark, f"{where}/Environment.csv", ["Environment"])).withColumn("file", F.lit("Environment.csv"))]
        crops.write_rows(reports[0].unionByName(reports[1]).withColumn("first_bad", F.concat_ws(" ", "first_bad")), f"{a.out}/rows")
        crops.write_rows(study.TRAIT_SUMMARY.on(spark, traits=traits), f"{a.out}/traits")
        crops.write_rows(study.TRAIT_BY_ENVIRONMENT.on(spark, traits=traits), f"{a.out}/traits_by_environment")
        crops.write_rows(study.WEATHER_AUDIT.on(spark, long_series=crops.read_weather(spark, a.data, a.crop, a.id_map)), f"{a.out}/weather")
        crops.write_rows(study.MARKER_STATS.on(spark, dosage_long=crops.read_dosage(spark, a.data, a.crop)), f"{a.out}/markers")
    else:
        dosage = crops.read_dosage(spark, a.data, a.crop).persist()
        values = weather_features(crops.read_weather(spark, a.data, a.crop, a.id_map))
        if a.command == "train":
            cells = cell_sums(crops.read_phenotypes(spark, a.data, a.crop, a.id_map), a.trait)
            train(Panel.of(dosage), dosage.select("marker_pos", "marker_id").distinct(), cells, values, f"{a.out}/{a.crop}__{a.trait}", a.crop, a.trait, Settings())
        else:
            asked = crops.canonical(crops.read_requests(spark, a.requests), crops.read_id_map(spark, a.id_map, a.crop), "environment_id")
            crops.write_rows(Model(spark, f"{a.models}/{a.crop}__{a.trait}").predict(asked, dosage, values), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
