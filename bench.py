"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = "trait_summary weather_basic weather_dynamic marker_stats cv_ge split_summary oof fold_report leaderboard gate scored strict_registry independent_roles cell_predictions strict_leaderboard token_codes genomic_op portable_predict genomic_ridge_oof kernel_rkhs_oof".split()


def main() -> None:
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    from pyspark.sql import SparkSession

    from genoscape.operators import protocols, study, training

    runs = {name: op.run for name, op in (study.OPERATORS | protocols.OPERATORS).items()} | training.QUERIES

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    began = time.time()
    spark.range(200_000_000).selectExpr("sum(hash(id))").collect()  # the same work in every round: how fast the machine is
    machine = round(time.time() - began, 3)
    took = {}
    for name in HEADLINE:
        began = time.time()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "calibration": machine, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
