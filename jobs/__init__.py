"""Runnable jobs on the library's operators; each module has a command line and a config file beside it."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

log = logging.getLogger("genoscape.jobs")


def command_line(doc: str, config: Path, work: Callable) -> int:
    """Creates and stops the session; the rest is done by ``work(spark, tables, out, config)``."""
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(description=doc)
    p.add_argument("--tables", required=True, help="folder of the input tables, a path that Spark reads")
    p.add_argument("--out", required=True, help="folder of the output, a path that Spark writes")
    p.add_argument("--config", default=str(config), help="local JSON file")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.getOrCreate()
    try:
        work(spark, a.tables, a.out, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()
    return 0


def stored(spark, path: str) -> bool:
    """Whether a path exists, asked through Spark's own file system interface."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
