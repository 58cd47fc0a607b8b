"""One query text for two engines.

An ``Operator`` is a SELECT over named inputs. On Spark its inputs are DataFrames, so operators
compose lazily into one Catalyst plan; the same text with its inputs as common table
expressions is the SQL that a second engine runs on the stored tables. The few functions whose
names differ are written as macros."""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: macro: (Spark, second engine); {0}, {1} are its arguments.
MACROS = {
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "BUCKET": ("cast(conv(substr(sha2({0}, 256), 1, 8), 16, 10) AS bigint) % {1}", "cast('0x' || substr(sha256({0}), 1, 8) AS bigint) % {1}"),
    "FIELD": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "NUMBER": ("try_cast({0} AS double)", "try_cast({0} AS double)"),
    "STRIPPED": ("btrim({0}, ' \t\n\r\f\v')", "trim({0}, ' \t\n\r\f\v')"),
    "JOINED": ("array_join(array_sort(collect_list({0})), {1})", "array_to_string(list_sort(list({0})), {1})"),
    "MATCHES": ("regexp_like({0}, {1})", "regexp_matches({0}, {1})"),
    "REPLACED": ("regexp_replace({0}, {1}, '$2_$1')", "regexp_replace({0}, {1}, '\\2_\\1')"),
    "ELEMENT": ("element_at({0}, cast({1} AS integer))", "list_extract({0}, {1})"),
    "HALF_EVEN": ("bround({0})", "round_even({0}, 0)"),
    "WORDS": ("regexp_extract_all({0}, '[^ \t\n\v\f\r]+', 0)", "regexp_extract_all({0}, '[^ \t\n\v\f\r]+')"),
    "HOW_MANY": ("size(filter({0}, w -> {1}))", "len(list_filter({0}, lambda w: {1}))"),
    "SERIES": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
}
_CALL = re.compile(r"\b(" + "|".join(MACROS) + r")\(")


def written(text: str, side: int) -> str:
    """The text with macros written out for Spark (0) or the second engine (1)."""
    while m := _CALL.search(text):
        at, depth, args, begin = m.end(), 1, [], m.end()
        while depth:
            c = text[at]
            depth += c == "("
            depth -= c == ")"
            if (c == "," and depth == 1) or not depth:
                args.append(text[begin:at].strip())
                begin = at + 1
            at += 1
        text = text[: m.start()] + MACROS[m[1]][side].format(*args) + text[at:]
    return text


@dataclass(frozen=True)
class Operator:
    """A SELECT over inputs; an input is another operator or the name of a stored table."""

    text: str
    inputs: tuple[tuple[str, "Operator | str"], ...] = ()

    @classmethod
    def of(cls, text: str, **inputs: "Operator | str") -> Operator:
        return cls(text, tuple(inputs.items()))

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """Over given DataFrames in place of inputs of these names."""
        place = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(frames) + r")\b(\s+AS\s+\w+)?")
        marked = place.sub(lambda m: f"{m[1]} {{{m[2]}}}{m[3] or f' AS {m[2]}'}", written(self.text, 0))
        return spark.sql(marked, **frames)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.built(spark, sf_dir, {})

    def built(self, spark: SparkSession, sf_dir: str, made: dict[int, DataFrame]) -> DataFrame:
        """Every operator below is analysed once, however many others read it."""
        if id(self) not in made:
            held = {name: spark.read.parquet(f"{sf_dir}/{x}.parquet") if isinstance(x, str) else x.built(spark, sf_dir, made) for name, x in self.inputs}
            made[id(self)] = self.on(spark, **held)
        return made[id(self)]

    def sql_text(self) -> str:
        return self.text

    def sql(self) -> str:
        parts: dict[str, str] = {}

        def add(op: Operator) -> None:
            for name, x in op.inputs:
                if isinstance(x, Operator):
                    add(x)
                    parts.setdefault(name, written(x.sql_text(), 1))

        add(self)
        head = ", ".join(f"{name} AS ({text})" for name, text in parts.items())
        return (f"WITH {head} " if head else "") + f"SELECT * FROM ({written(self.sql_text(), 1)}) AS result"


@dataclass(frozen=True)
class Twofold(Operator):
    """An operator whose text for the second engine is another one."""

    other: str = ""

    def sql_text(self) -> str:
        return self.other


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of its own only for a local master where that is unset."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    found = found or tempfile.mkdtemp(prefix="genoscape-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def importable(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package; on a cluster it is shipped."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def cut(frame: DataFrame) -> DataFrame:
    """Written once to the shared folder, so that readers neither plan nor compute it again."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


@dataclass(frozen=True)
class Written(Twofold):
    """Its rows are read many times over, so they are written before."""

    def built(self, spark: SparkSession, sf_dir: str, made: dict[int, DataFrame]) -> DataFrame:
        if id(self) not in made:
            made[id(self)] = cut(super().built(spark, sf_dir, made))
        return made[id(self)]


#: Rows of a table of cells that is still sent to all tasks.
FEW = 1_000_000


@dataclass(frozen=True)
class Sent(Operator):
    """Its subqueries of these names (``sent``) have at most a row for each of an input ``by``; while that is small, they are sent to where the rows are."""

    sent: str = ""
    by: str = ""

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        if frames[self.by].limit(FEW + 1).count() > FEW:
            return super().on(spark, **frames)
        return Operator(self.text.replace("SELECT ", f"SELECT /*+ BROADCAST({self.sent}) */ ", 1), self.inputs).on(spark, **frames)
