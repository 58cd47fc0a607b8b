"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

A source's target share of the words says how many copies each of its documents should be
taken, a number f of 0 to 3: floor(f) copies are certain, the fractional rest is a
probability to be rounded. Rounding is pivotal: two fractional documents trade mass (their
size times their probability, of which nothing is lost) in a random direction, fairly for
both, until one of them is integral; the other meets the next document. A chunk of
``FAN_IN`` documents of a source is reduced to at most one fractional document by a fold,
the residuals of ``FAN_IN`` chunks meet in the next level, and so on: a reduction tree
whose tasks are small even if one source holds most rows. A source's taken words miss its
target by less than its last document. Random draws are hashes of the rows, so reruns agree.

Defined results: null and empty texts have size 0 and are never taken. Null sources form
one source, last in order. Repeated rows (even of one id) are rounded one by one. A table
without words takes nothing; an empty table gives an empty result. A very long text is one
document of its size, whose words are counted where it lies. Sources whose sizes tie share by
the same rule, whatever their order. Only id, source and text are read, so other columns may
have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import cut, salted_join

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, FAN_IN, SEED = (5, 2, 1), 3, 128, 20240229
_EPS = 1e-9


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size (words) and a key that differs between texts."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"))


def _places(by_source: DataFrame) -> DataFrame:
    """by_source with ``place``, the place of a source by code point (null last): ranges are counted, then numbered apart."""
    n = int(by_source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.asc_nulls_last("source")
    ranged = cut(by_source.repartitionByRange(n, order).withColumn("range", F.spark_partition_id()))
    before = F.sum("m").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    starts = ranged.groupBy("range").agg(F.count("*").alias("m")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("range").orderBy(order))
    return ranged.withColumn("nth", nth).join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.col("nth") - 1).drop("range", "nth", "start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size and target: all words shared by weight, at most ``most`` times a source's size.

    Sources above their cap are set to it and the rest is shared anew among the others, until none is above. A
    round is one sum over the sources; it caps all that are above at once, so a few rounds do. Sums are of whole
    numbers, so ties and the order of sources make no difference."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    held = cut(_places(by_source).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).drop("place"))
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        found = held.agg(F.count_if(above).alias("capped"), F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if found["capped"] == capped or not found["weight"]:
            break
        level, capped = (found["all"] - found["held"]) / found["weight"], found["capped"]
    return held.select("source", "n", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _fold(level: int):
    """One chunk: ``cur`` is the document that is still fractional (null if none), ``out`` the decided ones."""
    item = "struct<doc_id:{0},source:{1},size:bigint,key:bigint,salt:bigint,nth:int,source_size:bigint,target:double,base:int,p:double>"

    def build(kinds: tuple[str, str]):
        kind = item.format(*kinds)
        zero = F.struct(F.lit(None).cast(kind).alias("cur"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(acc, b):
            a = acc["cur"]
            sa, sb = a["size"].cast("double"), b["size"].cast("double")
            gain = F.least((1 - a["p"]) * sa, b["p"] * sb)  # most mass that a can take from b
            lose = F.least(a["p"] * sa, (1 - b["p"]) * sb)
            draw = F.pmod(F.xxhash64(F.lit(SEED + level), a["key"], a["salt"], b["key"], b["salt"]), F.lit(1 << 52)) / float(1 << 52)
            move = F.when(draw * (gain + lose) < lose, gain).otherwise(-lose)
            snap = lambda p: F.when(p < _EPS, F.lit(0.0)).when(p > 1 - _EPS, F.lit(1.0)).otherwise(p)
            a2, b2 = a.withField("p", snap(a["p"] + move / sa)), b.withField("p", snap(b["p"] - move / sb))
            pair = F.struct(a2.alias("a"), b2.alias("b"))
            done = lambda x: (x["p"] == 0) | (x["p"] == 1)
            # the pair is an array of one so that it is computed once
            merged = F.element_at(F.transform(F.array(pair), lambda x: F.struct(
                F.when(~done(x["a"]), x["a"]).when(~done(x["b"]), x["b"]).alias("cur"),
                F.concat(acc["out"], F.filter(F.array(x["a"], x["b"]), done)).alias("out"))), 1)
            return F.when(a.isNull(), F.struct(b.alias("cur"), acc["out"].alias("out"))).otherwise(merged)

        return zero, step

    return build


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies), copies and the row's key, one row per document."""
    sizes = cut(sized(docs, doc_id, source, text))
    goal = targets(sizes, weights, most)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + _EPS).cast("int")
    # equal rows are counted before they meet, then numbered, so that a chunk stays small whatever repeats
    rows = sizes.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("m")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    at = F.struct("source").alias("at")  # null sources meet too
    rows = salted_join(rows.select("*", at), goal.select(at, "n", "source_size", "target"), goal.select(at, "n"), "at", F.col("key"))
    rows = rows.select("doc_id", "source", "size", "key", F.xxhash64("doc_id", "source", "key", "nth").alias("salt"), "nth", "source_size", "target", whole.alias("base"), F.greatest(F.lit(0.0), wanted - whole).alias("p"), "n")
    rows = rows.withColumn("p", F.when((F.col("size") == 0) | (F.col("p") < _EPS), 0.0).otherwise(F.col("p")))
    fields = [c for c in rows.columns if c != "n"]
    kinds = (rows.schema["doc_id"].dataType.simpleString(), rows.schema["source"].dataType.simpleString())
    decided = rows.where("p = 0").select(*fields)
    largest = goal.agg(F.max("n")).first()[0] or 0
    live = rows.where("p > 0").withColumn("chunks", F.ceil(F.col("n") / FAN_IN)).withColumn("chunk", F.pmod(F.col("salt"), F.col("chunks"))).drop("n")
    level = 0
    while True:
        zero, step = _fold(level)(kinds)
        item = F.struct(*[F.col(c) for c in ("salt", "key", *[f for f in fields if f not in ("salt", "key")])])
        ordered = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
        grouped = live.groupBy("source", "chunk", "chunks").agg(ordered.alias("items"))
        grouped = cut(grouped.select("source", "chunk", "chunks", F.aggregate("items", zero, step).alias("x")))
        decided = decided.unionByName(grouped.select(F.explode("x.out").alias("d")).select("d.*"))
        left = grouped.where("x.cur IS NOT NULL").select("x.cur.*", "chunk", "chunks")
        if largest <= FAN_IN ** (level + 1):
            break
        live = left.withColumn("chunks", F.ceil(F.col("chunks") / FAN_IN)).withColumn("chunk", F.pmod(F.floor(F.col("chunk")), F.col("chunks")))
        level += 1
    last = F.pmod(F.xxhash64(F.lit(SEED - 1), "key", "salt"), F.lit(1 << 52)) / float(1 << 52) < F.col("p")
    decided = decided.unionByName(left.select(*[c for c in fields if c != "p"], last.cast("double").alias("p")))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("p").cast("int")).otherwise(0)
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "key")


def sources_and_targets(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size and target (to three places) of every document, without drawing any."""
    sizes = cut(sized(docs, doc_id, source, text))
    goal, at = targets(sizes), F.struct("source").alias("at")
    rows = salted_join(sizes.select("*", at), goal.select(at, "source_size", F.round("target", 3).alias("target")), goal.select(at, "n"), "at", F.col("key"))
    return rows.select("doc_id", "size", "source_size", "target")


def take(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Equal rows share what the mix takes of them all."""
    at_least = [F.count_if(F.col("copies") >= k).alias(f"at_least_{k}") for k in range(1, MOST + 1)]
    wanted = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(*at_least)
    own = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text)))
    own = own.join(wanted, F.col(doc_id).eqNullSafe(F.col("__id")) & (own["__key"] == wanted["__key"])).drop(wanted["__key"])
    own = own.withColumn("__nth", F.row_number().over(W.partitionBy(doc_id, "__key").orderBy(F.lit(1))))
    n = sum((F.col("__nth") <= F.col(f"at_least_{k}")).cast("int") for k in range(1, MOST + 1))
    return own.withColumn("__copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))).select(*docs.columns)
