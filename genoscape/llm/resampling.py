"""Target-distribution importance resampling with hashed n-grams, in Spark SQL functions alone.

1. Every text becomes its array of n-grams of words, which is exploded; a feature's bucket is the
   crc32 of its bytes modulo ``buckets``. Buckets are counted over all documents and over all target
   texts, where the rows lie first, so at most one row a bucket and task is shuffled.
2. A bucket's gain is a scaled log ratio of its smoothed shares in target and documents. The table
   has ``buckets`` rows, a parameter, and is sent to all tasks.
3. A document's features meet their gains and are summed where the document lies; one row a document
   is shuffled. Its score is that weight plus Gumbel noise from a hash of its id, so taking the
   highest scores draws without replacement in proportion to exp(weight / 1000).
4. Scores are sorted in ranges. Sorted rows are written once with their place in their partition;
   the rank is that place plus the number of rows in the partitions before, of which there is one
   small row each. No task sees more than its range.

Defined results: a null text has no words, hence no features, weight 0, and is never drawn if
``least_words`` is above 0. Documents without features: weight 0. A null id is hashed as the empty
string and comes after all others among equal scores. Rows that repeat are documents of their own:
equal ones have equal scores and neighbouring ranks. A text longer than most is one array in one
row. An empty table of documents gives an empty result; an empty target has all counts 0. Only id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import cut

BUCKETS, SEED = 10_000, 2024
#: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: monotonically_increasing_id() has a row's place in its partition in these bits.
_PLACE = (1 << 33) - 1


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def grams(of: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` consecutive words, joined by one space."""

    def runs(n: int) -> Column:
        if n == 1:
            return of
        starts = F.when(F.size(of) >= n, F.sequence(F.lit(1), F.size(of) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(of, i, n), " "))

    return F.concat(*[runs(n) for n in range(least, most + 1)])


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def _counts(texts: DataFrame, text: str, least: int, most: int, buckets: int, name: str) -> DataFrame:
    feature = texts.select(F.explode(grams(words(F.col(text)), least, most)).alias("g"))
    return feature.groupBy(bucket(F.col("g"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gain_table(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, text: str = "text", target_text: str = "text") -> DataFrame:
    """bucket, gain: one row for each bucket."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    held = every.join(_counts(docs, text, least, most, buckets, "s"), "bucket", "left").join(_counts(target, target_text, least, most, buckets, "t"), "bucket", "left")
    held = cut(held.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")))
    sums = F.broadcast(held.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return held.join(sums).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def weights(docs: DataFrame, gains: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    of = words(F.col(text))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("k"), of.alias("w"))
    own = own.select("doc_id", "k", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(grams(F.col("w"), least, most)).alias("at", "g"))
    met = own.select("doc_id", "k", "n_words", "at", bucket(F.col("g"), buckets).alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    # the first feature of a document counts it: equal documents are one group of several
    rows = F.sum((F.coalesce("at", F.lit(0)) == 0).cast("long"))
    sums = met.groupBy("doc_id", "k", "n_words").agg(F.count("bucket").alias("n"), F.sum(F.coalesce("gain", F.lit(0))).alias("gain"), rows.alias("rows"))
    each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return sums.select("doc_id", "n_words", (F.expr("n div rows")).alias("n_features"), F.expr("gain div rows").alias("weight"), each.alias("__nth")).drop("__nth")


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate of a hash of the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def ranked(rows: DataFrame, takes_part: Column, score: str, *ties: str) -> tuple[DataFrame, DataFrame]:
    """rows with ``rank`` (1, 2, 3 ... among those that take part, highest score first; else null), and how many take part (n)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("__in"), F.desc(score), *[F.asc_nulls_last(c) for c in ties]]
    placed = rows.withColumn("__in", F.coalesce(takes_part, F.lit(False))).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(_PLACE)))
    sizes = placed.groupBy("__part").agg(F.count_if("__in").alias("n"))  # one row a partition
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.__part") < F.col("a.__part"), "left").groupBy("a.__part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("__before"))
    out = placed.join(F.broadcast(before), "__part").withColumn("rank", F.when(F.col("__in"), F.col("__before") + F.col("__at") + 1))
    return out.drop("__in", "__part", "__at", "__before"), sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def resampled(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = 20, percent: int = 10, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (of the drawn ones, else null) of every document.

    Drawn are the ``percent`` of all documents with ``least_words`` words that have the highest scores, ties to smaller ids."""
    gains = gain_table(docs, target, least, most, buckets, text, target_text)
    scored = weights(docs, gains, least, most, buckets, doc_id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    placed, taking = ranked(scored, F.col("n_words") >= least_words, "score", "doc_id", "n_features")
    limit = F.broadcast(taking.select(F.expr(f"n * {percent} div 100").alias("__limit")))
    drawn = F.when(F.col("rank") <= F.col("__limit"), F.col("rank"))
    return placed.join(limit).select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))
