"""Substring dedup by difference-cover anchors.

A window is ``width`` consecutive words of one document; it is repeated if its word
sequence also starts anywhere else. Anchors are shorter windows at positions whose
remainder modulo a period lies in a difference cover: for any two positions there is a
shift below the period that brings both to cover positions, so two equal windows always
share an anchor. Hence

1. anchors are hashed and counted (only hashes travel); those counted twice are kept;
2. windows that hold such an anchor are the only ones that can be repeated: each match is
   extended to its whole windows, which are hashed and counted;
3. windows counted twice are repeated; their places meet the documents, whose covered
   words are removed.

Frequent hashes are counted where they lie before they are shuffled, places are matched by
a semi join that deals the places of frequent windows to all tasks, and no pairs are made. Step 2 finds the anchors by a
Bloom filter if that is small enough to send, else by a join; a false anchor only adds
windows that step 2 then finds unrepeated. Hashes have 64 bits.

Defined results: a null text has no words. Rows that repeat (even the id) are different
places, so their windows of ``width`` words are repeated. Texts with fewer words have no
window. Very long texts are hashed whole, one at a time. An empty table gives an empty result;
columns other than id and text are not read (``deduplicated`` returns them, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import repeated
from .sketches import bloom_of
from .words import cut, reachable_by_workers, salted_join, text_hashes, tidy, window_hashes

WIDTH = 35
#: Perfect difference sets by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_LONG = pa.int64()


def plan_of(width: int) -> tuple[int, np.ndarray, int]:
    """Period, cover as a mask over remainders, anchor width; anchors keep at least a third of the window."""
    period = max(p for p in COVERS if width - p + 1 >= max(1, -(-width // 3)))
    mask = np.zeros(period, bool)
    mask[list(COVERS[period])] = True
    return period, mask, width - period + 1


def _anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors; none if it has no window."""
    if len(hashes) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    period, mask, short = plan_of(width)
    at = np.flatnonzero(mask[np.arange(len(hashes) - short + 1) % period])
    return at, window_hashes(hashes, short)[at]


def _starts_near(anchors: np.ndarray, n: int, width: int) -> np.ndarray:
    """Starts of the windows that hold one of these anchors."""
    period, most = plan_of(width)[0], n - width + 1
    edge = np.zeros(most + 1, np.int64)
    np.add.at(edge, np.clip(anchors - period + 1, 0, most), 1)
    np.add.at(edge, np.clip(anchors + 1, 0, most), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _keyed(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    return docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("k"), F.col(text).cast("binary").alias("t"), *more)


def _parts(batch: pa.RecordBatch, limit: int = 400) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, limit):
        yield batch.slice(a, limit)


def repeated_starts(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k (row key), starts (array of the first words of repeated windows), for documents that have any."""
    spark = docs.sparkSession
    reachable_by_workers(spark)
    keyed = _keyed(docs, doc_id, text)

    def anchors(batch):
        for t in batch.column(0).to_pylist():
            yield _anchors(text_hashes(t or b""), width)[1]

    twice = cut(repeated(keyed.select("t"), anchors).select("h"))
    bloom = bloom_of(twice, "h", twice.count())
    if bloom is not None:
        sent = spark.sparkContext.broadcast(bloom)

        def windows(t: bytes | None):
            """Starts and hashes of the windows of a text that hold an anchor of the filter."""
            hashes = text_hashes(t or b"")
            at, anchor = _anchors(hashes, width)
            at = at[sent.value.has(anchor)]
            starts = _starts_near(at, len(hashes), width) if len(at) else at
            return starts, window_hashes(hashes, width)[starts] if len(starts) else starts.view(np.uint64)

        def hashed(batch):
            for t in batch.column(0).to_pylist():
                yield windows(t)[1]

        def placed(batches):
            for batch in batches:
                for part in _parts(batch):
                    rows = []
                    for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        starts, found = windows(t)
                        rows.append((found.view(np.int64), np.full(len(starts), k, np.int64), starts.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["w", "k", "start"])

        places = keyed.mapInArrow(tidy(placed), "w long, k long, start int")
        again = cut(repeated(keyed.select("t"), hashed).select(F.col("h").alias("w"), F.col("c").alias("n")))
    else:
        places = _extended_by_join(keyed, twice, width)
        again = cut(places.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"))
    # a window that stands in very many places is met by several tasks
    return salted_join(places, again.select("w"), again, "w", F.xxhash64("k", "start"), "left_semi").groupBy("k").agg(F.collect_set("start").alias("starts"))


def _extended_by_join(keyed: DataFrame, twice: DataFrame, width: int) -> DataFrame:
    """The windows around repeated anchors where these are too many for a filter: their places come back by a semi join."""

    def placed(batches):
        for batch in batches:
            for part in _parts(batch):
                rows = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    at, anchor = _anchors(text_hashes(t or b""), width)
                    rows.append((anchor.view(np.int64), np.full(len(at), k, np.int64), at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["h", "k", "at"])

    def extended(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in _parts(batch):
                rows = []
                for k, packed, at in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    hashes = text_hashes(unpack(packed))
                    starts = _starts_near(np.array(at, np.int64), len(hashes), width)
                    rows.append((window_hashes(hashes, width)[starts].view(np.int64), np.full(len(starts), k), starts.astype(np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["w", "k", "start"])

    places = keyed.mapInArrow(tidy(placed), "h long, k long, at int")
    hits = places.join(twice, "h", "left_semi").groupBy("k").agg(F.collect_set("at").alias("at"))
    packed = keyed.mapInArrow(tidy(_packed), "k long, packed binary")
    return packed.join(hits, "k").select("k", "packed", "at").mapInArrow(tidy(extended), "w long, k long, start int")


def _packed(batches):
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(t or b"") for t in batch.column(1).to_pylist()], pa.binary()), *batch.columns[2:]], names=["k", "packed", *batch.schema.names[2:]])


def covered_words(n: int, starts: list[int] | None, width: int) -> np.ndarray:
    """Mask of the n words that a window covers."""
    edge = np.zeros(n + 1, np.int64)
    if starts:
        at = np.array(starts, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _joined(docs: DataFrame, width: int, doc_id: str, text: str, carry: list[str]) -> DataFrame:
    """packed text, carried columns (as __0, __1, ..., whatever they are called) and starts: texts are shuffled once, compressed."""
    reachable_by_workers(docs.sparkSession)
    shown = _keyed(docs, doc_id, text, F.col(text).isNull().alias("__null"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(carry)])
    schema = ", ".join(["k long", "packed binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[2:]]])
    return shown.mapInArrow(tidy(_packed), schema).join(repeated_starts(docs, width, doc_id, text), "k", "left").drop("k")


def substring_dedup(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every document."""
    joined = _joined(docs, width, doc_id, text, [doc_id]).select("packed", "__0", "starts")

    def removed(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, i, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = unpack(packed).split()
                gone = covered_words(len(words), starts, width)
                kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.column(1).type, _LONG, _LONG, pa.string()], strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return joined.mapInArrow(tidy(removed), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with the covered words taken out of their texts; texts without any stay byte for byte, null stays null."""
    carry = [c for c in docs.columns if c != text]
    joined = _joined(docs, width, doc_id, text, carry)

    def cleaned(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = []
            for packed, null, starts in zip(*(batch.column(c).to_pylist() for c in ("packed", "__null", "starts")), strict=True):
                raw = unpack(packed)
                if starts:
                    words = raw.split()
                    raw = b" ".join(w for w, g in zip(words, covered_words(len(words), starts, width).tolist(), strict=True) if not g)
                texts.append(None if null else raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__{i}") for i in range(len(carry))), pa.array(texts, pa.string())], names=[*carry, text])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry], f"`{text}` string"])
    out = joined.mapInArrow(tidy(cleaned), schema)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)
