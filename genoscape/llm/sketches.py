"""Bounded sketches that are broadcast: a Bloom filter and a table of frequency levels.

Both are built by the executors and have a largest size, which is checked before anything
is sent; beyond it their users go another way that needs no broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, reachable_by_workers, tidy

BLOOM_BITS, BLOOM_PER_KEY, BLOOM_HASHES = 1 << 27, 16, 4
LEVEL_CELLS, PAGE = 1 << 26, 1 << 15
#: Bits of the map of hashes that the table has no room for (64 MB at most), and how many it has for each.
RARE_BITS, RARE_PER_KEY = 1 << 29, 4


class Bloom:
    """Over 64-bit hashes; a key's bits are h1 + i * h2 of two slices of its hash."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, U64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, two = keys & U64((1 << 30) - 1), (keys >> U64(31)) & U64((1 << 30) - 1)
        found = np.ones(len(keys), bool)
        for i in range(BLOOM_HASHES):
            at = (one + U64(i) * two) & self.mask
            found &= (self.words[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1
        return found


def bloom_of(keys: DataFrame, column: str, count: int) -> Bloom | None:
    """Of a column of 64-bit hashes; None if the filter would be larger than BLOOM_BITS bits (16 MB)."""
    bits = max(1 << 12, 1 << (BLOOM_PER_KEY * count - 1).bit_length())
    if bits > BLOOM_BITS:
        return None
    key = F.col(column)
    one, two = key.bitwiseAND((1 << 30) - 1), F.shiftrightunsigned(key, 31).bitwiseAND((1 << 30) - 1)
    at = F.explode(F.array(*[(one + two * i).bitwiseAND(bits - 1) for i in range(BLOOM_HASHES)]))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U64)
    return Bloom(out)


class Levels:
    """A coarse frequency of each 64-bit hash: 0 only if it was counted once, else the base-2 logarithm of its count, 15 at most; two cells a byte.

    Hashes that share a cell have the larger level: still one value per hash, so that an order
    by (level, hash) is the same wherever it is used. Hashes that the table has no room for, the least
    frequent ones, have level 1 by a map of single bits."""

    def __init__(self, cells: np.ndarray, rare: np.ndarray | None = None):
        self.cells, self.mask, self.rare = cells, U64(2 * len(cells) - 1), rare

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        level = (self.cells[at >> U64(1)] >> ((at & U64(1)) << U64(2)).astype(np.uint8)) & np.uint8(15)
        if self.rare is None:
            return level
        at = (keys >> U64(8)) & U64(8 * len(self.rare) - 1)
        return np.maximum(level, (self.rare[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        cell, level = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for page in np.unique(cell // PAGE).tolist():
            mine = cell // PAGE == page
            np.maximum.at(pages.setdefault(page, np.zeros(PAGE, np.uint8)), cell[mine] % PAGE, level[mine].astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([(p[::2] | p[1::2] << 4).tobytes() for p in pages.values()], pa.binary())], names=["page", "cells"])


def _bit_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column(0).to_numpy()
        for page in np.unique(at // PAGE).tolist():
            own = at[at // PAGE == page] % PAGE
            np.bitwise_or.at(pages.setdefault(page, np.zeros(PAGE // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([p.tobytes() for p in pages.values()], pa.binary())], names=["page", "cells"])


def _whole(rows: DataFrame, work, size: int, page_bytes: int) -> np.ndarray:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = rows.repartition(n, F.floor(F.col("cell") / PAGE)).mapInArrow(tidy(work), "page long, cells binary").toArrow()
    out = np.zeros(size, np.uint8)
    for page, data in zip(table["page"].to_pylist(), table["cells"].to_pylist(), strict=True):
        out[page * page_bytes : (page + 1) * page_bytes] = np.frombuffer(data, np.uint8)
    return out


def levels_of(counts: DataFrame, column: str = "h", count: str = "c") -> Levels:
    """Of hashes with their counts (2 and more). The table has at most LEVEL_CELLS cells (32 MB): if there are
    more than half as many hashes, the most frequent ones are kept, by whole levels, and the others have a bit each."""
    reachable_by_workers(counts.sparkSession)
    level = F.least(F.floor(F.log2(F.col(count).cast("double"))), F.lit(15)).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, held = 64, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > LEVEL_CELLS // 2:
            break
        least, held = k, held + sizes[k]
    cells = max(PAGE, min(LEVEL_CELLS, 1 << (2 * held).bit_length()))
    rows = counts.where(level >= least).select(F.col(column).bitwiseAND(cells - 1).alias("cell"), level.alias("level"))
    table, left = _whole(rows, _pages, cells // 2, PAGE // 2), sum(sizes.values()) - held
    if not left:
        return Levels(table)
    bits = max(PAGE, min(RARE_BITS, 1 << (RARE_PER_KEY * left - 1).bit_length()))
    rare = counts.where(level < least).select(F.shiftrightunsigned(column, 8).bitwiseAND(bits - 1).alias("cell"))
    return Levels(table, _whole(rare, _bit_pages, bits // 8, PAGE // 8))
