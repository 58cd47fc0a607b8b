"""Words, word hashes and hashes of word windows, shared by the text operators.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D, which is what
``bytes.split()`` yields. Hashes depend on the bytes alone, so every task and every
rerun agrees on them.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Entries of one generation of a worker's word table; two are kept (about 30 MB).
TABLE_LIMIT = 80_000
#: Bytes of a batch that goes to a Python worker: JVM and worker both hold one a task, so rows alone are no bound for long texts.
BATCH, _BATCH_KEY = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Up to this many rows of one key are no burden to a task.
FAIR_SHARE = 1000
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


class BoundedTable(dict):
    """A memo of ``make`` in two generations: a full one replaces the older, whose entries live on only if used again."""

    def __init__(self, make, limit: int = TABLE_LIMIT):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def hash64(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


_HASHES = BoundedTable(hash64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes of a text, or values of a sequence, that are hashed at a time.
SLICE = 1 << 18
#: Longer words are hashed byte by byte: over many bytes a polynomial modulo 2**64 takes some unequal words for equal.
LONG_WORD = 64


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for one slice and a longest window beyond."""
    out = []
    with np.errstate(over="ignore"):
        for base in (_P, _P_INV):
            steps = np.full(SLICE + 1, base, U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in slices that end where a word does; one word alone may be longer than a slice."""
    n, first = len(text), 0
    while first < n:
        last = min(first + SLICE, n)
        if last < n and not _SPACE[text[last]]:
            edge = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, last - first, first)])
            if len(edge):
                last = first + int(edge[-1]) + 1
            else:
                while last < n:
                    more = min(SLICE, n - last)
                    edge = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, more, last)])
                    if len(edge):
                        last += int(edge[0])
                        break
                    last += more
        yield text[first:last] if first or last < n else text
        first = last


def text_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text: polynomials of their bytes, from prefix sums, without making the words; of long words a hash of their bytes."""
    parts = [_slice_hashes(s) for s in _slices(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, U64)


def _slice_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if n > SLICE:  # one word
        return np.array([hash64(text.strip())], U64)
    edge = np.empty(n + 2, bool)
    edge[0] = edge[-1] = True
    np.take(_SPACE, data, out=edge[1:-1])
    at = np.flatnonzero(edge[1:] != edge[:-1])
    first, last = at[::2], at[1::2]
    up, down = _powers()
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.multiply(data, up[:n], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    found = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(last - first > LONG_WORD).tolist():
        found[i] = hash64(text[first[i] : last[i]])
    return found


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values; empty if there are fewer."""
    n = len(hashes)
    if n < width:
        return np.empty(0, U64)
    if width > LONG_WORD:
        return np.fromiter((hash64(hashes[i : i + width].tobytes()) for i in range(n - width + 1)), U64, n - width + 1)
    out, (up, down) = np.empty(n - width + 1, U64), _powers()
    with np.errstate(over="ignore"):
        for a in range(0, len(out), SLICE - LONG_WORD):
            part = hashes[a : a + SLICE - LONG_WORD + width - 1]
            m = len(part)
            sums = np.zeros(m + 1, U64)
            np.cumsum(part * up[:m], out=sums[1:])
            out[a : a + m - width + 1] = mix((sums[width:] - sums[: m - width + 1]) * down[: m - width + 1] + U64(width))
    return out


def tidy(work):
    """The work on a task's batches; when it ends, freed memory goes back to the system, which the JVM beside the worker needs."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def reachable_by_workers(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package, and bounds their batches unless the session does."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set here only where unset."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not found:
        import tempfile

        found = tempfile.mkdtemp(prefix="genoscape-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Written once to the shared folder, so that later steps neither recompute it nor lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as Parquet: for large tables of which later steps read some columns."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """64 bits that tell apart rows of unequal id or text; equal rows share them, and every decision here is the same for equal rows."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def salted_join(rows: DataFrame, table: DataFrame, counts: DataFrame, on: str, salt, how: str = "inner") -> DataFrame:
    """rows joined to a table whose ``on`` is unique; a key with more rows than a task's fair share is dealt to all tasks.

    counts: ``on`` and how many rows have it (n). At most 4 keys a task can be that hot, whatever the data, so these
    are collected; their entries of the table are sent once for each salt. ``salt`` is a 64-bit value of rows that
    differs within a hot key."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(FAIR_SHARE, total // (4 * parts))).select(F.col(on).alias("__k"))
    found = [(r[0],) for r in hot.collect()]
    if not found:
        return rows.join(table, on, how)
    held = F.broadcast(spark.createDataFrame(found, hot.schema))
    here = F.col("__k").isNotNull()
    left = rows.join(held, F.col(on) == F.col("__k"), "left").withColumn("__salt", F.when(here, F.pmod(salt, F.lit(parts))).otherwise(0).cast("int")).drop("__k")
    right = table.join(held, F.col(on) == F.col("__k"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(here, F.lit(parts - 1)).otherwise(0)))).drop("__k")
    return left.join(right, [on, "__salt"], how).drop("__salt")
