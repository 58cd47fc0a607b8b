"""Which 64-bit hashes occur more than once, how often, and which ids share one.

Hashes are counted in the task that makes them and travel as sorted runs: a run is cut by
the leading bits into buckets, and a bucket is sent as one row that holds the gaps between
its hashes in as few bytes as they need. A frequent hash is one entry of each run, however
often it occurs, so no key is hot, and a hash costs about 6 bytes instead of a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import U64, reachable_by_workers, tidy

#: Hashes in a run: a task holds a few times as many.
RUN = 1 << 20
_SENT = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())])


def packed_run(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(bucket, n, bytes per gap, gaps, counts above 1 as pairs of place and count) of a run."""
    found, count = np.unique(hashes, return_counts=True)
    bucket = (found >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(found)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        part = found[a:b]
        gaps = np.diff(part, prepend=U64(int(bucket[a]) << (64 - bits) if bits else 0))
        width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
        more = np.flatnonzero(count[a:b] > 1)
        yield int(bucket[a]), b - a, width, gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), np.stack([more, count[a:b][more]]).astype("<u4").tobytes()


def unpacked(bucket: int, n: int, width: int, gaps: bytes, counts: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(gaps, np.uint8).reshape(n, width)
    hashes = np.cumsum(wide.reshape(-1).view("<u8"), dtype=U64) + U64(bucket << (64 - bits) if bits else 0)
    count = np.ones(n, np.int64)
    more = np.frombuffer(counts, "<u4").reshape(2, -1)
    count[more[0]] = more[1]
    return hashes, count


def repeated(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """h and c (how often, 2 and more) of the hashes that ``hashes_of`` makes of all batches of rows."""
    spark = rows.sparkSession
    reachable_by_workers(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (4 * parts - 1).bit_length()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def run() -> pa.RecordBatch:
            out = list(packed_run(np.concatenate(held), bits))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _SENT, strict=True)], schema=_SENT)

        for batch in batches:
            for made in hashes_of(batch):
                held.append(made)
                size += len(made)
                if size >= RUN:
                    yield run()
                    held, size = [], 0
        if size:
            yield run()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, counts = None, [], []

        def done() -> pa.RecordBatch:
            h, c = np.concatenate(hashes), np.concatenate(counts)
            by = np.argsort(h)
            h, c = h[by], c[by]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            total = np.add.reduceat(c, first)
            twice = total > 1
            return pa.RecordBatch.from_arrays([pa.array(h[first][twice].view(np.int64)), pa.array(total[twice])], names=["h", "c"])

        for batch in batches:
            for bucket, *run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if hashes:
                        yield done()
                    now, hashes, counts = bucket, [], []
                h, c = unpacked(bucket, *run, bits)
                hashes.append(h)
                counts.append(c)
        if hashes:
            yield done()

    sent = rows.mapInArrow(tidy(send), "bucket int, n int, width int, gaps binary, counts binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(count), "h long, c long")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Pairs in a row that is sent.
_CHUNK = 1 << 16


def first_of_each(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their smallest id, and the distinct pairs (id, smallest) of all other ids."""
    by = np.lexsort((ids, hashes))
    hashes, ids = hashes[by], ids[by]
    fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]
    low = ids[fresh]
    own = low[np.cumsum(fresh) - 1]
    pairs = np.stack([ids, own], axis=1)[ids != own]
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return hashes[fresh], low, pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))[: len(pairs)]]


def sharing(rows: DataFrame, postings_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, int]]]) -> DataFrame:
    """a and b, pairs of ids that connect all ids that share a hash; ``postings_of`` gives hashes with the id that has them.

    They travel like counted hashes, in runs with 8 bytes more for the id. Of the ids that share a hash within a run only the
    smallest is sent on, the others are hung on it there, so a hash that many share is one entry of each run."""
    spark = rows.sparkSession
    reachable_by_workers(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (4 * parts - 1).bit_length()
    sent_as = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("gaps", pa.binary()), ("ids", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0

        def run() -> pa.RecordBatch:
            hashes, low, pairs = first_of_each(np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(x) for x in held]))
            out, at = [], 0
            for bucket, n, width, gaps, _ in packed_run(hashes, bits):
                out.append((bucket, n, width, gaps, low[at : at + n].tobytes()))
                at += n
            # pairs that are found go to any task
            out += [(int(pairs[a, 0]) & ((1 << bits) - 1), 0, 0, b"", pairs[a : a + _CHUNK].tobytes()) for a in range(0, len(pairs), _CHUNK)]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), sent_as, strict=True)], schema=sent_as)

        for batch in batches:
            for made, own in postings_of(batch):
                if len(made):
                    held.append(made)
                    ids.append(own)
                    size += len(made)
                if size >= RUN:
                    yield run()
                    held, ids, size = [], [], 0
        if size:
            yield run()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, ids = None, [], []

        def made(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIRS)

        for batch in batches:
            for bucket, n, width, gaps, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not n:
                    yield made(np.frombuffer(own, np.int64).reshape(-1, 2))
                    continue
                if bucket != now:
                    if hashes:
                        yield made(first_of_each(np.concatenate(hashes), np.concatenate(ids))[2])
                    now, hashes, ids = bucket, [], []
                hashes.append(unpacked(bucket, n, width, gaps, b"", bits)[0])
                ids.append(np.frombuffer(own, np.int64))
        if hashes:
            yield made(first_of_each(np.concatenate(hashes), np.concatenate(ids))[2])

    sent = rows.mapInArrow(tidy(send), "bucket int, n int, width int, gaps binary, ids binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), "a long, b long")
