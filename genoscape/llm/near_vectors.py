"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank on original vectors.

1. Equal vectors of one label are one class with a count; only classes are compared.
2. A rotation is learned on a bounded sample (``SAMPLE`` vectors): unit vectors less their mean are
   projected to at most ``BITS`` principal axes, then rotated so that they lie close to the corners of
   a cube (iterative quantisation), which makes the signs balanced bits.
3. The bits are cut into ``TABLES`` parts, each the key of a Hamming table. A class is stored under its
   own key in each table and looks up every key that it could share with a partner. Which these are
   follows from its distances to the planes, without loss: projections do not lengthen differences, so
   partners with cosine c satisfy sum over bits that differ of (y * y + z * z) <= 2 - 2c; in one of the tables
   at least the sum is no more than its share of this, and one side of the pair has at most half of that.
   So a key is looked up if the squares of the flipped coordinates stay below (1 - c) / TABLES.
4. Label, length, table and the first bits of the key make a block. A vector is sent to its own block and to
   those that its lookups reach; within a block the whole keys are matched, the pairs found are reranked
   by their cosine on original vectors in double precision. A block that holds more rows than a task's
   fair share is split in a grid of homes and lookups, all pairs of which meet in just one of its parts.
5. A pair may be found several times; it counts where it is found first by (table, smaller key), which
   both sides' coordinates tell. Each block returns one count a vector and a forest of its links, never pairs;
   components of the forests' edges are the classes' components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do rows whose label or id is null. Vectors of unequal length never link. Repeated rows are vectors of
their own: equal vectors of a label link with each other. A row without id has no component and is kept. Very long vectors
only make the sample smaller. An empty table gives an empty result. Only id, vector and label are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .words import cut, reachable_by_workers, salted_join, tidy

BITS, TABLES, STEPS = 64, 4, 50
#: Numbers in the sample that the rotation is learned on; vectors of a block that share the first bits of a key, on average.
SAMPLE, BLOCK = 1_280_000, 512
#: Rows of a block that is never split; pairs that are reranked at a time.
FAIR, PAIRS = 4096, 1 << 16
#: Above the rounding of projections.
SLACK = 1e-9


class Rotation:
    """Mean, projection and table parts, learned on unit vectors."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, steps: int = STEPS, seed: int = 7):
        self.size = sample.shape[1]
        self.mean = sample.mean(0)
        centred = sample - self.mean
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : min(bits, self.size)]
        y = centred @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(steps):  # the nearest corners, then the rotation that is nearest to them
            u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        self.axes = np.linalg.qr(axes @ turn)[0]
        self.axes *= np.sign((self.axes * (axes @ turn)).sum(0))
        self.parts = [p for p in np.array_split(np.arange(self.axes.shape[1]), TABLES) if len(p)]

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Coordinates [n, bits]; vectors of another length lose coordinates or have zeros, which lengthens no difference either."""
        if unit.shape[1] != self.size:
            unit = np.pad(unit[:, : self.size], ((0, 0), (0, max(0, self.size - unit.shape[1]))))
        # row by row, so that every task finds the same last digit
        return np.einsum("ij,jk->ik", unit - self.mean, self.axes)


def reached(y: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own) of all keys whose flipped coordinates' squares sum to the budget at most; bit j of a key is the sign of column j."""
    home = ((y >= 0).astype(np.int64) << np.arange(y.shape[1])).sum(1)
    row, key, left = np.arange(len(y)), home.copy(), np.full(len(y), budget)
    for j in range(y.shape[1]):
        after = left - y[row, j] ** 2
        flip = after >= 0
        row, key, left = np.concatenate((row, row[flip])), np.concatenate((key, key[flip] ^ (1 << j))), np.concatenate((left, after[flip]))
    return row, key, key == home[row]


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1)[:, None]


_BASE = "id {}, key binary, label binary, size int, v binary"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids with their class (hash of label and vector); key is null for a vector that takes no part."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        key, label, size, v = [], [], [], []
        for i in range(batch.num_rows):
            x = np.array(vectors[i].values.to_numpy(zero_copy_only=False), float) if vectors[i].is_valid and labels[i].is_valid and ids[i].is_valid else np.empty(0)
            if not len(x) or not np.isfinite(x).all() or not x.any():
                key.append(None), label.append(None), size.append(None), v.append(None)
                continue
            named, x = labels[i].as_py().encode(), x + 0.0  # no negative zeros
            if not 1e-100 < np.abs(x).max() < 1e100:
                x = x / np.abs(x).max()
            key.append(blake2b(x.tobytes(), digest_size=16, key=blake2b(named, digest_size=32).digest()).digest())
            label.append(blake2b(named, digest_size=16).digest()), size.append(len(x)), v.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(key, pa.binary()), pa.array(label, pa.binary()), pa.array(size, pa.int32()), pa.array(v, pa.binary())], names=["id", "key", "label", "size", "v"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows of one length, 256 at most."""
    for batch in batches:
        size = batch.column("size").to_numpy()
        edges = sorted({*np.flatnonzero(np.diff(size)) + 1, *range(0, batch.num_rows, 256)})
        for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            yield part, unit_vectors(np.frombuffer(b"".join(part.column("v").to_pylist())).reshape(part.num_rows, -1))


def _block(label: bytes, size: int, table: int, prefix: int) -> bytes:
    return blake2b(b"%d %d %d" % (size, table, prefix), digest_size=16, key=label).digest()


def _targets(rotation: Rotation, budget: float, depth: int, part: pa.RecordBatch, unit: np.ndarray):
    """(row, table, block, own) of the blocks that vectors are sent to."""
    y, labels, sizes = rotation.of(unit), part.column("label").to_pylist(), part.column("size").to_pylist()
    for t, bits in enumerate(rotation.parts):
        for row, prefix, own in zip(*(c.tolist() for c in reached(y[:, bits[:depth]], budget)), strict=True):
            yield row, t, _block(labels[row], sizes[row], t, prefix), own


def _sizes(sent, budget: float, depth: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, unit in _slices(batches):
            _, _, block, own = zip(*_targets(sent.value, budget, depth, part, unit), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.binary()), pa.array(own, pa.bool_())], names=["block", "own"])

    return count


_SENT = pa.schema([("block", pa.binary()), ("tbl", pa.int32()), ("role", pa.int32()), ("key", pa.binary()), ("m", pa.int64()), ("v", pa.binary())])
HOME, LOOK = 1, 2


def _place(sent, budget: float, depth: int, split: dict[bytes, tuple[int, int]]):
    """Rows to their blocks; a split block has parts (i, j), where homes of share i meet lookups of share j."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, unit in _slices(batches):
            keys, counts, raw, rows = part.column("key").to_pylist(), part.column("m").to_pylist(), part.column("v").to_pylist(), []
            for row, t, block, own in _targets(sent.value, budget, depth, part, unit):
                if block not in split:
                    rows.append((block, t, HOME | LOOK if own else LOOK, row))
                    continue
                homes, looks = split[block]
                share = int.from_bytes(keys[row][:8], "little")
                mine, asked = share % homes, share // homes % looks
                cells = {(i, asked): LOOK for i in range(homes)}
                if own:
                    for j in range(looks):
                        cells[mine, j] = cells.get((mine, j), 0) | HOME
                rows += [(blake2b(b"%d %d" % cell, digest_size=16, key=block).digest(), t, role, row) for cell, role in cells.items()]
            block, table, role, at = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.binary()), pa.array(table, pa.int32()), pa.array(role, pa.int32()), pa.array([keys[i] for i in at], pa.binary()), pa.array([counts[i] for i in at], pa.int64()), pa.array([raw[i] for i in at], pa.binary())], schema=_SENT)

    return place


def _found(y: np.ndarray, homes: np.ndarray, looks: np.ndarray, bits: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (lookup, home) whose keys meet, as rows of y, in pieces of about PAIRS."""
    own = ((y[np.ix_(homes, bits)] >= 0).astype(np.int64) << np.arange(len(bits))).sum(1)
    order = np.argsort(own, kind="stable")
    homes, own = homes[order], own[order]
    for a in range(0, len(looks), 1024):
        asking = looks[a : a + 1024]
        row, key, _ = reached(y[np.ix_(asking, bits)], budget)
        low = np.searchsorted(own, key, "left")
        n = np.searchsorted(own, key, "right") - low
        row, low, n = row[n > 0], low[n > 0], n[n > 0]
        ends = np.cumsum(n)
        for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            at = np.arange(first, min(first + PAIRS, int(ends[-1])))
            entry = np.searchsorted(ends, at, "right")
            yield asking[row[entry]], homes[low[entry] + at - (ends[entry] - n[entry])]


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of linked nodes, in place; labels are the smallest node of a tree."""
    while True:
        x, y = label[a], label[b]
        if not (x != y).any():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _linked(rotation: Rotation, table: int, role: np.ndarray, keys: list[bytes], m: np.ndarray, raw: np.ndarray, cosine: float, budget: float):
    """(key, other key or None, links): a count of links for each vector that has any and the edges of a forest."""
    n = len(keys)
    norms = np.linalg.norm(raw, axis=1)
    y = rotation.of(raw / norms[:, None])
    place = np.empty(n, np.int64)
    place[sorted(range(n), key=keys.__getitem__)] = np.arange(n)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for p, h in _found(y, np.flatnonzero(role & HOME), np.flatnonzero(role & LOOK), rotation.parts[table], budget):
        p, h = p[p != h], h[p != h]
        close = np.einsum("ij,ij->i", raw[p], raw[h]) / (norms[p] * norms[h]) >= cosine
        p, h = p[close], h[close]
        differ = (y[p] >= 0) != (y[h] >= 0)
        mine, other = np.where(differ, y[p] ** 2, 0.0), np.where(differ, y[h] ** 2, 0.0)
        first = np.ones(len(p), bool)
        for bits in rotation.parts[:table]:
            first &= ~_within(mine[:, bits], budget) & ~_within(other[:, bits], budget)
        bits = rotation.parts[table]
        # in its table a pair counts at the lookup of the smaller key, unless only the other side's reaches
        first &= (place[p] < place[h]) | ~_within(other[:, bits], budget)
        p, h = p[first], h[first]
        np.add.at(links, p, m[h])
        np.add.at(links, h, m[p])
        hook(label, p, h)
    for i in np.flatnonzero(links):
        yield keys[i], None, int(links[i])
    for i in np.flatnonzero(label != np.arange(n)):
        yield keys[i], keys[label[i]], 0


def _within(squares: np.ndarray, budget: float) -> np.ndarray:
    """Whether a lookup reaches, by the same order of subtractions as ``reached``."""
    left = np.full(len(squares), budget)
    for j in range(squares.shape[1]):
        left = left - squares[:, j]
    return left >= 0


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def _link(sent, cosine: float, budget: float):
    def work(rows: list):
        table, role, keys, m, raw = zip(*rows, strict=True)
        return _linked(sent.value, table[0], np.array(role), list(keys), np.array(m), np.frombuffer(b"".join(raw)).reshape(len(raw), -1), cosine, budget)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now and rows:
                    out += work(rows)
                    rows = []
                now = block
                rows.append(row)
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if rows:
            out += work(rows)
        if out:
            yield _batch(out)

    return link


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _LINKS, strict=True)], schema=_LINKS)


def class_links(classes: DataFrame, cosine: float) -> DataFrame | None:
    """(a, b, n) over classes (key, label, size, v, m): n links of class a where b is null, else an edge; None without classes."""
    spark = classes.sparkSession
    common = classes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if common is None:
        return None
    most = max(256, SAMPLE // common["size"])
    sample = classes.where(F.col("size") == common["size"]).orderBy("key").limit(most).select("v").toArrow()["v"].to_pylist()
    rotation = Rotation(unit_vectors(np.frombuffer(b"".join(sample)).reshape(len(sample), -1)))
    budget = (1 - cosine) / len(rotation.parts) + SLACK
    largest = classes.groupBy("label", "size").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    depth = min(len(rotation.parts[0]), max(1, int(np.ceil(np.log2(max(1, largest / BLOCK))))))
    sent = spark.sparkContext.broadcast(rotation)  # at most BITS by the vectors' length
    rows = classes.select("key", "label", "size", "m", "v")
    counts = rows.mapInArrow(tidy(_sizes(sent, budget, depth)), "block binary, own boolean").groupBy("block").agg(F.count_if("own").alias("homes"), F.count("*").alias("looks"))
    counts = cut(counts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fair = max(FAIR, (counts.agg(F.sum("looks")).first()[0] or 0) // (4 * parts))
    split = {bytes(r["block"]): (-(-r["homes"] // fair) or 1, -(-r["looks"] // fair)) for r in counts.where(F.col("looks") > fair).collect()}  # at most 4 blocks a task
    placed = rows.mapInArrow(tidy(_place(sent, budget, depth, split)), "block binary, tbl int, role int, key binary, m long, v binary")
    dealt = placed.repartition("block").sortWithinPartitions("block")
    return cut(dealt.mapInArrow(tidy(_link(sent, cosine, budget)), "a binary, b binary, n long"))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id reachable by links) and kept (it is the own id) of every row."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    spark = vectors.sparkSession
    reachable_by_workers(spark)
    kind = vectors.schema[vec_id].dataType.simpleString()
    own = vectors.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    base = cut(own.mapInArrow(tidy(_classes), _BASE.format(kind)))
    sides = base.where("key IS NOT NULL")
    classes = cut(sides.groupBy("key").agg(F.first("label").alias("label"), F.first("size").alias("size"), F.first("v").alias("v"), F.count("*").alias("m"), F.min("id").alias("low")))
    found = class_links(classes, cosine)
    ids = classes.select("key", "m", "low")
    if found is not None:
        sums = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
        joined = cut(components(found.where("b IS NOT NULL")).withColumnRenamed("node", "key"))
        low = joined.join(ids, "key").groupBy("label").agg(F.min("low").alias("root"))
        # a component of very many vectors is dealt to all tasks
        roots = salted_join(joined, low, joined.groupBy("label").agg(F.count("*").alias("n")), "label", F.xxhash64("key")).select("key", "root")
        ids = ids.join(sums, "key", "left").join(roots, "key", "left")
    else:
        ids = ids.withColumns({"n": F.lit(0), "root": F.col("low")})
    ids = cut(ids.select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "low").alias("component_id"), "m"))
    # rows of one vector are dealt to all tasks
    met = salted_join(sides.select("id", "key"), ids.select("key", "n_links", "component_id"), ids.select("key", F.col("m").alias("n")), "key", F.monotonically_increasing_id())
    alone = base.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return met.select("id", "n_links", "component_id").unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
