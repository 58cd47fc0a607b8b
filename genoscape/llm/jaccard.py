"""N-gram Jaccard join: sets in a prefix tree, probed with shared overlaps and length bounds.

Two documents link if ``den * |A & B| >= num * |A | B|`` for their sets of word n-grams.
Sets are held in one global order, rare n-grams first (a coarse frequency from all
classes, then the hash), in which two linked sets must share an n-gram among their first
``n - ceil(num * n / den) + 1``. Equal sets are one class from the start. The steps:

1. n-grams are counted over one document of each class; those counted twice get a level in a table;
2. each class gives the n-grams of its prefix that occur elsewhere, in sorted runs with a number of
   the class; classes that share one are joined to clusters (no pairs are made, each hangs on the smallest);
3. a cluster's sets, ordered by size, are cut into blocks of ``BLOCK``. The sets of a pair
   of blocks are stored in a prefix tree; each set walks it level by level, a node's
   overlap is added to that of its parent once for all sets below, and subtrees are
   pruned in which even all that remains cannot reach the bound. Sets that are already
   connected are not compared again, and a task returns only a spanning forest of links;
4. blocks meet themselves and the next block first. Further pairs of blocks, if their sizes
   can link at all, are only joined where they are not yet one component;
5. components of the links, with the smallest id of each.

So thousands of near copies cost work in proportion to their number, no task holds more
than two blocks, and nothing is dropped or capped.

Defined results: null texts and texts without words have the empty set, link with nothing
and are their own component. With fewer words than n the whole sequence is the one n-gram.
Rows that repeat, also with one id, are one class; the component of a row with a null id is
the smallest id of its component, else null. Very long texts are sets like all others, held
by one task at a time. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .repeats import repeated, sharing
from .sketches import Levels, bloom_of, levels_of
from .words import U64, cut, reachable_by_workers, salted_join, stored, text_hashes, tidy, window_hashes

BLOCK = 512
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams."""
    hashes = text_hashes((text or b"").translate(_LOWER))
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, min(n, len(hashes))))


def signature(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def in_order(found: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (sorted by hash) in the global order, and their levels."""
    level = levels.of(found)
    by = np.argsort(level, kind="stable")
    return found[by], level[by]


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def links(a: int, b: int, shared: int, num: int, den: int) -> bool:
    return den * shared >= num * (a + b - shared)


def need(a: int, b: int, num: int, den: int) -> int:
    """The smallest overlap with which sets of sizes a and b link."""
    return -(-num * (a + b) // (num + den))


class PrefixTree:
    """A radix tree over sorted lists of ranks; long edges are split so that bounds are tested on the way."""

    STEPS = (16, 48, 160, 1 << 62)

    def __init__(self, lists: list[np.ndarray]):
        order = sorted(range(len(lists)), key=lambda k: lists[k].tolist())
        self.parent, self.depth = [-1], [0]
        self.node_of = np.zeros(len(lists), np.int64)
        path, before, size = [0], np.empty(0, np.int64), 0
        for k in order:
            mine = lists[k]
            m = min(len(mine), len(before))
            differ = np.flatnonzero(mine[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            top = path[-1]
            while self.depth[path[-1]] > common:
                top = path.pop()
            if self.depth[path[-1]] < common:  # an edge is cut where the lists part
                path.append(self._insert(path[-1], common))
                self.parent[top] = path[-1]
            at, i = common, 0
            while at < len(mine):
                step = min(len(mine) - at, self.STEPS[min(i, len(self.STEPS) - 1)])
                path.append(self._insert(path[-1], at + step))
                at, i = at + step, i + 1
            self.node_of[k] = path[-1]
            before = mine
        # where each node's own cells lie: the stretch of any list below it between its parent's depth and its own
        n = len(self.parent)
        self.parent, self.depth = np.array(self.parent), np.array(self.depth)
        owner = np.full(n, -1)
        for k in order:
            node = self.node_of[k]
            while node > 0 and owner[node] < 0:
                owner[node] = k
                node = self.parent[node]
        self.start, self.stop, cells = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for node in range(1, n):
            piece = lists[owner[node]][self.depth[self.parent[node]] : self.depth[node]]
            self.start[node], size = size, size + len(piece)
            self.stop[node] = size
            cells.append(piece)
        self.cells = np.concatenate([np.empty(0, np.int64), *cells])
        sizes = np.array([len(x) for x in lists])
        self.least, self.most = np.full(n, 1 << 62), np.zeros(n, np.int64)
        np.minimum.at(self.least, self.node_of, sizes)
        np.maximum.at(self.most, self.node_of, sizes)
        level = np.zeros(n, np.int64)
        up = self.parent.copy()
        while (up >= 0).any():
            level += up >= 0
            np.minimum.at(self.least, up[up >= 0], self.least[np.flatnonzero(up >= 0)])
            np.maximum.at(self.most, up[up >= 0], self.most[np.flatnonzero(up >= 0)])
            up = np.where(up >= 0, self.parent[np.maximum(up, 0)], -1)
        by = np.argsort(level, kind="stable")
        self.by_level = np.split(by, np.cumsum(np.bincount(level))[:-1])

    def _insert(self, up: int, depth: int) -> int:
        self.parent.append(up)
        self.depth.append(depth)
        return len(self.parent) - 1

    def overlaps(self, mark: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Overlap of each node's path with the marked ranks, -1 in pruned subtrees."""
        shared = np.full(len(self.parent), -1, np.int64)
        shared[0] = 0
        #: smallest overlap that any list below could need, from its smallest size that could link at all
        floor = -(-num * (size + np.maximum(self.least, -(-num * size // den))) // (num + den))
        for nodes in self.by_level[1:]:
            nodes = nodes[shared[self.parent[nodes]] >= 0]
            nodes = nodes[(self.most[nodes] * den >= num * size) & (self.least[nodes] * num <= size * den)]
            if not len(nodes):
                break
            length = self.stop[nodes] - self.start[nodes]
            first = np.cumsum(length) - length
            at = np.arange(int(length.sum())) - np.repeat(first - self.start[nodes], length)
            found = np.add.reduceat(mark[self.cells[at]], first, dtype=np.int64)
            found += shared[self.parent[nodes]]
            remain = np.minimum(self.most[nodes] - self.depth[nodes], size - found)
            shared[nodes] = np.where(found + remain >= floor[nodes], found, -1)
        return shared


def forest(lists: list[np.ndarray], labels: list, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of linking sets that connect what links and isn't connected by labels yet; lists hold ranks in global order."""
    tree = PrefixTree(lists)
    sizes = np.array([len(x) for x in lists])
    numbers = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    top = np.array([numbers[x] for x in labels])
    mark = np.zeros(int(max((x.max() for x in lists if len(x)), default=0)) + 1, bool)
    out = []
    for k, mine in enumerate(lists):
        if (top == top[k]).all():
            break
        mark[mine] = True
        shared = tree.overlaps(mark, len(mine), num, den)[tree.node_of]
        mark[mine] = False
        hit = np.flatnonzero((shared >= 0) & (den * shared >= num * (len(mine) + sizes - shared)))
        for j in hit.tolist():
            if top[j] != top[k]:
                out.append((k, j))
                top[top == top[j]] = top[k]
    return out


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _join_blocks(num: int, den: int):
    def solve(rows) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        sets = [np.frombuffer(r[1], U64) for r in rows]
        # ranks follow the global order, which is that of the key (level, hash)
        keys = np.concatenate(sets)
        level = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows])
        by = np.lexsort((keys, level))
        fresh = np.concatenate(([True], keys[by][1:] != keys[by][:-1]))
        rank = np.empty(len(keys), np.int64)
        rank[by] = np.cumsum(fresh) - 1
        lists = np.split(rank, np.cumsum([len(s) for s in sets])[:-1])
        pairs = forest(lists, [r[3] for r in rows], num, den)
        if not pairs:
            return None
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k, _ in pairs], pa.binary()), pa.array([rows[j][0] for _, j in pairs], pa.binary())], schema=_EDGE)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for cluster, i, j, sig, tokens, level, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (cluster, i, j):
                    if found := solve(rows):
                        yield found
                    key, rows = (cluster, i, j), []
                rows.append((sig, tokens, level, label))
        if found := solve(rows):
            yield found

    return join


def near_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, k (row key) and stays (is it the first of its component) of every document; a link is a
    Jaccard index of num/den or more of word n-grams. Rows that are equal in id and text share k and stays."""
    spark = docs.sparkSession
    reachable_by_workers(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("k"), F.col(text).cast("binary").alias("t"), F.col(doc_id).alias("doc_id"))

    def signed(batches):
        for batch in batches:
            sizes, sigs = [], []
            for t in batch.column(1).to_pylist():
                found = shingles(t, n)
                sizes.append(len(found))
                sigs.append(signature(found) if len(found) else None)
            numbers = [None if s is None else int.from_bytes(s[:8], "little", signed=True) for s in sigs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(numbers, pa.int64())], names=["k", "doc_id", "n_shingles", "sig", "number"])

    rows = cut(own.mapInArrow(tidy(signed), f"k long, doc_id {kind}, n_shingles long, sig binary, number long"))
    classes = cut(rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("k").alias("k"), F.first("n_shingles").alias("n"), F.first("number").alias("number")))
    made = bloom_of(classes, "k", classes.count())
    firsts = spark.sparkContext.broadcast(made) if made is not None else None

    def of_classes(batch) -> Iterator[np.ndarray]:
        """Sets of the documents that stand for their class; a few copies may be among them (of too many classes all), which costs time alone."""
        pick = np.flatnonzero(firsts.value.has(batch.column(0).to_numpy().view(U64))) if firsts else np.arange(batch.num_rows)
        for i in pick.tolist():
            if len(found := shingles(batch.column(1)[i].as_py(), n)):
                yield found

    texts = own.select("k", "t")
    levels = spark.sparkContext.broadcast(levels_of(stored(repeated(texts, of_classes))))

    def heads(batch):
        """The n-grams of a set's prefix that may occur elsewhere, and its class."""
        for found in of_classes(batch):
            ordered, level = in_order(found, levels.value)
            size = prefix_length(len(found), num, den)
            yield ordered[:size][level[:size] > 0], int.from_bytes(signature(found)[:8], "little", signed=True)

    clusters = components(sharing(texts, heads))
    members = clusters.join(classes, clusters["node"] == F.col("number")).select("sig", F.col("label").alias("cluster"), "n", "k")
    place = F.row_number().over(W.partitionBy("cluster").orderBy("n", "sig")) - 1
    members = cut(members.withColumn("block", F.floor(place / BLOCK).cast("int")))

    # whole sets, only of the documents that stand for a class in a cluster
    bloom = bloom_of(members, "k", members.count())
    filt = spark.sparkContext.broadcast(bloom) if bloom is not None else None

    def whole(batches):
        held, keys = levels.value, filt.value if filt else None
        for batch in batches:
            k = batch.column(0).to_numpy()
            pick = np.flatnonzero(keys.has(k.view(U64))) if keys else np.arange(len(k))
            for a in range(0, len(pick), 200):
                at = pick[a : a + 200]
                out = [in_order(shingles(t, n), held) for t in batch.column(1).take(pa.array(at)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array([x.tobytes() for x, _ in out], pa.binary()), pa.array([x.tobytes() for _, x in out], pa.binary())], names=["k", "tokens", "levels"])

    sets = own.select("k", "t").mapInArrow(tidy(whole), "k long, tokens binary, levels binary").groupBy("k").agg(F.first("tokens").alias("tokens"), F.first("levels").alias("levels"))
    sets = cut(sets.join(members, "k").select("sig", "cluster", "block", "tokens", "levels"))
    blocks = members.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))

    def linked(pairs: DataFrame, held: DataFrame) -> DataFrame:
        """Links found in pairs (cluster, i, j) of blocks; held: sets with labels."""
        sides = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        sent = held.join(sides, ["cluster", "block"]).select("cluster", "i", "j", "sig", "tokens", "levels", "label")
        return cut(sent.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(tidy(_join_blocks(num, den)), "a binary, b binary"))

    own_pairs = blocks.select("cluster", F.col("block").alias("i"), F.col("block").alias("j"))
    next_pairs = blocks.where("block > 0").select("cluster", (F.col("block") - 1).alias("i"), F.col("block").alias("j"))
    edges = linked(own_pairs.unionByName(next_pairs), sets.withColumn("label", F.col("sig")))
    labels = components(edges)
    if (members.agg(F.max("block")).first()[0] or 0) >= 2:
        held = cut(sets.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
        mixed = held.groupBy("cluster", "block").agg(F.min("label").alias("first"), F.max("label").alias("last"))
        ends = blocks.join(mixed, ["cluster", "block"])
        one, two = ends.alias("one"), ends.alias("two")
        far = one.join(two, "cluster").where("two.block > one.block + 1").where(F.col("one.high") * den >= F.col("two.low") * num)
        far = far.where(~((F.col("one.first") == F.col("one.last")) & (F.col("two.first") == F.col("two.last")) & (F.col("one.first") == F.col("two.first"))))
        more = linked(far.select("cluster", F.col("one.block").alias("i"), F.col("two.block").alias("j")), held)
        if more.limit(1).count():
            labels = components(edges.unionByName(more))
    # a class and a component are named by their first row: by id, null last, then by key
    known = rows.where("sig IS NOT NULL").drop("number")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k")
    classes = known.groupBy("sig").agg(F.min(row).alias("low"), F.count("*").alias("n"))
    named = cut(classes.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    first = cut(named.groupBy("label").agg(F.min("low").alias("first"), F.count("*").alias("n")).select("label", F.col("first.doc_id").alias("low_id"), F.col("first.k").alias("low_k"), "n"))
    named = cut(salted_join(named.select("sig", "label", "n"), first.drop("n"), first.select("label", "n"), "label", F.xxhash64("sig")))
    joined = salted_join(known, named.select("sig", "low_id", "low_k"), named.select("sig", "n"), "sig", F.col("k"))
    out = joined.select("doc_id", "n_shingles", F.col("low_id").alias("component_id"), "k", (F.col("k") == F.col("low_k")).alias("stays"))
    return out.unionByName(rows.where("sig IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "k", F.lit(True).alias("stays")))
