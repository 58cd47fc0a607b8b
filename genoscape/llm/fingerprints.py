"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A text is the multiset of its paragraphs, which newlines part (a newline belongs to neither
side). Each paragraph's bytes are hashed to a wide vector of 512 bits and the vectors are summed modulo powers of
two, so the fingerprint does not depend on the order of paragraphs, and a paragraph is inserted
or deleted by one addition or subtraction (``combine``). For likeness, paragraphs that are not
blank are also cut into pieces, after words chosen by their hash, so that an edit changes only
the pieces it touches. A fingerprint holds

* the number of paragraphs and of pieces, modulo 2**32,
* ``WIDE`` sums modulo 2**64 to which every paragraph adds (equality), and
* ``LEVELS x LANES`` sums modulo 2**32 of which a piece adds to one: level k is drawn with
  probability 2**-(k+1). How many lanes of each level differ between two fingerprints
  tells how many pieces differ, at any length of text (likeness).

Defined results: a null text counts as empty; the empty text has no paragraph (a text of
newlines alone has blank ones), and two empty texts have likeness 1. Ids are whole numbers.
Rows that repeat are kept. Null ids come before all others, equal ids are taken in the order
of a hash of their texts. A lone document is its own next document. A very long text is one
row, held by one task with its next one. Only id and text are read, so other columns may have
any name. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, hash64, mix, reachable_by_workers, tidy, word_hashes

WIDE, LEVELS, LANES = 8, 8, 16
#: A piece ends after about one word in so many.
CUT_EVERY = 12
#: Words of a piece whose polynomial is taken; longer pieces are hashed as a whole.
CHAIN = 64
_PLACES = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(CHAIN + 1)], U64)
_NEWLINE, _EMPTY, _COUNT = U64(hash64(b"\n")), U64(hash64(b"")), 1 << 32


def paragraph_vectors(text: bytes) -> np.ndarray:
    """[paragraphs, WIDE]: independent bits for each sum, from a hash of the paragraph's bytes."""
    if not text:
        return np.empty((0, WIDE), U64)
    return np.frombuffer(b"".join(blake2b(p, digest_size=8 * WIDE).digest() for p in text.split(b"\n")), "<u8").reshape(-1, WIDE)


def pieces_of(text: bytes) -> np.ndarray:
    """64-bit hashes of the pieces of the paragraphs that are not blank, in order."""
    if not text:
        return np.empty(0, U64)
    words = word_hashes(text.replace(b"\n", b" \n ").split(b" "))  # a newline is a word of its own
    line = words == _NEWLINE
    ends = (words >> U64(32)) % U64(CUT_EVERY) == 0
    ends[np.flatnonzero(line) - 1] = True
    ends[-1] = True
    last = np.flatnonzero(ends & ~line)
    first = np.concatenate(([0], last[:-1] + 1))
    first += line[first]
    # a polynomial of each piece's words, whose places count from the piece's first
    length = last - first + 1
    place = np.minimum(np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words)))), CHAIN)
    values = words * _PLACES[place]
    values[line] = 0
    found = mix(np.add.reduceat(values, first) + length.astype(U64))
    for i in np.flatnonzero(length > CHAIN).tolist():
        found[i] = hash64(words[first[i] : last[i] + 1].tobytes())
    return found[(first < last) | (words[first] != _EMPTY)]


def sums_of(vectors: np.ndarray, pieces: np.ndarray, sign: int = 1):
    """((paragraphs, pieces), wide sums, lane sums); sign -1 deletes them."""
    wide = vectors.sum(axis=0, dtype=U64)
    lanes = np.zeros(LEVELS * LANES, np.uint32)
    if len(pieces):
        low = pieces & U64((1 << (LEVELS - 1)) - 1)
        level = np.where(low == 0, LEVELS - 1, np.log2((low & (~low + U64(1))).astype(np.float64) + (low == 0)).astype(np.int64))
        at = level * LANES + ((pieces >> U64(20)) % U64(LANES)).astype(np.int64)
        np.add.at(lanes, at, (mix(pieces ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32))
    if sign < 0:
        return (-len(vectors) % _COUNT, -len(pieces) % _COUNT), U64(0) - wide, np.uint32(0) - lanes
    return (len(vectors), len(pieces)), wide, lanes


def text_sums(text: bytes, sign: int = 1):
    return sums_of(paragraph_vectors(text), pieces_of(text), sign)


def combine(a, b):
    """The sums of the union of two multisets; with sums_of(..., -1), of the difference."""
    return ((a[0][0] + b[0][0]) % _COUNT, (a[0][1] + b[0][1]) % _COUNT), a[1] + b[1], a[2] + b[2]


def written(sums) -> str:
    counts, wide, lanes = sums
    return base64.b64encode(np.array(counts, "<u4").tobytes() + wide.astype("<u8").tobytes() + lanes.astype("<u4").tobytes()).decode()


def read_back(fingerprint: str):
    raw = base64.b64decode(fingerprint)
    return tuple(np.frombuffer(raw[:8], "<u4").tolist()), np.frombuffer(raw[8 : 8 + 8 * WIDE], "<u8"), np.frombuffer(raw[8 + 8 * WIDE :], "<u4")


_SHARE = np.repeat(0.5 ** np.minimum(np.arange(1, LEVELS + 1), LEVELS - 1), LANES) / LANES


def likeness(a, b) -> float:
    """Estimated share of the pieces that two texts have in common, 0 to 1; 1 if the fingerprints are equal."""
    mine, other = a[0][1], b[0][1]
    total = mine + other
    differ = a[2] != b[2]
    if a[0] == b[0] and not differ.any() and np.array_equal(a[1], b[1]):
        return 1.0
    if not total:
        return 0.0
    least = max(1, abs(mine - other))
    guesses = np.unique(np.linspace(least, max(least, total), 80))
    rate = guesses[:, None] * _SHARE[None, :]
    fit = np.where(differ[None, :], np.log(-np.expm1(-rate) + 1e-300), -rate).sum(axis=1)
    return float(min(1.0, max(0.0, 1.0 - guesses[int(np.argmax(fit))] / total)))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DEALT = pa.schema([("part", pa.int32()), ("ghost", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("packed", pa.binary())])
_LOW = -(1 << 63)


def _edges(quantiles: list[int], total: int, nulls: int) -> list[tuple[bool, int, int]]:
    """Lower ends (id is not null, id, hash of the text) of ranges with about as many rows each; an id that fills several is cut by the hash."""
    count = Counter((True, q) for q in quantiles)
    if nulls:
        count[False, 0] = max(1, round(len(quantiles or [0]) * nulls / total))
    return sorted({(False, 0, _LOW)} | {(*key, _LOW + (j << 64) // m) for key, m in count.items() for j in range(m)})


def _part(edges: list, i: int | None, h: int) -> tuple[int, tuple]:
    key = (i is not None, i or 0, h)
    return max(0, bisect_right(edges, key) - 1), key


def _lowest(edges: list):
    """Each range's first row, as far as a batch shows it."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part, key = _part(edges, i, h)
                found[part] = min(key, found.get(part, key))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([k[c] for k in found.values()], t) for c, t in enumerate((pa.bool_(), pa.int64(), pa.int64())))], names=["part", "known", "id", "h"])

    return low


def _dealer(edges: list, first: dict[int, tuple]):
    """Rows to ranges of (id, hash); the first row of a range goes to the range before it too, as a ghost."""
    held = sorted(first)
    before = {part: held[k - 1] for k, part in enumerate(held)}  # the last range comes before the first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        sent = set()
        for batch in batches:
            rows = []
            for i, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed = press(text or b"")
                part, key = _part(edges, i, h)
                rows.append((part, False, i, h, packed))
                if key == first[part] and part not in sent:
                    sent.add(part)
                    rows.append((before[part], True, i, h, packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _DEALT, strict=True)], schema=_DEALT) if rows else pa.RecordBatch.from_pylist([], _DEALT)

    return deal


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    held = None  # (part, id, text, sums) of the row that waits for its next document
    done = True
    for batch in batches:
        out = []
        for part, ghost, i, _, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ghost and (done or held[0] != part):
                continue
            raw = unpack(packed)
            text, sums = raw.decode("utf-8", "replace"), text_sums(raw)
            if not done and held[0] == part:
                out.append(_row(held, text, sums))
            held, done = (part, i, text, sums), ghost
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)


def _row(held, next_text: str, next_sums):
    _, i, text, sums = held
    n = len(text)
    edited = (text[: n - n // 2] + next_text[: n // 2]).encode("utf-8", "replace")
    new = text_sums(edited)
    return i, n, hashlib.sha256(edited).hexdigest(), written(sums), written(new), likeness(sums, new), likeness(sums, next_sums)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the head of the next document by id.

    One shuffle: compressed texts are dealt to ranges of ids (and, within an id that fills several, of the text's
    hash), whose edges are quantiles of the id column; the first document of a range is sent to the range before it as well.
    """
    spark = docs.sparkSession
    reachable_by_workers(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(text)).alias("h"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * n
    found = own.agg(F.percentile_approx("doc_id", [k / parts for k in range(parts)], 20 * parts).alias("q"), F.count("*").alias("total"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    edges = _edges(found["q"] or [], found["total"], found["nulls"])
    lowest = own.select("doc_id", "h").mapInArrow(tidy(_lowest(edges)), "part int, known boolean, id long, h long").groupBy("part").agg(F.min(F.struct("known", "id", "h")).alias("first"))
    first = {r["part"]: tuple(r["first"]) for r in lowest.collect()}  # one row a range
    dealt = own.mapInArrow(tidy(_dealer(edges, first)), "part int, ghost boolean, doc_id long, h long, packed binary")
    ordered = dealt.repartitionById(n, F.col("part") % n).sortWithinPartitions("part", "ghost", F.asc_nulls_first("doc_id"), "h", "packed")
    return ordered.mapInArrow(tidy(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
