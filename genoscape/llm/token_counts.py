"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

No id is ever made. The steps:

1. documents become units: pre-tokens, if the tokenizer file's steps are ones that Spark's own
   functions follow (``native_pattern``) and the text is plain (ASCII and Latin letters, where
   both engines' tables agree, without the start of a special string); else words between
   white space, if the tokenizer keeps such words apart (checked when it is loaded by comparing
   joint and separate pre-tokenisation); else the whole text. Units are counted where they lie
   and summed over all documents, so each distinct unit is one row;
2. the pieces of each distinct pre-token are counted once, by the tokenizer's own model; words
   and whole texts become pre-token frequencies first, whose counts are joined and summed;
3. the counts of the most frequent units, as many as fit ``BROADCAST_BYTES`` (by whole powers of
   two of their frequency), are sent to all tasks and joined to the documents' units; units that
   stand there are summed at once. The others are few by their frequency: each document's rare
   units are shuffled once and meet their counts by a join;
4. what a document has of both is summed.

Special strings inside a text count as one token, as the library does.

Defined results: null is the empty text, which has 0 tokens. Very long texts are units like
all others, so only their distinct units travel. Repeated rows are kept, an empty table gives
an empty result, columns other than id and text are not read and may have any name.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import reachable_by_workers, stored, tidy

#: Largest size of the table of frequent units that is sent to all tasks.
BROADCAST_BYTES = 16 << 20
#: Signs that Java's, Python's and the library's tables treat alike: ASCII and Latin letters, without the dotted capital I.
PLAIN = r"\A[\x00-\x7E\u00A1-\u012F\u0131-\u024F]*\z"
WORD = r"[^\x20\x09-\x0D]+"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level signs by rule: printable bytes stand for themselves, the others follow from U+0100 on.
_BYTE_SIGNS = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Pieces:
    """A tokenizer file of the ``tokenizers`` library: pre-tokens of texts, pieces of pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_start = min(special, key=len)[:2] if special and len({x[:2] for x in special}) == 1 else None
        sample = ["a'll", "x1,", "<b", "7é"]
        self.apart = self.pre_tokens(" \n".join(sample)) == [p for w in sample for p in self.pre_tokens(w)]
        self.native_pattern = self._native_pattern(path, special)

    def _native_pattern(self, path: str, special: list[str]) -> str | None:
        """The file's split pattern, if its steps are NFC, white space, lower case, that split, byte level; else None."""
        spec = json.loads(Path(path).read_text())
        steps = [[x["type"] for x in ((spec.get(k) or {}).get(part) or [])] for k, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if steps != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or (special and not self.special_start):
            return None
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if not (split["invert"] and split["behavior"] == "Removed" and "Regex" in split["pattern"]) or level["add_prefix_space"] or level["use_regex"]:
            return None
        return split["pattern"]["Regex"]

    def pre_tokens(self, text: str) -> list[str]:
        tok = self.tokenizer
        text = tok.normalizer.normalize_str(text) if tok.normalizer else text
        return [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(text)] if tok.pre_tokenizer else [text]

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Special strings in a text, and how often each pre-token stands in the rest."""
        parts, found = [text], 0
        if self.special and (found := len(self.special.findall(text))):
            parts = self.special.split(text)
        return found, Counter(p for part in parts if part for p in self.pre_tokens(part))

    def count(self, pre: str) -> int:
        return len(self.tokenizer.model.tokenize(pre))


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def byte_level(pre: str) -> str:
    """A pre-token as the library's byte-level step writes it."""
    return pre if pre.isascii() and pre.isprintable() else pre.encode().decode("latin-1").translate(_BYTE_SIGNS)


#: A unit that is not a pre-token itself has this in front; pre-tokens hold no white space.
ROUGH = " "


def _with_units(own: DataFrame, pieces: Pieces, text) -> DataFrame:
    """own with ``plain`` and ``units``: an array of the units of a text."""
    plain = F.lit(False)
    if pieces.native_pattern:
        plain = text.rlike(PLAIN)
        if pieces.special_start:
            plain = plain & ~text.contains(pieces.special_start)
    rough = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)) if pieces.apart else F.array(text)
    fine = F.regexp_extract_all(F.lower(text), F.lit(pieces.native_pattern or "."), F.lit(0))
    return own.select("*", plain.alias("plain")).withColumn("units", F.when(F.col("plain"), fine).otherwise(rough))


def _marked(unit):
    return F.when(F.col("plain"), unit).otherwise(F.concat(F.lit(ROUGH), unit))


def unit_counts(units: DataFrame, path: str) -> DataFrame:
    """u, f (how often, over all documents) and n (tokens) of each distinct unit of rows (u)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                n, special, parts = [], [], []
                for u in batch.column(0).to_pylist():
                    found, frequency = pieces.frequencies(u[1:]) if u.startswith(ROUGH) else (0, None)
                    n.append(pieces.count(byte_level(u)) if frequency is None else None)
                    special.append(found)
                    parts.append([{"p": p, "m": m} for p, m in (frequency or {}).items()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(special, pa.int64()), pa.array(parts, pa.list_(pa.struct([("p", pa.string()), ("m", pa.int64())])))], names=["u", "f", "n", "special", "parts"])

    def count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.count(p) for p in batch.column(0).to_pylist()], pa.int64())], names=["p", "each"])

    distinct = units.groupBy("u").agg(F.count("*").alias("f"))
    held = stored(distinct.mapInArrow(tidy(count), "u string, f long, n long, special long, parts array<struct<p:string,m:bigint>>"))
    done, rough = held.where("n IS NOT NULL").select("u", "f", "n"), held.where("n IS NULL")
    if rough.isEmpty():
        return done
    parts = rough.select("u", F.explode("parts").alias("x")).select("u", "x.*")
    counted = parts.select("p").distinct().mapInArrow(tidy(count_parts), "p string, each long")
    sums = parts.join(counted, "p").groupBy("u").agg(F.sum(F.col("m") * F.col("each")).alias("n"))
    more = rough.drop("n").join(sums, "u", "left").select("u", "f", (F.col("special") + F.coalesce("n", F.lit(0))).alias("n"))
    return stored(done.unionByName(more))


def _frequent_from(counts: DataFrame) -> int:
    """The least power of two of a frequency such that all units from it on fit BROADCAST_BYTES."""
    level = F.floor(F.log2(F.col("f").cast("double"))).cast("int")
    sizes = {r["level"]: r["b"] for r in counts.groupBy(level.alias("level")).agg(F.sum(F.octet_length("u") + 32).alias("b")).collect()}  # at most 63 rows
    least, held = 63, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > BROADCAST_BYTES:
            break
        least = k
    return least


def token_counts(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document."""
    reachable_by_workers(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), t).alias("k"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    own = _with_units(own, pieces_of(path), F.col("text")).drop("text")
    counts = unit_counts(own.select("plain", F.explode_outer("units").alias("u")).select(_marked(F.col("u")).alias("u")).where("u IS NOT NULL"), path)  # an inner explode would look for empty arrays before, and make the units twice
    least = 1 << min(62, _frequent_from(counts))
    frequent = F.broadcast(counts.where(F.col("f") >= least).select("u", "n"))
    # the first unit of a document counts it: equal documents are one group of several
    spread = own.select("doc_id", "k", "n_bytes", "plain", F.posexplode_outer("units").alias("at", "u"))
    met = spread.withColumn("u", _marked(F.col("u"))).join(frequent, "u", "left")
    by, rows = ["doc_id", "k", "n_bytes"], (F.coalesce("at", F.lit(0)) == 0).cast("long")
    # of each document one row for all units that are met, one for each rare unit; summed where they lie, before the shuffle
    sums = met.groupBy(*by, F.when(F.col("n").isNull(), F.col("u")).alias("u")).agg(F.sum("n").alias("n"), F.sum(rows).alias("rows"), F.count("*").alias("m"))
    rare = counts.where(F.col("f") < least).select("u", F.col("n").alias("each"))
    # null keys would all go to one task; what is summed has n, so whatever it meets is not looked at
    apart = F.coalesce("u", F.concat(F.lit(ROUGH * 2), F.col("k").cast("string")))
    sums = sums.withColumn("u", apart).join(rare, "u", "left").groupBy(*by).agg(F.sum(F.coalesce("n", F.col("m") * F.col("each"), F.lit(0))).alias("n"), F.sum("rows").alias("rows"))
    each = (F.col("n") / F.col("rows")).cast("long")
    return sums.select("doc_id", "n_bytes", each.alias("n_tokens"), (each > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("__nth")).drop("__nth")
