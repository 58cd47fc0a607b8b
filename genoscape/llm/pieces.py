"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is marked (each space becomes the piece marker, one marker is put in front) and cut
into the pieces whose log scores have the largest sum. Pieces are found by walking a
double-array trie of their UTF-8 bytes; a character that no piece covers falls back to one
piece for each of its bytes. Decoding joins the pieces' bytes, turns markers to spaces and
takes the front marker off, so that it returns every text exactly: a marker character that
stands in a text itself is always encoded by its bytes.

The best path of a text is the concatenation of the best paths of its chunks (a word with
the markers before it, a newline), because no piece holds a marker after another character
and none holds a newline; both are checked when a vocabulary is loaded. Chunks repeat, so
their paths are kept in a bounded table, and the missing ones of a batch are searched
together: one step of the trie moves all of them. Long ones are walked on their own.

Log scores: a unigram vocabulary brings its own. In a merge vocabulary (piece_bpe_32k.model)
the scores are merge ranks; there a piece's log score is that of Zipf's law,
-log(rank + 1) - log(H), which is documented here as this operator's reading of the file.

Defined results: a null text counts as empty and has no pieces. Paths that tie: the one whose
last piece is longer. Very long texts and words take time in proportion to their length.
Repeated rows are kept, an empty table gives an empty result, columns other than the id and
the text are not read and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import TABLE_LIMIT, reachable_by_workers, tidy

MARK = "▁".encode()
#: Below the worst piece by so much is a character that falls back to its bytes.
FALLBACK_PENALTY = 10.0
#: Chunks above this many bytes are walked one by one.
LONG = 2048
_RUN = re.compile(rb" *[^ \n]+|\n| +")


class DoubleArrayTrie:
    """base/check arrays over byte strings; the root is state 0, ``value[state]`` is a key's number or -1."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = {}
        for number, key in enumerate(keys):
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends[node] = number
        size = 2 * len(children) + 512
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        hints: dict[int, int] = {}  # where the search for so many children ended last
        state, queue = {0: 0}, [0]
        for node in queue:
            s = state[node]
            self.value[s] = ends.get(node, -1)
            if not children[node]:
                continue
            out = sorted(children[node])
            base = hints.get(len(out), 1)
            while any(taken[base + c] for c in out):
                base += 1
                if base + 256 >= len(taken):
                    more = len(taken)
                    taken += bytes(more)
                    self.base, self.check, self.value = (np.concatenate((a, np.full(more, fill, np.int32))) for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
            self.base[s] = hints[len(out)] = base
            for c in out:
                taken[base + c] = 1
                self.check[base + c] = s
                state[children[node][c]] = base + c
                queue.append(children[node][c])

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The next state of each, or -1."""
        to = self.base[states] + data
        to = np.minimum(to, len(self.check) - 1)
        return np.where((self.check[to] == states) & (to > 0), to, -1)


class Vocabulary:
    """Pieces with log scores, byte pieces included."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, ids: list[int], byte_ids: list[int]):
        if any(MARK in p.lstrip(MARK) and MARK in re.sub(b"^(?:" + MARK + b")+", b"", p) or b"\n" in p for p in pieces):
            raise ValueError("a piece crosses a marker or holds a newline; chunks can't be encoded apart")
        self.trie, self.scores = DoubleArrayTrie(pieces), np.asarray(scores, float)
        self.ids, self.byte_ids = np.array(ids, np.int32), np.array(byte_ids, np.int32)
        self.worst = float(self.scores.min()) - FALLBACK_PENALTY
        self.pieces = {**dict(zip(ids, (p.replace(MARK, b" ") for p in pieces), strict=True)), **{i: bytes([b]) for b, i in enumerate(byte_ids)}}
        self.numbers = list(range(int(max(self.ids.max(), self.byte_ids.max())) + 1))  # one object for each id, shared by all paths
        self.longest = max(map(len, pieces))
        self.table: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a .model file of the sentencepiece library; rank scores become log scores by Zipf's law."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        own = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        given = np.array([sp.get_score(i) for i in own])
        ranked = bool(np.all(given == np.round(given)))
        scores = -np.log(np.arange(1, len(own) + 1)) - np.log(np.sum(1 / np.arange(1, len(own) + 1))) if ranked else given
        return cls([sp.id_to_piece(i).encode() for i in own], scores, own, byte_ids)

    def search(self, chunks: list[bytes]) -> list[tuple[int, ...]]:
        """The best path of each chunk, all chunks at once; ties go to the path whose last piece is longer."""
        out: list[tuple[int, ...]] = [()] * len(chunks)
        marked = [re.sub(rb" ", MARK, c.replace(MARK, b"\xff" * 3)) for c in chunks]
        by_size: dict[int, list[int]] = {}
        for k, c in enumerate(marked):
            if len(c) > LONG:
                out[k] = self._walk(c)
                continue
            by_size.setdefault(max(8, 1 << (len(c) - 1).bit_length()) if c else 0, []).append(k)
        for width, group in by_size.items():
            most = max(1, 600_000 // max(1, width))
            for a in range(0, len(group) if width else 0, most):
                part = group[a : a + most]
                for k, path in zip(part, self._search([marked[k] for k in part]), strict=True):
                    out[k] = path
        return out

    def _search(self, chunks: list[bytes]) -> list[tuple[int, ...]]:
        sizes = np.array([len(c) for c in chunks])
        width = int(sizes.max())
        data = np.zeros((width, len(chunks)), np.uint8)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        row = np.repeat(np.arange(len(chunks)), sizes)
        data[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
        #: \xff stands three times for a marker in the text itself: no piece has it, and its first byte opens a character.
        opens = (data & 0xC0) != 0x80
        opens[1:] &= ~((data[1:] == 0xFF) & (data[:-1] == 0xFF) & self._inside(data))
        long = np.select([data >= 0xFE, data >= 0xF0, data >= 0xE0, data >= 0xC0], [3, 4, 3, 2], 1)
        best = np.full((width + 1, len(chunks)), -np.inf)
        best[0] = 0
        came = np.zeros((width + 1, len(chunks)), np.int32)  # bytes of the last piece
        piece = np.full((width + 1, len(chunks)), -1, np.int32)
        for s in range(width):
            at = np.flatnonzero((sizes > s) & opens[s] & (best[s] > -np.inf))
            if not len(at):
                continue
            end = np.minimum(s + long[s, at], sizes[at])
            self._offer(best, came, piece, at, end, best[s, at] + self.worst, end - s, -1)
            states, live = np.zeros(len(at), np.int64), at
            for e in range(s, min(width, s + self.longest)):
                inside = sizes[live] > e
                live, states = live[inside], states[inside]
                states = self.trie.step(states, data[e, live])
                live, states = live[states >= 0], states[states >= 0]
                if not len(live):
                    break
                number = self.trie.value[states]
                ends = number >= 0
                if ends.any():
                    who, number = live[ends], number[ends]
                    self._offer(best, came, piece, who, np.full(len(who), e + 1), best[s, who] + self.scores[number], e + 1 - s, number)
        paths: list[list] = [[] for _ in chunks]
        for k, at in enumerate(sizes.tolist()):
            path = paths[k]
            while at:
                n, p = int(came[at, k]), int(piece[at, k])
                raw = chunks[k][at - n : at]
                path.append((self.numbers[self.ids[p]],) if p >= 0 else tuple(self.numbers[self.byte_ids[b]] for b in (MARK if raw == b"\xff" * 3 else raw)))
                at -= n
        return [tuple(chain.from_iterable(reversed(p))) for p in paths]

    def _walk(self, chunk: bytes) -> tuple[int, ...]:
        """The same path of one long chunk, byte by byte: the time grows with its length."""
        n = len(chunk)
        best, came, piece = array("d", [-np.inf]) * (n + 1), array("i", bytes(4)) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        base, check, value, scores, top = *(array("i", a.tobytes()) for a in (self.trie.base, self.trie.check, self.trie.value)), array("d", self.scores.tobytes()), len(self.trie.check)
        s = 0
        while s < n:
            lead = chunk[s]
            step = min(n, s + (3 if lead >= 0xFE else 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1))
            while step < n and lead < 0xFE and chunk[step] & 0xC0 == 0x80:  # a stray continuation belongs to the character before it
                step += 1
            here = best[s]
            if here + self.worst > best[step]:
                best[step], came[step], piece[step] = here + self.worst, step - s, -1
            state, e = 0, s
            while e < n:
                to = base[state] + chunk[e]
                if to >= top or to <= 0 or check[to] != state:
                    break
                state, e = to, e + 1
                if (number := value[state]) >= 0 and here + scores[number] > best[e]:
                    best[e], came[e], piece[e] = here + scores[number], e - s, number
            s = step
        path, at = [], n
        while at:
            size, p = came[at], piece[at]
            raw = chunk[at - size : at]
            path.append((self.numbers[self.ids[p]],) if p >= 0 else tuple(self.numbers[self.byte_ids[b]] for b in (MARK if raw == b"\xff" * 3 else raw)))
            at -= size
        return tuple(chain.from_iterable(reversed(path)))

    @staticmethod
    def _inside(data: np.ndarray) -> np.ndarray:
        """For rows 1 on: whether a byte of a run of \\xff isn't the first of its three."""
        run = np.zeros(data.shape[1], np.int64)
        out = np.zeros((len(data) - 1, data.shape[1]), bool)
        for s, line in enumerate(data):
            run = np.where(line == 0xFF, run + 1, 0)
            if s:
                out[s - 1] = run % 3 != 1
        return out

    @staticmethod
    def _offer(best, came, piece, who, end, score, size, number) -> None:
        better = score > best[end, who]
        end, who = end[better], who[better]
        pick = lambda x: x[better] if isinstance(x, np.ndarray) else x
        best[end, who], came[end, who], piece[end, who] = pick(score), pick(size), pick(number)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        cut = [chunks_of(t) for t in texts]
        out: list[list[int]] = []
        missing: dict[bytes, None] = {}
        waiting: list[list[bytes]] = []

        def settle() -> None:
            new = list(missing)
            self.table.update(zip(new, self.search(new), strict=True))
            out.extend(list(chain.from_iterable(map(self.table.__getitem__, chunks))) for chunks in waiting)
            for c in new:
                if len(c) > LONG:  # they hardly come again
                    del self.table[c]
            missing.clear()
            waiting.clear()
            if len(self.table) > TABLE_LIMIT:  # two generations: what isn't used again goes with the older
                self.old, self.table = self.table, {}

        for chunks in cut:
            waiting.append(chunks)
            for c in chunks:
                if c not in self.table:
                    if (path := self.old.get(c)) is not None:
                        self.table[c] = path
                    else:
                        missing[c] = None
            if len(missing) > TABLE_LIMIT // 4:
                settle()
        settle()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))[1:]


def chunks_of(text: bytes) -> list[bytes]:
    """Words with the spaces before them and newlines, with one space put in front."""
    if not text:
        return []
    return _RUN.findall(b" " + text)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, pieces (array of ids, if keep), n_pieces, n_fallback (byte pieces), pieces_sha256 (of the ids as
    little-endian 32-bit integers) and round_trip (decoding gives the text's bytes) of every document; no shuffle."""
    reachable_by_workers(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        is_byte = np.zeros(max(words.pieces) + 1, np.int64)
        is_byte[words.byte_ids] = 1
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                texts = [t or b"" for t in batch.column(1).to_pylist()]
                coded = words.encode(texts)
                arrays = [np.array(c, "<i4") for c in coded]
                columns = [pa.array([len(x) for x in arrays], pa.int64()), pa.array([int(is_byte[x].sum()) for x in arrays], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in arrays], pa.string()), pa.array([words.decode(c) == t for c, t in zip(coded, texts, strict=True)], pa.bool_())]
                if keep:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
                    columns.insert(0, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, "<i4"), *arrays]), pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *["pieces"] * keep, "n_pieces", "n_fallback", "pieces_sha256", "round_trip"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tidy(encode), f"doc_id {kind}, {'pieces array<int>, ' * keep}n_pieces long, n_fallback long, pieces_sha256 string, round_trip boolean")


def decode_pieces(coded: DataFrame, path: str, doc_id: str = "doc_id", pieces: str = "pieces") -> DataFrame:
    """doc_id and text from arrays of ids; a null array gives a null text."""
    reachable_by_workers(coded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else words.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = coded.schema[doc_id].dataType.simpleString()
    return coded.select(F.col(doc_id).alias("doc_id"), F.col(pieces).cast("array<int>").alias("pieces")).mapInArrow(tidy(decode), f"doc_id {kind}, text string")
