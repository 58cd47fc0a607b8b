"""License scans: matching statistics of a generalised suffix automaton, chained into template spans.

The automaton accepts every substring of the licence templates, over word ids. A file is
streamed through it once; at each word the automaton gives the longest suffix of the words
read so far that occurs in some template (the matching statistic), and suffix links give the
longest one for each template. Matches that cannot be extended and have at least ``MIN_MATCH``
words are chained by dynamic programming over all their places in the template: a chain keeps
the order of the template, leaves gaps of at most ``MAX_GAP`` words of the file, and covers as
many template words as it can (overlaps count once). A chain is a covered span of the file
with a share of its template. A match only looks back over the gap and itself, so the work
grows with the file. Words outside the templates' vocabulary end every match, so the automaton
only walks runs of vocabulary words that are long enough.

Base labels come from short phrases whose words stand consecutively (all places count).
The chains add labels of their own: a template labels a file if one chain covers
``MIN_SHARE`` of it. ``score`` is the largest covered share, at least 0.5 where a base
phrase stands, 0 where nothing is found. Spans are the chains that cover ``MIN_SHARE``,
the best first, which share no word of the file with another span of their template.

Defined results: a null text counts as empty and has no labels (empty strings, null
positions). Of chains that cover as much the one that ends first counts. Very long texts are
scanned whole, one at a time. Repeated rows are kept, an empty table gives an empty result,
columns other than the id and the text are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import reachable_by_workers, tidy

MIN_MATCH, MAX_GAP, MIN_SHARE = 4, 12, 0.5

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The words of public licence notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised over several sequences of ids; ``where[state]`` maps a sequence to the end positions in it."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.where: list[dict[int, set[int]]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence):
                last = self._extend(last, word)
                self.where[last].setdefault(k, set()).add(end)
        down = sorted(range(1, len(self.link)), key=self.longest.__getitem__)
        for state in reversed(down):
            up = self.where[self.link[state]]
            for k, ends in self.where[state].items():
                up.setdefault(k, set()).update(ends)
        #: of each state and sequence, the nearest state on the way to the root that occurs in it
        self.nearest = np.zeros((len(self.link), len(sequences)), np.int64)
        for state in down:
            self.nearest[state] = self.nearest[self.link[state]]
            self.nearest[state, list(self.where[state])] = state

    def _state(self, longest: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.longest.append(longest)
        self.where.append({})
        return len(self.link) - 1

    def _split(self, below: int, child: int, word: int) -> int:
        """A clone of child that ends just where below is followed by word."""
        clone = self._state(self.longest[below] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = clone
        while below >= 0 and self.next[below].get(word) == child:
            self.next[below][word] = clone
            below = self.link[below]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (child := self.next[last].get(word)) is not None:
            return child if self.longest[child] == self.longest[last] + 1 else self._split(last, child, word)
        new = self._state(self.longest[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            child = self.next[last][word]
            self.link[new] = child if self.longest[child] == self.longest[last] + 1 else self._split(last, child, word)
        return new

    def statistics(self, ids) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match that ends here) at each id."""
        state = length = 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                length = 0
            yield state, length


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP):
        self.labels = list(templates)
        texts = [words_of(t.encode()) for t in templates.values()]
        self.sizes = [len(t) for t in texts]
        self.ids: dict[bytes, int] = {}
        for word in [w for t in texts for w in t] + [w for p in phrases for w in p.encode().split()]:
            self.ids.setdefault(word, len(self.ids) + 1)
        self.known = {w for t in texts for w in t}
        self.automaton = SuffixAutomaton([[self.ids[w] for w in t] for t in texts])
        self.longest = np.array(self.automaton.longest)
        self.phrases = [([self.ids[w] for w in p.encode().split()], label) for p, label in phrases.items()]
        self.min_match, self.max_gap = min_match, max_gap

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, end in the template) of matches that cannot be extended, for each of their places, by last word."""
        least = np.minimum(self.min_match, self.sizes)
        padded = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
        starts, ends = np.flatnonzero(np.diff(padded) == 1), np.flatnonzero(np.diff(padded) == -1)
        long = ends - starts >= least.min()
        found = []
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state, length = np.array(list(self.automaton.statistics(ids[a:b].tolist())), np.int64).T
            near = self.automaton.nearest[state]
            size = np.where(near == state[:, None], length[:, None], self.longest[near])
            stops = np.concatenate((size[1:] <= size[:-1], np.ones((1, size.shape[1]), bool)))
            for at, k in zip(*map(np.ndarray.tolist, np.nonzero(stops & (size >= least))), strict=True):
                found += [(k, a + at - int(size[at, k]) + 1, a + at, end) for end in sorted(self.automaton.where[int(near[at, k])][k])]
        return found

    def best_chains(self, items: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
        """Of matches (first, last, end) of one template, by last word: the words covered by the best chain that ends with each, and the match before it (or -1)."""
        value, back = [], []
        for m, (first, last, end) in enumerate(items):
            own = last - first + 1
            most, before = own, -1
            for j in range(m - 1, -1, -1):
                f, at, e = items[j]
                if at < first - 1 - self.max_gap:
                    break
                gain = own - max(0, at - first + 1, e - (end - own))
                if e < end and f < first and gain > 0 and value[j] + gain > most:
                    most, before = value[j] + gain, j
            value.append(most)
            back.append(before)
        return value, back

    def chains(self, ids: np.ndarray) -> tuple[float, list[tuple[str, int, int, int, float]]]:
        """The largest share that a chain covers, and (label, first word, last word, covered template words, share) of the spans."""
        by_template: dict[int, list] = {}
        for k, *item in self.matches(ids):
            by_template.setdefault(k, []).append(tuple(item))
        best, spans = 0.0, []
        for k, items in by_template.items():
            value, back = self.best_chains(items)
            best = max(best, max(value) / self.sizes[k])
            taken = None
            for m in sorted(range(len(items)), key=lambda x: (-value[x], items[x][1])):
                if value[m] < MIN_SHARE * self.sizes[k]:
                    break
                taken = np.zeros(len(ids), bool) if taken is None else taken
                path, at = [], m
                while at >= 0 and not taken[items[at][0] : items[at][1] + 1].any():
                    path.append(at)
                    at = back[at]
                if not path:
                    continue
                first, last = items[path[-1]][0], items[m][1]
                covered = value[m] - value[path[-1]] + items[path[-1]][1] - first + 1
                if covered >= MIN_SHARE * self.sizes[k]:
                    taken[first : last + 1] = True
                    spans.append((self.labels[k], first, last, covered, covered / self.sizes[k]))
        return best, sorted(spans)

    def base(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(first word, label) of each place of a phrase."""
        found = []
        for words, label in self.phrases:
            n = len(ids) - len(words) + 1
            if n > 0:
                here = ids[:n] == words[0]
                for k, word in enumerate(words[1:], 1):
                    here &= ids[k : n + k] == word
                found += [(int(at), label) for at in np.flatnonzero(here)]
        return sorted(found)

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.int64, len(words)) if len(words) < 3 else np.array(list(map(self.ids.get, words, [0] * len(words))), np.int64)
        base, (best, spans) = self.base(ids), self.chains(ids)
        labels = {label for _, label in base}
        added = {c[0] for c in spans}
        return {
            "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | added)),
            "score": max(0.5 * bool(base), best),
            "spans": [{"label": c[0], "first_word": c[1], "last_word": c[2], "covered": c[3], "share": c[4]} for c in spans],
        }


_SCANNER: list[Scanner] = []
_SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,covered:bigint,share:double>>"
_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    for batch in batches:
        found = [_SCANNER[0].scan(t or b"") for t in batch.column(1).to_pylist()]
        columns = [pa.array([x[f.name] for x in found], f.type) for f in _OUT]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_OUT.names])


def licence_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, positions, labels, score and the covered template spans of every document; no shuffle."""
    reachable_by_workers(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tidy(_scan), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {_SPANS}")
