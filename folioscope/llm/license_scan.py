"""Licence scan with a positional index of rare words.

Pass one counts, over all documents, how many hold each word of the templates: the licence words' IDF. Pass two
looks up each document's highest-IDF licence words in the templates' postings, lets each hit vote for the
place where the template would begin, weighs the words that stand at the right relative positions, and then
verifies the template's mandatory key phrases there. Words and their hashes are found with array operations over
many texts at once; only documents that hold a template's rare words are looked at one by one.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are scanned alike; an
empty table gives an empty result; long texts are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import BASE, UNBASE, Rolling, arrow_map, bytes_of, chunks, power_pair, powers

# Fixed values of the contract: the base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices by which public licences are named, with the phrases that must stand in them.
TEMPLATES = (
    ("mit", "permission is granted under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "obtaining a copy of this software")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "in compliance with the license")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "with or without modification")),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0",)),
    # Sentences of the licences' own texts.
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("without restriction", "sublicense and or sell copies")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions of the software",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("distributed under the license", "without warranties or conditions of any kind")),
    ("apache-2", "see the license for the specific language governing permissions and limitations under the license", ("governing permissions and limitations under the license",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("must retain the above copyright notice",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("must reproduce the above copyright notice",)),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "appear in all copies")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("must not be misrepresented",)),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
)
#: A template begins a search from so many of its highest-IDF words.
ANCHORS = 3
#: Share of a template's IDF that must stand at the right places.
ACCEPT = 0.75

VOCABULARY = tuple(sorted({w for _, t, keys in TEMPLATES for w in (t + " " + " ".join(keys)).split()} | {w for p in BASE_PHRASES for w in p.split()}))


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    n = len(data) + 1
    return Rolling(data, powers(n, BASE), powers(n, UNBASE)).spans(np.concatenate([[0], ends[:-1]]), ends)


def firsts_of(hashes: np.ndarray) -> np.ndarray:
    """Where in sorted hashes those begin that have each value of the upper 16 bits."""
    return np.searchsorted(hashes >> np.uint64(48), np.arange((1 << 16) + 1))


class Words:
    """The words of many texts: for each its text, its number within the text, and its place in VOCABULARY or -1."""

    order = np.argsort(_hashes(list(VOCABULARY)))
    sorted_hashes = _hashes(list(VOCABULARY))[order]
    longest = max(len(w) for w in VOCABULARY)
    firsts = firsts_of(sorted_hashes)

    def __init__(self, raw: np.ndarray, at: np.ndarray, up: np.ndarray, down: np.ndarray):
        if not len(raw):
            self.counts = np.zeros(len(at) - 1, np.int64)
            self.vocab, self.text, self.number = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        low = np.where((raw >= 0x41) & (raw <= 0x5A), raw + 0x20, raw).astype(np.uint8)
        word = ((low >= 0x30) & (low <= 0x39)) | ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
        begins[edges] |= word[edges]
        ends[edges - 1] |= word[edges - 1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, at)
        self.counts = np.diff(first)
        some = np.flatnonzero(stop - start <= self.longest)
        found = Rolling(low, up, down).spans(start[some], stop[some])
        hit, spot = self._looked_up(found)
        some = some[hit]
        self.vocab = self.order[spot].astype(np.int32)
        self.text = np.searchsorted(first, some, side="right") - 1
        self.number = some - first[self.text]

    def _looked_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are sorted ones, and their places there."""
        upper = (found >> np.uint64(48)).astype(np.int64)
        spot, stop = self.firsts[upper], self.firsts[upper + 1]
        open_, out = np.flatnonzero(spot < stop), np.full(len(found), -1)
        while len(open_):
            same = self.sorted_hashes[spot[open_]] == found[open_]
            out[open_[same]] = spot[open_[same]]
            open_ = open_[~same]
            spot[open_] += 1
            open_ = open_[spot[open_] < stop[open_]]
        hit = np.flatnonzero(out >= 0)
        return hit, out[hit]


def _tables(parts, finder=Words):
    """(part, Words) for slices of Arrow batches with a text column at 1; finder: Words or a class like it."""
    for part in parts:
        raw, at = bytes_of(part.column(1))
        yield part, finder(raw, at, *power_pair(len(raw) + 1))


def _slices(batches):
    for batch in batches:
        yield from chunks(batch, "text", 1 << 20)


def _frequencies(batches):
    total, n = np.zeros(len(VOCABULARY), np.int64), 0
    for part, words in _tables(_slices(batches)):
        pairs = np.unique(words.text.astype(np.int64) * len(VOCABULARY) + words.vocab)
        total += np.bincount(pairs % len(VOCABULARY), minlength=len(VOCABULARY))
        n += part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(VOCABULARY)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["word", "n"])


def idf_of(docs: DataFrame) -> np.ndarray:
    """IDF of each word of VOCABULARY over all documents; only these sums reach the driver."""
    rows = arrow_map(docs.select("doc_id", "text"), _frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = dict((r["word"], r["n"]) for r in rows)
    return np.array([np.log((n.get(-1, 0) + 1) / (n.get(k, 0) + 1)) + 1e-6 for k in range(len(VOCABULARY))])


class Index:
    """Postings of the templates' words, and the phrases to verify, as numbers of VOCABULARY."""

    def __init__(self, idf: np.ndarray):
        number = {w: k for k, w in enumerate(VOCABULARY)}
        self.idf = idf
        self.templates = [np.array([number[w] for w in t.split()]) for _, t, _ in TEMPLATES]
        self.keys = [[[number[w] for w in p.split()] for p in keys] for _, _, keys in TEMPLATES]
        self.weights = [idf[t] for t in self.templates]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            rare = sorted({*t.tolist()}, key=lambda w: (-idf[w], w))[:ANCHORS]
            for place, w in enumerate(t.tolist()):
                if w in rare:
                    self.postings.setdefault(w, []).append((k, place))
        self.anchor = np.zeros(len(VOCABULARY), bool)
        self.anchor[list(self.postings)] = True
        self.base = [([number[w] for w in p.split()], label) for p, label in BASE_PHRASES.items()]

    def scan(self, numbers: np.ndarray, vocab: np.ndarray) -> dict[str, float]:
        """Labels and their scores for one text's licence words."""
        at = dict(zip(numbers.tolist(), vocab.tolist(), strict=True))
        begins = {(k, n - place) for n, w in at.items() for k, place in self.postings.get(w, ())}
        found: dict[str, float] = {}
        for k, begin in begins:
            template, weights = self.templates[k], self.weights[k]
            here = [at.get(begin + j) == w for j, w in enumerate(template.tolist())]
            score = float(weights[here].sum() / weights.sum())
            if score >= ACCEPT and all(self._holds(at, key, begin, len(template)) for key in self.keys[k]):
                label = TEMPLATES[k][0]
                found[label] = max(found.get(label, 0.0), score)
        return found

    @staticmethod
    def _holds(at: dict[int, int], key: list[int], begin: int, size: int) -> bool:
        return any(all(at.get(begin + j + i) == w for i, w in enumerate(key)) for j in range(-2, size + 3 - len(key)))


def _scan(batches, idf: np.ndarray):
    index = Index(idf)
    for part, words in _tables(_slices(batches)):
        n = part.num_rows
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        own: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in index.base:
            size, hit = len(phrase), np.ones(max(0, len(words.vocab) - len(phrase) + 1), bool)
            for j, w in enumerate(phrase):
                stop = len(words.vocab) - size + 1 + j
                hit &= (words.vocab[j:stop] == w) & (words.text[j:stop] == words.text[: len(hit)]) & (words.number[j:stop] == words.number[: len(hit)] + j)
            text, number = words.text[: len(hit)][hit], words.number[: len(hit)][hit]
            np.add.at(n_base, text, 1)
            np.minimum.at(first, text, number)
            np.maximum.at(last, text, number)
            for t in np.unique(text).tolist():
                own[t].add(label)
        scores, labels = [1.0 if x else 0.0 for x in own], [set(x) for x in own]
        bounds = np.searchsorted(words.text, np.arange(n + 1))
        for t in np.unique(words.text[index.anchor[words.vocab]]).tolist():
            got = index.scan(words.number[bounds[t] : bounds[t + 1]], words.vocab[bounds[t] : bounds[t + 1]])
            labels[t] |= got.keys()
            scores[t] = min(1.0, max([scores[t], *got.values()]))
        none = n_base == 0
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(words.counts, pa.int64()), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in own]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(scores, pa.float64())],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    idf = idf_of(docs)
    return arrow_map(docs.select("doc_id", "text"), _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", idf)


def op5(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
