"""Licence notices by a positional index of rare words.

Licence templates share a vocabulary of some hundred words. How many documents hold each word is
counted over the whole corpus, and every template ranks its own words by inverse document frequency.
Files are indexed by these words: a posting is a place of a word. A mandatory phrase of a template is
looked up by its rarest words first: their postings, moved by the words' places in the phrase, are
intersected, so that most templates end at a word that no file of a block holds. What is left is
intersected with the phrase's other words until it stands there word for word. Phrases of one
template must lie at their distance, some words more or less, and not behind a negation.
Independently, plain licence names are found wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voilage.llm import words as W
from voilage.llm.shared import documents_only

SLACK = 8  # words that may be added or missing between two phrases of a notice
REACH = 4  # words before a notice in which a negation takes it back
MENTION, NOTICE = 0.2, 0.5  # scores of a name alone, and of the mandatory phrases alone
# fixed values: names of licences, their notices with the phrases that must stand, identifiers, names
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NEGATIONS = ("not", "never", "no", "cannot", "nor", "neither", "isn", "aren", "wasn")
NOTICES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
        ("under the apache license", "in compliance with the license"),
    ),
    ("apache", "licensed under the apache license version 2 0", ("under the apache license",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more "
        "details",
        ("free software you can redistribute it and or modify it", "terms of the gnu general public license"),
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("under the gnu general public license",)),
    ("gpl", "under the terms of the gnu general public license", ("under the terms of the gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("under the terms of the gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("under the terms of the gnu affero general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution",
        ("redistribution and use in source and binary forms", "permitted provided that the following conditions are met"),
    ),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("under a creative commons attribution 4 0 international license",),
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license",),
    ),
    (
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        ("under the terms of the eclipse public license",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely",
        ("permission is granted to anyone to use this software", "to alter it and redistribute it freely"),
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
        ("to any person or organization obtaining a copy of the software",),
    ),
)
#: what follows a licence identifier, and the label it means
IDENTIFIERS = (
    ("mit", "mit"), ("apache 2 0", "apache"), ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"),
    ("agpl 3 0", "agpl"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("mpl 2 0", "mpl"), ("epl 1 0", "epl"), ("epl 2 0", "epl"),
    ("isc", "isc"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("bsl 1 0", "boost"), ("cc by 4 0", "cc-by"), ("cc by nc 4 0", "cc-by-nc"),
)
#: names of licences as they are given after "under"; alone they are only mentioned
NAMES = (
    ("mit license", "mit"), ("apache license", "apache"), ("gpl v3", "gpl"), ("gplv3", "gpl"), ("gpl v2", "gpl"), ("gplv2", "gpl"), ("gnu gpl", "gpl"),
    ("gnu general public license", "gpl"), ("gnu lgpl", "lgpl"), ("lgpl v3", "lgpl"), ("lgplv3", "lgpl"),
    ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"), ("agplv3", "agpl"), ("bsd license", "bsd"),
    ("mozilla public license", "mpl"), ("eclipse public license", "epl"), ("isc license", "isc"), ("zlib license", "zlib"),
    ("boost software license", "boost"), ("cc by 4 0", "cc-by"), ("cc by nc", "cc-by-nc"), ("creative commons attribution", "cc-by"),
)
TEMPLATES = (
    *NOTICES,
    *((label, f"spdx license identifier {name}", (f"spdx license identifier {name}",)) for name, label in IDENTIFIERS),
    *((label, f"{verb} under {the}{name}", (f"under {the}{name}",)) for name, label in NAMES for verb in ("released",) for the in ("", "the ")),
)
_SPELLED = [*(text for _, text, _ in TEMPLATES), *(p for p, _ in BASE), *(n for n, _ in NAMES), *NEGATIONS]
VOCABULARY = tuple(sorted({w for text in _SPELLED for w in text.split()}))
_NUMBER = {w: i for i, w in enumerate(VOCABULARY)}


def _split(column: pa.Array) -> tuple[np.ndarray, W.Words]:
    data, offsets = W.buffer_of(column)
    return data, W.split(data, offsets, W.outside(W.NOT_ALNUM), W.lower(), places=True)


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the vocabulary in order, and the word number of each."""
    found = W.split(*W.buffer_of(pa.array(VOCABULARY)), W.outside(W.NOT_ALNUM))
    order = np.argsort(found.hashes)
    return found.hashes[order], order


def numbers(data: np.ndarray, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (among all words of the column) and numbers of the vocabulary's words, checked by their bytes."""
    keys, number = _hashes()
    spot = np.minimum(np.searchsorted(keys, found.hashes), len(keys) - 1)
    at = np.flatnonzero(keys[spot] == found.hashes)
    told = number[spot[at]]
    body, width = W.lower()[data], np.array([len(w) for w in VOCABULARY])
    good = found.ends[at] - found.starts[at] == width[told]
    letters = np.zeros((len(VOCABULARY), width.max()), np.uint8)
    for i, w in enumerate(VOCABULARY):
        letters[i, : len(w)] = np.frombuffer(w.encode(), np.uint8)
    for i in range(width.max()):
        inside = i < width[told]
        good &= ~inside | (body[np.minimum(found.starts[at] + i, len(body) - 1)] == letters[told, i])
    return at[good], told[good]


# --- the index ---------------------------------------------------------------------------


def _numbers(text: str) -> np.ndarray:
    return np.array([_NUMBER[w] for w in text.split()])


@dataclass(frozen=True)
class Template:
    label: str
    words: np.ndarray
    phrases: tuple[tuple[int, np.ndarray], ...]  # place in the template, words

    @classmethod
    def of(cls, label: str, text: str, phrases: tuple[str, ...]) -> Template:
        if not 1 <= len(phrases) <= 2:
            raise ValueError("a template has one or two mandatory phrases")
        at = [f" {text} ".index(f" {p} ") for p in phrases]
        return cls(label, _numbers(text), tuple((text[:i].count(" "), _numbers(p)) for i, p in zip(at, phrases)))


_TEMPLATES = [Template.of(*t) for t in TEMPLATES]
_BASE = [(_numbers(p), label) for p, label in BASE]
_NAMES = [(_numbers(n), label) for n, label in NAMES]
_NEGATIONS = _numbers(" ".join(NEGATIONS))
_GAP = max(len(t.words) for t in _TEMPLATES) + SLACK + REACH + 1  # places between two documents, so that nothing spans them


def _among(sorted_places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted places are there."""
    if not len(sorted_places):
        return np.zeros(len(wanted), bool)
    spot = np.minimum(np.searchsorted(sorted_places, wanted), len(sorted_places) - 1)
    return sorted_places[spot] == wanted


class Postings:
    """Places of the vocabulary's words in a block of documents, which lie a gap apart."""

    def __init__(self, places: np.ndarray, told: np.ndarray, idf: np.ndarray) -> None:
        order = np.argsort(told, kind="stable")
        self.places, self.idf = places[order], idf
        self.edges = np.searchsorted(told[order], np.arange(len(VOCABULARY) + 1))

    def of(self, word: int) -> np.ndarray:
        return self.places[self.edges[word] : self.edges[word + 1]]

    def phrase(self, words: np.ndarray) -> np.ndarray:
        """Where the phrase starts: postings of its words, the rarest first, intersected by their relative places."""
        rarest = np.argsort(-self.idf[words], kind="stable").tolist()
        found = self.of(words[rarest[0]]) - rarest[0]
        for i in rarest[1:]:
            if not len(found):
                break
            found = found[_among(self.of(words[i]), found + i)]
        return found

    def notices(self, template: Template) -> np.ndarray:
        """Starts of the template where its phrases stand, at their distance, and nothing takes them back."""
        starts: dict[int, np.ndarray] = {}
        for at, words in sorted(template.phrases, key=lambda p: -self.idf[p[1]].max()):
            starts[at] = np.sort(self.phrase(words)) - at
            if not len(starts[at]):
                return starts[at]
        found, *others = (starts[at] for at, _ in template.phrases)
        for other in others:
            found = found[np.searchsorted(other, found - SLACK) < np.searchsorted(other, found + SLACK, "right")]
        return found[~self._taken_back(template, found)]

    def _taken_back(self, template: Template, starts: np.ndarray) -> np.ndarray:
        """Whether a negation that is no word of the template stands shortly before its first phrase."""
        first = template.phrases[0][0]
        gone = np.zeros(len(starts), bool)
        for word in _NEGATIONS.tolist():
            for i in range(first - REACH, first):
                if i < 0 or template.words[i] != word:
                    gone |= _among(self.of(word), starts + i)
        return gone

    def shares(self, template: Template, starts: np.ndarray) -> np.ndarray:
        """Share of the template's words that stand in place."""
        total = np.zeros(len(starts), np.int64)
        for i, word in enumerate(template.words.tolist()):
            total += _among(self.of(word), starts + i)
        return total / len(template.words)


@dataclass
class Findings:
    base_places: list[tuple[np.ndarray, str]]
    labels: list[tuple[np.ndarray, str, np.ndarray]]  # places, label, scores


def find(postings: Postings) -> Findings:
    """All findings of a block."""
    base = [(postings.phrase(words), label) for words, label in _BASE]
    labels = [(places, label, np.full(len(places), MENTION)) for places, label in base]
    for words, label in _NAMES:
        places = postings.phrase(words)
        labels.append((places, label, np.full(len(places), MENTION)))
    for template in _TEMPLATES:
        starts = postings.notices(template)
        if len(starts):
            # the start itself may lie before the text
            labels.append((starts + template.phrases[0][0], template.label, NOTICE + (1 - NOTICE) * postings.shares(template, starts)))
    return Findings(base, labels)


# --- over documents ------------------------------------------------------------------------


def _joined(rows: np.ndarray, labels: list[str], n: int) -> list[str]:
    sets: list[set[str]] = [set() for _ in range(n)]
    for row, label in zip(rows.tolist(), labels):
        sets[row].add(label)
    return [",".join(sorted(s)) for s in sets]


def _found(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            data, found = _split(part.column(1))
            n = len(part)
            places, told = numbers(data, found)
            row = np.searchsorted(found.bounds, places, "right") - 1
            first = found.bounds[:-1] + np.arange(n) * _GAP  # place of each document's first word
            seen = find(Postings(places + row * _GAP, told, idf))

            def rows_of(spots: np.ndarray) -> np.ndarray:
                return np.searchsorted(first - _GAP // 2, spots, "right") - 1

            base = np.concatenate([p for p, _ in seen.base_places])
            base_row = rows_of(base)
            base_labels = [label for p, label in seen.base_places for _ in range(len(p))]
            counts, lowest, highest = np.bincount(base_row, minlength=n), np.full(n, 1 << 62), np.full(n, -1)
            np.minimum.at(lowest, base_row, base - first[base_row])
            np.maximum.at(highest, base_row, base - first[base_row])
            label_row = rows_of(np.concatenate([p for p, _, _ in seen.labels]))
            score = np.zeros(n)
            np.maximum.at(score, label_row, np.concatenate([x for _, _, x in seen.labels]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(found.bounds)),
                    pa.array(counts.astype(np.int64)),
                    pa.array(lowest, pa.int64(), mask=counts == 0),
                    pa.array(highest, pa.int64(), mask=counts == 0),
                    pa.array(_joined(base_row, base_labels, n), pa.string()),
                    pa.array(_joined(label_row, [label for p, label, _ in seen.labels for _ in range(len(p))], n), pa.string()),
                    pa.array(score),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents hold each word of the vocabulary (word -1: all documents)."""
    for part in W.slices(batches):
        data, found = _split(part.column(1))
        places, told = numbers(data, found)
        row = np.searchsorted(found.bounds, places, "right") - 1
        words, n = np.unique(np.unique(row * len(VOCABULARY) + told) % len(VOCABULARY), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *words.tolist()], pa.int64()), pa.array([len(part), *n.tolist()], pa.int64())], names=["word", "n"]
        )


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The inverse document frequency of each word of the vocabulary, over all rows of ``docs``."""
    texts = documents_only(docs, "doc_id", "text")
    rows = texts.mapInArrow(_holding, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word
    held = {r["word"]: r["n"] for r in rows}
    return np.array([np.log((1 + held.get(-1, 0)) / (1 + held.get(i, 0))) for i in range(len(VOCABULARY))])


def scan(docs: DataFrame, idf: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``docs``: words, base places, labels and a score from 0 to 1.

    Words are runs of digits, letters and bytes beyond ASCII, with A-Z in lower case. A null or
    empty text has no words, no labels and the score 0. A name alone scores 0.2; a notice scores 0.5
    and half the share of its words that stand in place, so a whole one 1. A notice behind a negation
    counts as a mention of what it names. ``idf`` (by default counted over ``docs``) decides the order
    in which words are looked up, never what is found. Texts of any length are taken whole. Every row
    is looked at by itself: repeated rows have equal results, rows without doc_id are like any other.
    Columns besides doc_id and text are not looked at; an empty table gives an empty one.
    """
    idf = inverse_frequencies(docs) if idf is None else idf
    schema = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    )
    return documents_only(docs, "doc_id", "text").mapInArrow(_found(idf), schema)
