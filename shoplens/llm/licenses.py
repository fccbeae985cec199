"""Licence scans with a positional index of rare words.

Templates are short licence notices with key phrases that must stand in a text. The index lists, for each template
word, the templates and positions where it stands. Inverse document frequencies are counted over the whole corpus.
In a file, the licence words are looked up from the rarest on; a posting fixes at which place of the file the template
would begin, and postings of different words are intersected by that relative position. A template is only looked at
where the rarest word of each of its key phrases occurs, and accepted if all key phrases stand there word for word and
enough of the template's weight lies at one place.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """base: the text is one phrase, and every place where it stands is reported."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


# Phrases and labels of the base scan.
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)

#: Notices of common licences, in the words by which people refer to them.
NOTICES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license version", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license version", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("bsd", "released under the bsd 3 clause license", ("bsd 3 clause license",)),
    Template("mpl", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("permission to use copy modify and or distribute",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
    Template("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution",)),
)

#: Bytes of words: digits, letters (A-Z become a-z) and all of characters beyond ASCII; anything else separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Share of a template's weight that must lie at one place.
COVERAGE = 0.6
#: Words by which places may differ that still count as one.
SLACK = 2

MATCHES = "array<struct<label:string,base:boolean,start:bigint,words:int,coverage:double>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class LicenseIndex:
    """Postings of template words with weights from document frequencies."""

    def __init__(self, templates: Sequence[Template], frequency: dict[bytes, int], documents: int):
        self.templates = list(templates)
        self.words = [t.text.encode().split() for t in templates]
        vocabulary = {w for ws in self.words for w in ws} | {w for t in templates for k in t.keys for w in k.encode().split()}
        self.weight = {w: 1 + math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary}
        self.total = [sum(self.weight[w] for w in ws) for ws in self.words]
        # Key phrases with their rarest word (first among equals) and its place in the phrase.
        self.keys = [[(k, *self._rarest(k)) for k in (key.encode().split() for key in t.keys)] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, ws in enumerate(self.words):
            for place, w in enumerate(ws):
                self.postings[w].append((number, place))
        # Templates by their rarest key word: what a file's rare words lead to.
        self.led = defaultdict(list)
        for number, keys in enumerate(self.keys):
            self.led[max((k[1] for k in keys), key=lambda w: (self.weight[w], w))].append(number)
        self.postings = dict(self.postings)

    def _rarest(self, phrase: list[bytes]) -> tuple[bytes, int]:
        place = max(range(len(phrase)), key=lambda k: (self.weight[phrase[k]], -k))
        return phrase[place], place

    def scan(self, words: list[bytes]) -> list[dict]:
        """What is found in a file, by label, place and template."""
        weight, at = self.weight, defaultdict(list)
        for place, w in enumerate(words):
            if w in weight:
                at[w].append(place)
        out = []
        for rare in sorted(at, key=lambda w: (-weight[w], w)):
            for number in self.led.get(rare, ()):
                out += self._matches(number, words, at)
        return sorted(out, key=lambda m: (m["start"], m["label"], not m["base"], m["words"]))

    def _matches(self, number: int, words: list[bytes], at: dict[bytes, list[int]]) -> Iterator[dict]:
        template, own = self.templates[number], self.words[number]
        for phrase, rarest, place in self.keys[number]:
            if not any(p >= place and words[p - place:p - place + len(phrase)] == phrase for p in at.get(rarest, ())):
                return
        # Where would the template begin, by each word of the file that it has?
        votes: dict[int, dict[int, float]] = defaultdict(dict)
        for w in set(own) & at.keys():
            for n, place in self.postings[w]:
                if n == number:
                    for p in at[w]:
                        votes[p - place][place] = self.weight[w]
        if template.base:
            for start in sorted(votes):
                if len(votes[start]) == len(own):
                    yield {"label": template.label, "base": True, "start": start, "words": len(own), "coverage": 1.0}
            return
        best = (0.0, 0)
        for start in sorted(votes):
            near: dict[int, float] = {}
            for shift in range(SLACK + 1):
                near.update(votes.get(start + shift, {}))
            share = min(sum(near.values()) / self.total[number], 1.0)
            best = max(best, (share, -start))
        if best[0] >= COVERAGE:
            yield {"label": template.label, "base": False, "start": max(-best[1], 0), "words": len(own), "coverage": best[0]}


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many texts each word of the vocabulary stands, and how many texts there are.

    What comes to the driver is bounded by the vocabulary.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = defaultdict(int), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                texts += 1
                for w in vocabulary.intersection(words_of(text or b"")):
                    counts[w] += 1
        counts[b""] = texts
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         names=["word", "n"])
    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {bytes(r.word): r.n for r in rows}
    return found, found.pop(b"", 0)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            templates: Sequence[Template] = BASE + NOTICES) -> DataFrame:
    """id_col, n_words and matches: label, base, start (word), words (of the template), coverage.

    A null text counts as empty: no words, no matches. Every row gives one row, repeated rows included; an empty table
    gives none. Other columns are not read. A template with several equal best places is reported at the first.
    """
    vocabulary = {w for t in templates for part in (t.text, *t.keys) for w in part.encode().split()}
    index = LicenseIndex(templates, *document_frequencies(docs, vocabulary, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()),
                                   ("words", pa.int32()), ("coverage", pa.float64())]))
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                counts.append(len(words))
                found.append(index.scan(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)],
                                             names=["id", "n_words", "matches"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, matches {MATCHES}").withColumnRenamed("id", id_col)
