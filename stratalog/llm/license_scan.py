"""Licence scans by a positional index of rare words, in DataFrame functions only.

A licence is a template: its words and the key phrases that must stand in it verbatim. The index holds, for each key phrase, its two words
of highest inverse document frequency over all documents, with their places in the phrase. A file's words that are in the index are
looked up, each giving the places where a phrase could begin; the places that both words of a phrase agree on are its candidates, and
those where the whole phrase stands are kept. A template is found where its leading phrase stands, its other key phrases stand within
SLACK words of their relative places, and at least LEAST_SHARE percent of its words do.

All of it is one expression over the array of a text's words: no row is joined or moved, only document frequencies of the few words of
the phrases are added up. What is found does not depend on these frequencies; they decide what is looked up first, so a word that every
file has is not.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of a lower-cased text: anything but ASCII that is no digit or letter separates.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words by which parts of a template may be moved against each other, and the percentage of its words that must be found.
SLACK, LEAST_SHARE = 10, 80
#: A place is packed with its phrase: the phrase's number above so many bits.
PLACE_BITS = 40
#: The Kelvin sign is the one other letter that lower-cases to ASCII alone; it is replaced by a letter that does not.
_KELVIN, _OTHER = "\u212a", "\u03ba"


@dataclass(frozen=True)
class Template:
    """A licence's label, its words, and phrases that must stand in it verbatim (none: all its words are one)."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = field(default=False, compare=False)


def words_of(text: str) -> list[str]:
    """Words of ASCII texts such as those of templates."""
    return re.findall(WORD, text.lower())


# Phrases and labels that the contract of the base spans names.
BASE = [
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
]
# Names of licences, and notices and grants as their public texts have them.
NAMES = [
    Template("mit", "mit license"),
    Template("mit", "spdx license identifier mit"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("apache-2.0", "spdx license identifier apache 2 0"),
    Template("bsd", "bsd license"),
    Template("bsd-2-clause", "2 clause bsd"),
    Template("bsd-2-clause", "bsd 2 clause"),
    Template("bsd-3-clause", "3 clause bsd"),
    Template("bsd-3-clause", "bsd 3 clause"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("isc", "isc license"),
    Template("unlicense", "released into the public domain"),
]
NOTICES = [
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("to deal in the software without restriction", "free of charge to any person obtaining a copy of this software", "in all copies or substantial portions of the software"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
        ("redistributions of source code must retain the above copyright notice", "redistribution and use in source and binary forms", "in the documentation and or other materials provided with the distribution"),
    ),
    Template(
        "bsd-3-clause",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("may be used to endorse or promote products derived from this software",),
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("you may not use this file except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("can redistribute it and or modify it under the terms of the gnu", "published by the free software foundation"),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("this source code form is subject to the terms", "if a copy of the mpl was not distributed with this file"),
    ),
    Template(
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"),
    ),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ("any person or organization obtaining a copy of the software and accompanying documentation",),
    ),
]
TEMPLATES = [*BASE, *NAMES, *NOTICES]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null gives none. Other letters may be lower-cased too, but never to ASCII."""
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit(_OTHER)))
    return F.array_remove(F.split(folded, SEPARATORS), "")  # several times faster than extracting each match


def _literal(ws: list[str] | tuple[str, ...]) -> Column:
    """An array of words, folded to a constant when the query is planned."""
    return F.split(F.lit(" ".join(ws)), " ")


def document_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents (rows of a ``words`` column) each word of the vocabulary occurs; a row a word reaches the driver."""
    known = _literal(vocabulary)
    found = texts.select(F.explode_outer(F.array_intersect("words", known)).alias("word")).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r.word: r.n for r in found.collect()}


@dataclass(frozen=True)
class _Key:
    """A key phrase of the index: its words and the places of its rarest and second rarest word."""

    words: tuple[str, ...]
    rarest: int
    second: int


class Index:
    """Key phrases of templates with the words by which they are looked up, as columns of literals."""

    def __init__(self, templates: list[Template], frequency: dict[str, int]) -> None:
        self.templates = templates
        self.phrases: list[tuple[str, ...]] = []
        self.keys_of: list[list[tuple[int, int]]] = []  # (phrase, its place in the template), the leading one first
        for t in templates:
            body, own = words_of(t.text), []
            for key in t.keys or (t.text,):
                phrase = tuple(words_of(key))
                at = next(i for i in range(len(body)) if tuple(body[i : i + len(phrase)]) == phrase)
                if phrase not in self.phrases:
                    self.phrases.append(phrase)
                own.append((self.phrases.index(phrase), at))
            self.keys_of.append(own)
        self._keys = []
        for phrase in self.phrases:
            rank = sorted(range(len(phrase)), key=lambda i: (frequency.get(phrase[i], 0), phrase[i], i))
            self._keys.append(_Key(phrase, rank[0], rank[min(1, len(rank) - 1)]))

    @staticmethod
    def vocabulary(templates: list[Template]) -> list[str]:
        return sorted({w for t in templates for key in t.keys or (t.text,) for w in words_of(key)})

    def _starts(self, words_: Column, second: bool) -> Column:
        """Where phrases could begin by one of their two words: packed (phrase, place), and negative for none."""
        posting: dict[str, list[tuple[int, int]]] = {}
        for n, key in enumerate(self._keys):
            at = key.second if second else key.rarest
            posting.setdefault(key.words[at], []).append((n, at))
        postings = F.create_map(*(c for w, entries in posting.items() for c in (F.lit(w), F.array(*(F.struct(F.lit(n).cast("bigint").alias("phrase"), F.lit(at).alias("back")) for n, at in entries)))))
        placed = F.filter(F.transform(words_, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x.w.isin(list(posting)))
        starts = F.transform(placed, lambda x: F.transform(F.element_at(postings, x.w), lambda e: F.when(x.i >= e.back, F.shiftleft(e.phrase, PLACE_BITS) + (x.i - e.back)).otherwise(F.lit(-1).cast("bigint"))))
        return F.when(F.arrays_overlap(words_, _literal(list(posting))), F.flatten(starts)).otherwise(F.array().cast("array<bigint>"))

    def candidates(self, words_: Column) -> Column:
        """Packed places on which both words of a phrase agree."""
        return F.array_sort(F.array_intersect(self._starts(words_, False), self._starts(words_, True)))

    def standing(self, words_: Column, candidates: Column) -> Column:
        """Of the candidates those where the whole phrase stands, as (phrase, at)."""
        phrases = F.array(*map(_literal, self.phrases))
        unpacked = F.transform(F.filter(candidates, lambda c: c >= 0), lambda c: F.struct(F.shiftright(c, PLACE_BITS).cast("int").alias("phrase"), F.pmod(c, F.lit(1 << PLACE_BITS)).cast("int").alias("at")))
        return F.filter(unpacked, lambda c: F.slice(words_, c.at + 1, F.size(F.get(phrases, c.phrase))) == F.get(phrases, c.phrase))

    def matches(self, words_: Column, standing: Column) -> Column:
        """(label, share) of the templates found at any place of their leading phrase."""
        parts = [self._at_leads(words_, standing, n) for n in range(len(self.templates))]
        return F.when(F.size(standing) > 0, F.concat(*parts)).otherwise(F.array().cast("array<struct<label:string,share:double>>"))

    @staticmethod
    def _near(standing: Column, phrase: int, apart: int) -> Callable[[Column], Column]:
        """Whether a phrase stands ``apart`` words from a place, about."""
        return lambda c: F.exists(standing, lambda k: (k.phrase == phrase) & (F.abs(k.at - c.at - apart) <= SLACK))

    def _at_leads(self, words_: Column, standing: Column, n: int) -> Column:
        body = words_of(self.templates[n].text)
        (lead, offset), *others = self.keys_of[n]
        leads = F.filter(standing, lambda c: c.phrase == lead)
        if len(self.phrases[lead]) == len(body):
            return F.transform(F.slice(leads, 1, 1), lambda c: F.struct(F.lit(self.templates[n].label).alias("label"), F.lit(1.0).alias("share")))
        for phrase, at in others:
            leads = F.filter(leads, self._near(standing, phrase, at - offset))
        template = _literal(body)

        def covered(c: Column) -> Column:
            """How many words of the template stand within SLACK of their place."""
            first = lambda p: F.greatest(c.at - offset + p - SLACK, F.lit(0))
            window = lambda p: F.slice(words_, first(p) + 1, F.greatest(c.at - offset + p + SLACK + 1 - first(p), F.lit(0)))
            return F.size(F.filter(F.sequence(F.lit(0), F.lit(len(body) - 1)), lambda p: F.array_contains(window(p), F.get(template, p))))

        counted = F.transform(leads, covered)
        enough = F.filter(counted, lambda x: x * 100 >= LEAST_SHARE * len(body))
        return F.transform(enough, lambda x: F.struct(F.lit(self.templates[n].label).alias("label"), (x / F.lit(float(len(body)))).alias("share")))


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found for every row of (doc_id, text).

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are where the first and the last begin (null without
    one). ``base_labels`` and ``labels`` (these with what templates add) are distinct, sorted and joined by commas, empty for none.
    ``score`` is the largest share of a found template's words (1 where a phrase is the template, 0 without any), ``found`` all
    (label, share).

    Null and empty texts have no words and no labels. Repeated rows and rows without an id have a row each. Texts are read whole; an
    array of all words of one text is held at a time. An empty table gives no rows. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = Index.vocabulary(templates)
    index = Index(templates, document_frequencies(docs.select(words(F.col("text")).alias("words")), vocabulary))
    base = {index.keys_of[n][0][0]: t.label for n, t in enumerate(templates) if t.base}
    rows = docs.select("doc_id", words(F.col("text")).alias("words"))
    rows = rows.select("*", index.candidates(F.col("words")).alias("candidates"))
    rows = rows.select("*", index.standing(F.col("words"), F.col("candidates")).alias("standing"))
    rows = rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.filter("standing", lambda c: c.phrase.isin(list(base))).alias("own"), index.matches(F.col("words"), F.col("standing")).alias("found"))
    names = F.create_map(*(F.lit(x) for pair in base.items() for x in pair))
    rows = rows.select("*", F.transform("own", lambda c: F.element_at(names, c.phrase)).alias("base"), F.transform("own", lambda c: c.at.cast("bigint")).alias("places"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("own").cast("bigint").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"), joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("found", lambda m: m.label))).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda m: m.share)), F.lit(0.0)).alias("score"), "found",
    )
