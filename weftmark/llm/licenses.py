"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, a paragraph (lines up to an empty one) of two lines or more, a sentence of
either, or, for each template, any run of as many words as the template has, wherever it begins
and whatever lines it crosses: so notices are found inside texts of any length. A template and a
block match when the block's word set holds at least ``threshold`` of the template's, however many
other words the block holds. Where a block matches two templates of different labels and one's words are all the other's too,
it counts for the one it holds more of, in equal shares for the larger (a notice of CC BY-NC is none of CC BY, nor the reverse).
Words are ordered by how many documents of the whole corpus hold them, rarest first (counted
for the templates' words only, so what is broadcast is bounded by the templates). Under that
order a matching block must hold one of the first ``n - ceil(threshold * n) + 1`` words of the
template (prefix filter), have at least ``ceil(threshold * n)`` words (length filter; ``longest`` may set an upper bound, in
template sizes, on lines, paragraphs and sentences, none by default), and leave room enough behind the first shared word
(positional filter); the survivors are counted exactly. Runs are counted at every position of every text that holds enough of
the template's words.

Two passes over the texts; the shuffle carries one row a template word and task. Defined
results: a null text is an empty one; no words, no labels, score 0; texts of any length are
read whole; equal rows give equal rows; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import map_rows, per_text

#: phrase: label
PHRASES: dict[str, str] = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: public license notices. What a phrase says in a few common words is no template: as a set such words stand in many texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "all-rights-reserved": ("Copyright. All rights reserved.",),
}

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_SPLIT = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_EMPTY_LINE = re.compile(rb"\n[\x20\t\r]*\n")
_SENTENCE_END = re.compile(rb"(?<=[.!?])[\x20\t\r\n]+")


def words_of(text: str | bytes) -> list[bytes]:
    """Words of the text with A-Z in lower case. UTF-8 bytes above 0x7F are word characters, as their code points are."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.lower().translate(_SPLIT).split()


def template_sets(templates: Mapping[str, tuple[str, ...]]) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(t))) for label, texts in templates.items() for t in texts]


def word_order(df: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """Document counts over all rows of the templates' words: at most one row for each word reaches the driver."""
    wanted = frozenset().union(*(s for _, s in template_sets(templates)))

    def start():
        def step(cols):
            counts: dict[bytes, int] = {}
            for text in cols[0]:
                for w in wanted.intersection(words_of(text or "")):
                    counts[w] = counts.get(w, 0) + 1
            return [(w.decode(), n) for w, n in counts.items()]

        return step

    held = map_rows(df.select(F.col(text_col).cast("string")), "word string, n long", start).groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"].encode(): r["n"] for r in held.collect()}  # bounded by the templates' words
    return {w: counts.get(w, 0) for w in wanted}


class Matcher:
    """Inverted index over the templates' prefixes; ``best(words)`` gives each label's largest containment at or over the threshold."""

    def __init__(self, templates, order: Mapping[bytes, int], threshold: float, longest: float | None = None):
        self.sets = template_sets(templates)
        self.lengths = [len(words_of(t)) for texts in templates.values() for t in texts]
        self.longest = longest
        self.need = [math.ceil(threshold * len(s) - 1e-9) for _, s in self.sets]
        #: Templates of other labels whose words are a part of a template's, or the reverse.
        self.rivals = [[j for j, (other, t) in enumerate(self.sets) if other != label and (s < t or t < s)] for label, s in self.sets]
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, s) in enumerate(self.sets):
            ranked = sorted(s, key=lambda w: (order.get(w, 0), w))
            for at, w in enumerate(ranked[: len(s) - self.need[k] + 1]):
                self.index.setdefault(w, []).append((k, at))
        self.keys = frozenset(self.index)

    def wins(self, k: int, shared: int, block) -> bool:
        """Whether no rival holds a larger share in the block, or the same with more words."""
        mine = shared / len(self.sets[k][1]), len(self.sets[k][1])
        for j in self.rivals[k]:
            t = self.sets[j][1]
            n = len(t.intersection(block))
            if n >= self.need[j] and (n / len(t), len(t)) > mine:
                return False
        return True

    def possible(self, held: set[bytes]) -> list[int]:
        """The templates of which the words of a whole text hold enough."""
        return [k for k in {k for w in self.keys & held for k, _ in self.index[w]} if len(self.sets[k][1] & held) >= self.need[k]]

    def inside(self, words: list[bytes]) -> dict[str, float]:
        """Each label's largest containment at or over the threshold in a run of as many words as the template has, at any position."""
        out: dict[str, float] = {}
        for k in self.possible(set(words)):
            (label, s), n = self.sets[k], self.lengths[k]
            most, last = 0, {}  # last: the words of the template in the run, and where each was seen last
            recent: deque[tuple[int, bytes]] = deque()
            for at, w in enumerate(words):
                if w in s:
                    last[w] = at
                    recent.append((at, w))
                while recent and recent[0][0] <= at - n:
                    old, x = recent.popleft()
                    if last[x] == old:
                        del last[x]
                if len(last) > most and len(last) >= self.need[k] and self.wins(k, len(last), words[max(at - n + 1, 0) : at + 1]):
                    most = len(last)
            if most >= self.need[k]:
                out[label] = max(out.get(label, 0.0), most / len(s))
        return out

    def best(self, words: list[bytes]) -> dict[str, float]:
        hits = self.keys.intersection(words)
        if not hits:
            return {}
        block = set(words)
        first: dict[int, int] = {}
        for w in hits:
            for k, at in self.index[w]:
                first[k] = min(at, first.get(k, at))
        out: dict[str, float] = {}
        for k, at in first.items():
            label, s = self.sets[k]
            if len(block) < self.need[k] or self.longest is not None and len(block) > self.longest * len(s) or len(s) - at < self.need[k]:
                continue
            shared = len(s & block)
            if shared >= self.need[k] and self.wins(k, shared, block):
                out[label] = max(out.get(label, 0.0), shared / len(s))
        return out


def blocks_of(raw: bytes):
    """Lines, paragraphs of two lines or more, and the sentences of both."""
    for paragraph in _EMPTY_LINE.split(raw) if b"\n" in raw else (raw,):
        lines = [x for x in paragraph.split(b"\n") if x]
        for block in (*lines, paragraph) if len(lines) > 1 else lines:
            yield block
            sentences = _SENTENCE_END.split(block)
            if len(sentences) > 1:
                yield from sentences


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(
    df: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = 0.85,
    longest: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Phrase places and template matches of each row; ``score`` is the largest containment (1 for a phrase)."""
    order = word_order(df, templates, text_col)
    phrases, templates = dict(phrases), dict(templates)

    def start():
        matcher = Matcher(templates, order, threshold, longest)
        wanted = [(tuple(words_of(p)), label) for p, label in phrases.items()]

        def one(text: str | None) -> tuple:
            raw = (text or "").encode("utf-8", "surrogatepass")
            words = words_of(raw)
            held = set(words)
            places, base = [], set()
            for phrase, label in wanted:
                if held.issuperset(phrase):
                    rare = min(phrase, key=words.count)
                    shift, at = phrase.index(rare), -1
                    for _ in range(words.count(rare)):
                        at = words.index(rare, at + 1)
                        if at >= shift and tuple(words[at - shift : at - shift + len(phrase)]) == phrase:
                            places.append(at - shift)
                            base.add(label)
            found: dict[str, float] = {}
            if matcher.possible(held):
                found = matcher.inside(words)
                for block in blocks_of(raw):
                    for label, share in matcher.best(words_of(block)).items():
                        found[label] = max(found.get(label, 0.0), share)
            score = 1.0 if base else max(found.values(), default=0.0)
            return (
                len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score,
            )

        return one

    return per_text(df, SCHEMA, start, id_col, text_col)
