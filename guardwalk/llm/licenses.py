"""License scans: fuzzy search for short notices.

A notice that stands in a text with at most k edits leaves one of any k + 1 parts
of it untouched (pigeonhole). One Aho-Corasick pass finds all those seeds, each
hit gives a window, and the regex library's bounded-error matching decides there
and reports the span and the number of edits.

Texts are searched as their words, A-Z lower-cased and joined by one space; spans
are given in words and, through the words, in code points of the text.

Defined results: a null or empty text has no words, labels or spans, and score 0;
repeated rows give repeated results; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, pairwise

import ahocorasick
import regex
from pyspark.sql import DataFrame

from guardwalk.llm.arrow import ascii_lower, map_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# The base phrases and labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices and their labels, as words.
NOTICES = (
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("to the extent possible under law the author has waived all copyright", "cc0"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("distributed under the boost software license version 1 0", "bsl"),
    ("you may distribute under the terms of the artistic license", "artistic"),
    ("licensed under the european union public licence", "eupl"),
    ("the software is provided as is without warranty of any kind", "as-is"),
)


def edits_for(notice: str) -> int:
    """One edit for every 12 characters, between 1 and 4."""
    return max(1, min(4, len(notice) // 12))


@dataclass(frozen=True)
class Hit:
    label: str
    start: int
    end: int
    edits: int
    score: float


def matches(pattern: regex.Pattern, joined: str, a: int, b: int, least: int) -> Iterator[regex.Match]:
    """Matches in [a, b), the best one first, then those in the stretches before and behind it, of `least` characters or more."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if b - a >= least and (m := pattern.search(joined, a, b)):
            yield m
            todo += [(m.end(), b), (a, m.start())]


class Scanner:
    def __init__(self, notices=NOTICES):
        self.notices = [(n, label, k := edits_for(n), regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}")) for n, label in notices]
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k, _) in enumerate(self.notices):
            cuts = [len(n) * j // (k + 1) for j in range(k + 2)]
            for a, b in pairwise(cuts):
                at.setdefault(n[a:b], []).append((i, a))
        for seed, places in at.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def windows(self, joined: str) -> dict[int, list[list[int]]]:
        """By notice: the stretches in which it may stand, touching ones made one."""
        out: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(joined):
            for i, offset in places:
                n, _, k, _ = self.notices[i]
                start = end + 1 - size - offset
                out.setdefault(i, []).append([max(0, start - k), min(len(joined), start + len(n) + k)])
        for i, spans in out.items():
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out[i] = merged
        return out

    def find(self, joined: str) -> list[Hit]:
        found = []
        for i, spans in self.windows(joined).items():
            n, label, k, pattern = self.notices[i]
            for a, b in spans:
                for m in matches(pattern, joined, a, b, len(n) - k):
                    edits = sum(m.fuzzy_counts)
                    found.append(Hit(label, m.start(), m.end(), edits, 1 - edits / len(n)))
        return unbeaten(sorted(found, key=lambda h: (h.start, h.end, h.label)))


def unbeaten(hits: list[Hit]) -> list[Hit]:
    """Where notices resemble each other, the ones with the fewest edits are meant: drop a hit that overlaps one with fewer."""
    longest = max((h.end - h.start for h in hits), default=0)
    out, lo = [], 0
    for i, h in enumerate(hits):
        while hits[lo].start + longest <= h.start:
            lo += 1
        j, beaten = lo, False
        while j < len(hits) and hits[j].start < h.end and not beaten:
            beaten = j != i and hits[j].edits < h.edits and h.start < hits[j].end
            j += 1
        if not beaten:
            out.append(h)
    return out


class Places:
    """Words by their places in the joined text; the starts are found once, when they are first asked for."""

    def __init__(self, words: list[str]):
        self.words, self.starts = words, None

    def word(self, at: int) -> int:
        """The word that holds the character, or stands before the space, at a place."""
        if self.starts is None:
            self.starts = [0, *accumulate(len(w) + 1 for w in self.words)]
        return bisect_right(self.starts, at) - 1


def base_places(joined: str, places: Places) -> list[tuple[int, str]]:
    """(word, label) of every place where the words of a phrase stand in a row."""
    padded, out = f" {joined} ", []
    for phrase, label in PHRASES:
        want = f" {phrase} "
        at = padded.find(want)
        while at >= 0:
            out.append((places.word(at), label))
            at = padded.find(want, at + 1)
    return sorted(out)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_text(text: str, s: Scanner) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, int, int]], float]:
    """(words, base places, hits as (label, first word, last word, start, end, edits), score)."""
    low = ascii_lower(text)
    words = WORD.findall(low)
    joined = " ".join(words)
    places = Places(words)
    base, hits = base_places(joined, places), s.find(joined)
    score = 1.0 if base else max((h.score for h in hits), default=0.0)
    if not hits:
        return len(words), base, [], score
    spans = [m.span() for m in WORD.finditer(low)]
    said = []
    for h in hits:
        # a match may begin or end at the space beside a word
        first = places.word(h.start + (joined[h.start] == " "))
        last = max(first, places.word(h.end - 1 - (joined[h.end - 1] == " ")))
        said.append((h.label, first, last, spans[first][0], spans[last][1], h.edits))
    return len(words), base, said, score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places, labels, score and the spans of all notices per document."""

    def make():
        s = scanner()

        def one(doc_id, text):
            n, base, hits, score = scan_text(text or "", s)
            base_labels = sorted({label for _, label in base})
            labels = sorted({*base_labels, *(h[0] for h in hits)})
            spans = ",".join(f"{h[0]}:{h[3]}:{h[4]}:{h[5]}" for h in hits)
            return doc_id, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(base_labels), ",".join(labels), score, spans

        return one

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return map_rows(docs, [docs[id_col], docs[text_col]], schema, make)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
