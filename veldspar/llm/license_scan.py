"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every template's token sequence. A document streams through it, which
gives at each token the longest match that ends there (matching statistics). Long maximal
matches, in template order and without overlaps, chain into spans of a template; a
template is found where a chain covers enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrases whose places are counted, by label.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Public licence wording, by label.
TEMPLATES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "mit-notice": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "gnu lesser general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced",
}

#: A chain is a licence from this covered share of its template on; of a template of fewer than
#: SHORT words, all must be covered.
COVERED, SHORT = 0.8, 10
#: Matches shorter than this don't join chains.
MIN_MATCH = 2
#: Template and document may drift apart by so many tokens between chained matches.
MAX_GAP = 20

_SEP = 0x01
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()

SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences.

    ends[state]: for each template, the least end position of the state's strings in it.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for which, seq in enumerate(sequences):
            last = 0
            for at, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].setdefault(which, at + 1)
        for v in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            up = self.ends[self.link[v]]
            for which, at in self.ends[v].items():
                up[which] = min(up.get(which, at), at)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        state = length = 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                length = 0
            yield state, length


def needed(n: int) -> float:
    """The covered share that a template of n words asks for."""
    return 1.0 if n < SHORT else COVERED


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES):
        self.names = [*base, *templates]
        self.n_base = len(base)
        self.vocab: dict[bytes, int] = {}
        self.seqs = []
        for phrase in (*base.values(), *templates.values()):
            self.seqs.append([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(phrase)])
        self.sam = SuffixAutomaton(self.seqs)
        n = len(self.vocab) + 1
        self.pairs = np.zeros((n, n), dtype=bool)
        for s in self.seqs:
            self.pairs[s[:-1], s[1:]] = True
        #: base phrases whose own state is this state or a suffix of it
        self.told: list[list[int]] = [[] for _ in self.sam.length]
        home = {}
        for k in range(self.n_base):
            state = 0
            for c in self.seqs[k]:
                state = self.sam.next[state][c]
            home.setdefault(state, []).append(k)
        for v in range(len(self.sam.length)):
            up = v
            while up > 0:
                self.told[v] += home.get(up, [])
                up = self.sam.link[up]

    def run(self, tokens: list[int], start: int, places: list[tuple[int, int]], matches: list[tuple[int, int, int, int]]) -> None:
        """Stream one stretch of tokens; adds (phrase, start) and (template, document start,
        template start, length) of its maximal matches."""
        before = (0, 0)
        for k, (state, length) in enumerate([*self.sam.stream(tokens), (0, 0)]):
            if before[1] >= MIN_MATCH and length <= before[1]:
                for which, end in self.sam.ends[before[0]].items():
                    if which >= self.n_base:
                        matches.append((which, start + k - before[1], end - before[1], before[1]))
            for p in self.told[state] if length else ():
                if length >= (m := len(self.seqs[p])):
                    places.append((p, start + k - m + 1))
            before = (state, length)

    def chained(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered share) of the chains of matches."""
        out: list[tuple[int, int, int, float]] = []
        chains: dict[int, tuple[int, int, int, int]] = {}  # template: document start and end, template end, covered

        def close(which: int) -> None:
            begin, d_end, _, have = chains[which]
            out.append((which, begin, d_end - 1, have / len(self.seqs[which])))

        for which, at, t_at, n in sorted(matches, key=lambda m: (m[1], m[2])):
            begin, d_end, t_end, have = chains.get(which, (at, 0, 0, 0))
            if have and t_at >= t_end and at >= d_end and abs((at - d_end) - (t_at - t_end)) <= MAX_GAP and at - d_end <= MAX_GAP:
                have += n
            elif have >= n and at < d_end:
                continue  # inside a longer chain
            else:
                if have:
                    close(which)
                begin, have = at, n
            chains[which] = (begin, at + n, t_at + n, have)
        for which in chains:
            close(which)
        return out

    def scan(self, texts: list[str]) -> list[tuple]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each."""
        parts = [t.encode("utf-8", "surrogatepass").translate(_TO_WORDS) for t in texts]
        words = (b" %c " % _SEP).join(parts).split()
        ids = np.fromiter(map(self._known().get, words, repeat(0)), dtype=np.int32, count=len(words))
        breaks = np.flatnonzero(ids < 0)
        starts, stops = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(words)]))
        ids = np.maximum(ids, 0)
        linked = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, dtype=bool)
        # Stretches in which every two neighbours are neighbours in a template, too.
        edge = np.diff(np.concatenate(([0], linked.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(stops, begin, side="right")
        found: dict[int, tuple[list, list]] = {}
        for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
            places, matches = found.setdefault(d, ([], []))
            self.run(ids[a : b + 1].tolist(), a - int(starts[d]), places, matches)
        out = []
        for d in range(len(texts)):
            places, matches = found.get(d, ((), ()))
            chains = self.chained(matches) if matches else []
            best: dict[int, float] = {}
            for k, _, _, share in chains:
                best[k] = max(best.get(k, 0.0), share)
            spans = sorted(({"label": self.names[k], "first_word": x, "last_word": y, "covered": v} for k, x, y, v in chains if v >= needed(len(self.seqs[k]))), key=lambda x: (x["first_word"], x["last_word"], x["label"]))
            base = sorted({self.names[p] for p, _ in places})
            labels = sorted({*base, *(self.names[k] for k, v in best.items() if v >= needed(len(self.seqs[k])))})
            score = 1.0 if base else min(1.0, max(best.values(), default=0.0))
            where = [w for _, w in places]
            out.append((int(stops[d] - starts[d]), len(where), min(where, default=None), max(where, default=None), ",".join(base), ",".join(labels), score, spans))
        return out

    def _known(self) -> dict[bytes, int]:
        return {**self.vocab, bytes([_SEP]): -1}


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, first_word, last_word and covered share of each stretch of words that a chain
    of matches covers as far as a label needs.
    A null or empty text has no words, no labels, null places and score 0. Texts are scanned
    whole; repeated rows give repeated rows; a null identifier stays null; an empty table
    gives an empty result; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS]
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rows = scanner.scan([t or "" for t in part.column(1).to_pylist()])
                cols = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        scan, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, covered: double>>"
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every whole text of documents."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")
