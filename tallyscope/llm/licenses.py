"""License scans by patience alignment with license templates.

A template covers a text where at least ``COVERAGE`` of its words align, in order, within a
span of at most twice the aligned words.  Any such span lies in a window of twice the
template's length that holds enough of its words, so only those regions are aligned (nothing
else can match).  Alignment anchors on words that are unique in both the region and the
template, takes their longest increasing subsequence and aligns every gap the same way; a gap
without a common unique word takes the longest common subsequence of its repeated words.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


COVERAGE = 0.8
#: Notices of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                  "except in compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the "
               "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
               "License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met:",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tops, ends, before = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        tops[k:k + 1], ends[k:k + 1] = [v], [i]
        before.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence as index pairs: an increasing subsequence over the matches."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    pairs = [(i, j) for j, w in enumerate(b) for i in reversed(at.get(w, ()))]
    return [pairs[k] for k in increasing([i for i, _ in pairs])]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment of two word lists: increasing pairs (index in a, index in b)."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        if a0 >= a1 or b0 >= b1:
            continue
        x, y = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {a[i]: i for i in range(a0, a1) if x[a[i]] == 1 and y[a[i]] == 1}
        pairs = [(where[b[j]], j) for j in range(b0, b1) if b[j] in where]
        anchors = [pairs[k] for k in increasing([i for i, _ in pairs])]
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """Templates with the words of which any sufficient match must hold at least one."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> None:
        self.coverage = coverage
        self.templates = {k: tokens(v) for k, v in templates.items() if tokens(v)}
        shared = Counter(w for t in self.templates.values() for w in set(t))
        self.keys = {}
        for k, t in self.templates.items():
            spare = len(t) - math.ceil(coverage * len(t))  # so many words may miss
            keys: Counter = Counter()
            for w in sorted(set(t), key=lambda w: (-shared[w] * len(w), w)):
                if sum(keys.values()) > spare:
                    break
                keys[w] = t.count(w)
            self.keys[k] = list(keys)
        self.any = sorted({w for ks in self.keys.values() for w in ks}, key=len, reverse=True)

    def _regions(self, text: list[str], t: list[str]) -> Iterator[tuple[int, int]]:
        """Merged windows of 2 * len(t) words that hold enough words of the template."""
        least, wide, own = math.ceil(self.coverage * len(t)), 2 * len(t), set(t)
        hits = [i for i, w in enumerate(text) if w in own]
        start = end = None
        for k in range(len(hits) - least + 1):
            if hits[k + least - 1] - hits[k] < wide:
                a, b = hits[k], hits[k] + wide
                if end is not None and a <= end:
                    end = b
                    continue
                if end is not None:
                    yield start, min(end, len(text))
                start, end = a, b
        if end is not None:
            yield start, min(end, len(text))

    def _matches(self, text: list[str], t: list[str]) -> Iterator[tuple[float, int, int]]:
        least, own, wide = math.ceil(self.coverage * len(t)), set(t), 2 * len(t)

        def fit(at: int, past: int) -> tuple[int, int, int]:
            """(words aligned or 0 if too few or too far apart, first, past the last)."""
            got = align(text[at:past], t)
            if len(got) < least or got[-1][0] - got[0][0] >= 2 * len(got):
                return 0, at, at
            return len(got), at + got[0][0], at + got[-1][0] + 1

        for start, stop in self._regions(text, t):
            at = start
            while at < stop:  # a region can hold several copies: go on after each
                best = fit(at, min(at + wide, stop))
                if not best[0]:
                    at = next((i for i in range(at + 1, stop) if text[i] in own), stop)
                    continue
                if best[0] < len(t):  # two copies side by side hide each other's words: look at each alone
                    best = max([best, *(fit(i, min(i + len(t), stop)) for i in range(at, min(at + wide, stop))
                                        if text[i] in own)], key=lambda m: (m[0], -m[1]))
                yield best[0] / len(t), best[1], best[2]
                at = best[2]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, past the last word) of every match, in template order."""
        low = (text or "").lower()
        if not any(w in low for w in self.any):
            return []
        text_words = _WORD.findall(low)
        held = set(text_words)
        return [(k, *m) for k, t in self.templates.items() if any(w in held for w in self.keys[k])
                for m in self._matches(text_words, t)]


FOUND = "array<struct<license:string,coverage:double,first:bigint,past:bigint>>"


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, found): one row per input row; ``found`` lists every match in the whole text.

    Null and empty texts match nothing.  Equal rows get equal results, ids play no part, and
    an empty table gives an empty result.  Word positions count runs of letters and digits.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()),
                                   ("past", pa.int64())]))
        names = [f.name for f in kind.value_type]
        for batch in batches:
            found = [[dict(zip(names, m)) for m in scanner.scan(t.as_py())] for t in batch["t"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "found"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("t"))
    return src.mapInArrow(scan, f"doc_id bigint, found {FOUND}")
