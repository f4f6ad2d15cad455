"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

A template of m shingles is looked for in windows of twice the smallest power of two that is
m or more, so of fewer than 4 m shingles; they overlap by half, so a whole notice lies in one
window with a Jaccard similarity of 1/4 or more. With BANDS bands of one row each it is missed
with probability (3/4)^48, about 10^-6; with a fifth of its shingles changed, about 4 * 10^-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import LOWER, cuts, mix, words

BANDS = 48
SHINGLE = 5
#: Lower-case letters; ASCII punctuation is a blank.
FOLD = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum() and _b not in range(0x09, 0x0E):
        FOLD[_b] = 0x20
# Notices and well-known sentences of common public licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "licensed under the GNU Lesser General Public License"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def _shingles(column: pa.Array):
    """Shingle hashes, the text and the first word of each. Texts of fewer words have one."""
    w = words(column, FOLD)
    h = w.hashes()
    n = len(h)
    out = np.zeros(n, np.uint64)
    left = np.repeat(np.cumsum(w.lengths), w.lengths) - np.arange(n)  # words from here to the end of the text
    for k in range(SHINGLE):
        next_ = np.concatenate([h[k:], np.zeros(min(k, n), np.uint64)])[:n]
        out = np.where(left > k, mix(out * np.uint64(3) + next_ + np.uint64(k + 1)), out)
    place = np.arange(n) - np.repeat(np.cumsum(w.lengths) - w.lengths, w.lengths)
    keep = (left >= SHINGLE) | (place == 0)
    return out[keep], w.owner[keep], place[keep]


class Matcher:
    def __init__(self, templates: list[tuple[str, str]], bands: int = BANDS, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, bands, dtype=np.uint64)
        self.names = [n for n, _ in templates]
        h, owner, _ = _shingles(pa.array([t for _, t in templates], pa.string()))
        self.sets = [np.unique(h[owner == k]) for k in range(len(templates))]
        self.size = [int((owner == k).sum()) for k in range(len(templates))]
        #: Of each scale, by shingles in half of a window, its templates.
        self.scales: dict[int, list[int]] = {}
        for k, n in enumerate(self.size):
            if n:
                self.scales.setdefault(1 << (n - 1).bit_length(), []).append(k)
        self.tables = {}
        for half, ks in self.scales.items():
            for f in range(bands):
                values = np.array([int(self._rank(self.sets[k], f).min()) for k in ks], np.uint64)
                order = np.argsort(values)
                high = np.zeros(1 << 16, bool)
                high[values >> np.uint64(48)] = True
                self.tables[half, f] = (values[order], np.array(ks)[order], high)

    def _rank(self, h: np.ndarray, f: int) -> np.ndarray:
        return h * self.odd[f] + self.add[f]

    def candidates(self, h: np.ndarray, owner: np.ndarray, place: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, shingle after the last) of windows to look at."""
        found: set[tuple[int, int, int]] = set()
        n = len(h)
        if not n or not self.scales:
            return found
        # Blocks of 1, 2, 4, ... shingles of one text; a window is two neighbouring blocks.
        blocks, half, starts = [], 1, np.arange(n)
        while half <= max(self.scales):
            among = np.append(True, (owner[starts][1:] != owner[starts][:-1]) | (place[starts][1:] % half == 0))
            within = np.flatnonzero(among)
            starts = starts[within]
            joined = np.append(owner[starts][1:] == owner[starts][:-1], False)
            blocks.append((half, within, starts, joined))
            half *= 2
        for f in range(len(self.odd)):
            least = self._rank(h, f)
            for half, within, starts, joined in blocks:
                if half > 1:
                    least = np.minimum.reduceat(least, within)
                if half not in self.scales:
                    continue
                both = np.where(joined, np.minimum(least, np.append(least[1:], least[-1])), least)
                values, ks, high = self.tables[half, f]
                for b in np.flatnonzero(high[both >> np.uint64(48)]).tolist():
                    lo, hi = np.searchsorted(values, both[b], "left"), np.searchsorted(values, both[b], "right")
                    for k in ks[lo:hi].tolist():
                        last = b + 1 + int(joined[b])
                        found.add((k, int(starts[b]), int(starts[last]) if last < len(starts) else n))
        return found

    def matches(self, column: pa.Array, least: float) -> list[tuple[int, str, float, int]]:
        """(text, license, largest containment, first word of it), one for each pair."""
        h, owner, place = _shingles(column)
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for k, a, b in sorted(self.candidates(h, owner, place)):
            n, text = self.size[k], owner[a]
            lo, hi = max(a - n, 0), min(b + n, len(h))
            own = np.arange(lo, hi)[owner[lo:hi] == text]
            at = own[np.isin(h[own], self.sets[k])]
            # The densest stretch as long as the template.
            for i in range(len(at)):
                stretch = at[i:][at[i:] < at[i] + n]
                share = len(np.unique(h[stretch])) / len(self.sets[k])
                key = (int(text), self.names[k])
                if share >= least and (share, -int(place[at[i]])) > (best.get(key, (0.0, 0))[0], -best.get(key, (0.0, 0))[1]):
                    best[key] = (share, int(place[at[i]]))
        return [(t, name, share, word) for (t, name), (share, word) in sorted(best.items())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, least: float = 0.8) -> DataFrame:
    """(id, license, containment, first_word): every license of which some template has at
    least ``least`` of its five-word shingles in a stretch of the text as long as it.

    Words are lower case without ASCII punctuation. first_word: position, from 0, of the best
    stretch, the first of equals. Whole texts are scanned; null and empty texts have none.
    Repeated rows give repeated results, null ids stay null; an empty table gives none.
    """
    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("license", "string").add("containment", "double").add("first_word", "long")
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(batch.column(1)):
                found = matcher.value.matches(batch.column(1).slice(a, b - a), least)
                if found:
                    rows, names, shares, at = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a).take(pa.array(rows)), pa.array(names), pa.array(shares, pa.float64()), pa.array(at, pa.int64())],
                        names=schema.names,
                    )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
