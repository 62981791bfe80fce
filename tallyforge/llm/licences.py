"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Texts and templates are lower-cased words of letters, digits and bytes beyond ASCII. A template of t five-word
shingles (of all its words, if it has fewer) belongs to the least half-window B of powers of two with t <= B + 1.
A window is two adjacent blocks of B shingles, so windows overlap by half and a run of t shingles lies whole in one of
them. A window that holds the share 0.8 of a template, c = ceil(0.8 t) shingles, has a similarity of at least
s = c / (2 B + t - c) with it, which is over 0.19 for any t. Each band is one minimum of an independent hash, and a half-window takes as many bands as
make a miss, (1 - s)**bands for the least s of its templates, rarer than 1e-7. Equal minima retrieve pairs of a window and a
template, and each pair is verified on exact sets. Of licences whose matches lie over each other, such as two versions of one notice, the one
that is contained best is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, ship, utf8
from .words import word_hashes, shingles

WORDS, SHARE, MISS = 5, 0.8, 1e-7
GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Notices that licences prescribe or that are in common use, and whole texts of short licences. Fixed values, from the licences themselves.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "All-Rights-Reserved": ("All rights reserved.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
}


@dataclass
class Run:
    """A template."""

    licence: str
    words: int  # in a shingle
    shingles: np.ndarray  # sorted distinct
    half: int


def hashed(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*word_hashes(data, offsets, GAPS), words)


def compiled(templates: dict[str, tuple[str, ...]]) -> list[Run]:
    runs = []
    for licence, texts in sorted(templates.items()):
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            n = int(word_hashes(data, np.array([0, len(data)]), GAPS)[1][0])
            if not n:
                continue
            found = np.unique(hashed(data, np.array([0, len(data)]), min(WORDS, n))[0])
            half = 1
            while n - min(WORDS, n) + 1 > half + 1:
                half *= 2
            runs.append(Run(licence, min(WORDS, n), found, half))
    return runs


def bands_for(runs: list[Run]) -> int:
    """So many that a window with the wanted share of any of the runs, all of one half-window, is missed once in 1 / MISS times."""
    most = 1
    for r in runs:
        t = len(r.shingles)
        c = math.ceil(SHARE * t)
        s = c / (2 * r.half + t - c)
        most = max(most, 1 if s >= 1 else math.ceil(math.log(MISS) / math.log(1 - s)))
    return most


ODD = mix(np.arange(1, 129, dtype=np.uint64)) | np.uint64(1)


def _order(found: np.ndarray, band: int) -> np.ndarray:
    return ((found ^ ODD[band]) * ODD[band] >> np.uint64(32)).astype(np.uint32)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.runs = compiled(templates)
        self.by_words: dict[int, dict[int, list[Run]]] = {}
        for r in self.runs:
            self.by_words.setdefault(r.words, {}).setdefault(r.half, []).append(r)
        #: for each band the minima of the templates in order, whose they are, and which low halves of minima occur
        self.bands: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for words, halves in self.by_words.items():
            for half, runs in halves.items():
                bands = self.bands[words, half] = []
                for band in range(bands_for(runs)):
                    low = np.array([_order(r.shingles, band).min() for r in runs], np.uint32)
                    seen = np.zeros(1 << 16, bool)
                    seen[low & np.uint32(0xFFFF)] = True
                    order = np.argsort(low, kind="stable")
                    bands.append((low[order], order, seen))

    def _retrieved(self, low: np.ndarray, key: tuple[int, int], band: int, pairs: set[tuple[int, int]], windows: np.ndarray | None = None) -> None:
        """Adds the pairs of a window and a template of equal minimum. Few pass the table of low halves."""
        minima, owner, seen = self.bands[key][band]
        near = seen[low & np.uint32(0xFFFF)]
        if windows is not None:
            near &= windows
        for i in np.flatnonzero(near):
            a, b = np.searchsorted(minima, low[i], "left"), np.searchsorted(minima, low[i], "right")
            pairs.update((int(i), int(r)) for r in owner[a:b])

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, float, int, int]]]:
        """For each text the matches (licence, containment, first word, word after the last), the best of each licence."""
        out: list[dict[str, tuple[float, int, int, int]]] = [{} for _ in range(len(offsets) - 1)]
        words, counts = word_hashes(data, offsets, GAPS)
        for k, halves in self.by_words.items():
            found, have = shingles(words, counts, k)
            found = np.where(np.repeat(counts < k, have), np.uint64(0), found)  # shorter than any template of k words
            if not len(found):
                continue
            begin = np.cumsum(have) - have
            blocks = {}
            for half in halves:
                n = -(-have // half)
                owner = np.repeat(np.arange(len(have)), n)
                starts = begin[owner] + half * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
                blocks[half] = owner, starts, owner[1:] == owner[:-1], set()
            for band in range(max(len(self.bands[k, half]) for half in halves)):
                order = _order(found, band)
                for half, (_, starts, joined, pairs) in blocks.items():
                    if band >= len(self.bands[k, half]):
                        continue
                    low = order if half == 1 else np.minimum.reduceat(order, starts)
                    self._retrieved(low, (k, half), band, pairs)
                    self._retrieved(np.minimum(low[:-1], low[1:]), (k, half), band, pairs, joined)
            for half, runs in halves.items():
                owner, starts, _, pairs = blocks[half]
                for i, j in sorted(pairs):
                    d, r = owner[i], runs[j]
                    window = found[starts[i] : min(starts[i] + 2 * half, begin[d] + have[d])]
                    there = np.isin(window, r.shingles)
                    share = len(np.unique(window[there])) / len(r.shingles)
                    best = out[d].get(r.licence)
                    if share >= SHARE and (best is None or (share, len(r.shingles)) > (best[0], best[3])):
                        places = np.flatnonzero(there) + int(starts[i] - begin[d])
                        out[d][r.licence] = (share, int(places[0]), int(places[-1]) + k, len(r.shingles))
        return [[(x, *v[:3]) for x, v in sorted(told_apart(o).items())] for o in out]


def told_apart(matches: dict[str, tuple[float, int, int, int]]) -> dict[str, tuple[float, int, int, int]]:
    """The matches (containment, first word, word after the last, shingles of the template) but for those of which more than half lies over a
    better one: better contained, of a longer template, or first by name."""
    kept: dict[str, tuple[float, int, int, int]] = {}
    for x, own in sorted(matches.items(), key=lambda m: (-m[1][0], -m[1][3], m[0])):
        if all(2 * (min(own[2], other[2]) - max(own[1], other[1])) <= min(own[2] - own[1], other[2] - other[1]) for other in kept.values()):
            kept[x] = own
    return kept


def scan(docs: DataFrame, *, templates: dict[str, tuple[str, ...]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_licences, licences, matches), a row for each row of ``docs``: the names in order with a comma between, and of each
    licence the best match (licence, containment, first_word, past_word).

    A licence matches where a window holds at least 0.8 of the distinct shingles of one of its ``templates``, which may be given as a table
    (licence, text) too, of whole licences if wanted; they are read by the driver. Null and empty texts match nothing; null and repeated ids are kept.
    """
    ship(docs.sparkSession)
    if isinstance(templates, DataFrame):
        given: dict[str, tuple[str, ...]] = {}
        for licence, text in templates.select("licence", "text").filter("licence is not null and text is not null").collect():
            given[licence] = (*given.get(licence, ()), text)
        templates = given
    wanted = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted)
        kind = pa.list_(pa.struct([("licence", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("past_word", pa.int64())]))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                found = scanner.scan(data, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(m[0] for m in x) for x in found], pa.string()), pa.array([[dict(zip(("licence", "containment", "first_word", "past_word"), m)) for m in x] for x in found], kind)],
                    ["id", "n_licences", "licences", "matches"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_licences long, licences string, matches array<struct<licence:string,containment:double,first_word:long,past_word:long>>"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
