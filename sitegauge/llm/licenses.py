"""License scans: MinHash bands over overlapping windows find templates, shingle containment verifies them."""

from __future__ import annotations

import math
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice

WORDS = 5
CONTAINMENT = 0.8
#: Chance with which a window that holds a template collides with it.
CONFIDENCE = 0.999999
CACHED_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")
#: Public notices and license texts to look for.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-whole": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


class WordHashes(dict):
    """lower-case word -> 64-bit hash; forgets all when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def tokens(text: str, hashes: WordHashes) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = (total + h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def occurrences(s: np.ndarray, template: np.ndarray, containment: float) -> list[tuple[int, int, float]]:
    """Where a template stands in a text, as (first, last, share) of shingles, by exact containment.

    Each shingle of the text that the template has tells where the template
    would start. Shingles whose starts lie no further apart than the part of
    the template that may be missing belong together; an occurrence is such a
    set with `containment` or more of the template's distinct shingles, of
    each the one that stands first. Where sets share text the fuller one
    counts, then the earlier one.
    """
    own, number = np.unique(template, return_inverse=True)
    drift = int((1 - containment) * len(own))
    order = np.argsort(number, kind="stable")  # offsets in the template by shingle
    first = np.searchsorted(number[order], np.arange(len(own) + 1))
    at = np.searchsorted(own, s)
    at[at == len(own)] = 0
    here = np.flatnonzero(own[at] == s)
    which = at[here]
    times = first[which + 1] - first[which]
    place, which = np.repeat(here, times), np.repeat(which, times)
    offset = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + first[which]]
    start = place - offset
    by = np.lexsort((place, start))
    place, which, start = place[by], which[by], start[by]
    least = containment * len(own) - 1e-9
    found: list[tuple[int, int, int]] = []  # minus the count, first, last
    cuts = np.flatnonzero(np.diff(start) > drift) + 1
    for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(start)).tolist(), strict=True):
        if hi - lo < least:
            continue
        ends = np.searchsorted(start[lo:hi], start[lo:hi] + drift, "right") + lo
        for i in (np.flatnonzero(np.append(True, np.diff(start[lo:hi]) > 0)) + lo).tolist():
            if ends[i - lo] - i < least:
                continue
            spot, shingle = place[i : ends[i - lo]], which[i : ends[i - lo]]
            held, earliest = np.unique(shingle[np.argsort(spot, kind="stable")], return_index=True)
            if len(held) >= least:
                spots = np.sort(spot)[earliest]
                found.append((-len(held), int(spots.min()), int(spots.max())))
    taken: list[tuple[int, int, float]] = []
    for n, a, b in sorted(found):
        k = bisect_left(taken, (a, b, 0.0))
        if (k == 0 or taken[k - 1][1] < a) and (k == len(taken) or b < taken[k][0]):
            taken.insert(k, (a, b, -n / len(own)))
    return taken


def bands_for(similarity: float, confidence: float = CONFIDENCE) -> int:
    """Bands of one row that collide with that probability at a similarity."""
    return math.ceil(math.log(1 - confidence) / math.log(1 - similarity))


@dataclass
class Template:
    name: str
    k: int  # words in a shingle; all of them in a template of fewer than WORDS
    whole: np.ndarray  # its shingles in order
    own: np.ndarray  # distinct shingles, sorted
    block: int  # a power of two, at least the template's length in shingles
    minima: np.ndarray


class Scanner:
    """Templates in classes of length; a class has windows of two blocks, one block apart, so one holds any occurrence whole."""

    def __init__(self, templates: dict[str, str], containment: float) -> None:
        self.containment, self.hashes = containment, WordHashes()
        found = []
        for name, text in templates.items():
            h = tokens(text, self.hashes)
            if not len(h):
                continue
            k = min(WORDS, len(h))
            all_shingles = shingles(h, k)
            found.append((name, k, all_shingles, np.unique(all_shingles), 1 << max(0, (len(all_shingles) - 1).bit_length())))
        # the least similarity of a window to a template that it holds to the containment asked for
        self.bands = {block: bands_for(min(containment * len(own) / (2 * block + (1 - containment) * len(own)) for _, _, _, own, b in found if b == block)) for block in {x[4] for x in found}}
        size = max(self.bands.values(), default=0)
        self.factors = np.array([xxhash.xxh64_intdigest(f"row {i}") | 1 for i in range(size)], np.uint64)
        self.templates = [Template(n, k, whole, own, b, (self.factors[: self.bands[b], None] * own[None, :]).min(1)) for n, k, whole, own, b in found]

    def windows(self, s: np.ndarray, k: int) -> dict[int, np.ndarray]:
        """MinHash rows of every window of the classes whose shingles have k words, by block, one column a window.

        A block's minima are those of the two half as long, so the shingles
        are hashed once for all classes.
        """
        blocks = sorted({t.block for t in self.templates if t.k == k})
        rows = self.factors[: max(self.bands[b] for b in blocks), None]
        step = max(8192, blocks[0])  # some thousand shingles at a time bound the table
        cuts = [s[lo : lo + step] for lo in range(0, len(s), step)]
        least = np.concatenate([np.minimum.reduceat(rows * c[None, :], np.arange(0, len(c), blocks[0]), axis=1) for c in cuts], axis=1)
        out, block = {}, blocks[0]
        while True:
            if block in blocks:
                own = least[: self.bands[block]]
                out[block] = np.minimum(own[:, :-1], own[:, 1:]) if own.shape[1] > 1 else own
            if block == blocks[-1]:
                return out
            if least.shape[1] % 2:
                least = np.concatenate([least, least[:, -1:]], axis=1)
            least, block = np.minimum(least[:, ::2], least[:, 1::2]), block * 2

    def find(self, text: str) -> list[dict]:
        """Every occurrence of a template: name, start and end in code points, share of its shingles that stand there."""
        h = tokens(text, self.hashes)
        made: dict[int, np.ndarray] = {}
        tables: dict[int, dict[int, np.ndarray]] = {}
        out: list[tuple[str, int, int, float]] = []
        for t in self.templates:
            if t.k not in made:
                made[t.k] = shingles(h, t.k)
            s = made[t.k]
            if not len(s):
                continue
            if t.k not in tables:
                tables[t.k] = self.windows(s, t.k)
            hit = np.flatnonzero((tables[t.k][t.block] == t.minima[:, None]).any(0))
            if not len(hit):
                continue
            # windows that touch are one stretch of text
            cuts = np.flatnonzero(np.diff(hit) > 2) + 1
            for near in np.split(hit, cuts):
                lo, hi = int(near[0]) * t.block, (int(near[-1]) + 2) * t.block
                out += [(t.name, lo + a, lo + b + t.k, share) for a, b, share in occurrences(s[lo:hi], t.whole, self.containment)]
        if not out:
            return []
        at = [m.span() for m in _WORD.finditer(text)] if len(text.lower()) == len(text) else [m.span() for m in _WORD.finditer(text.lower())]
        return [{"template": n, "start": at[a][0], "end": at[b - 1][1], "containment": c} for n, a, b, c in out]


FOUND = "array<struct<template:string,start:int,end:int,containment:double>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, start, end, containment: one row for each occurrence in docs.

    Words are runs of letters and digits in lower case. A template of fewer
    than five words is one shingle of all its words. A template that stands
    twice, side by side too, gives two rows, and words of it that stand
    elsewhere move no start. A null or empty text has none;
    repeated rows each give theirs; an empty table gives an empty result;
    other columns are ignored. The templates are a parameter and go to every
    task. Positions are code points; where lower case changes a text's length
    they are those of the lower-case text.
    """
    wanted = dict(templates if templates is not None else TEMPLATES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, containment)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [scanner.find(t or "") for t in b["text"].to_pylist()]
            some = pa.array([bool(f) for f in found])
            return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, shape)], ["doc_id", "found"]).filter(some)

        yield from by_slice(work)(batches)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, found {FOUND}")
    return rows.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
