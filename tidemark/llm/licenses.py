"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are runs of ASCII letters and digits (lower-cased) and of other characters; shingles are five words. A template of s
shingles belongs to the smallest window size W >= max(4, 2 (s - 1)). Windows of W shingles begin every W / 2, so each
occurrence of the template lies whole in one window, which then shares at least s in W + (missing) shingles with it.
Each of ``HASHES`` minima is a band of its own: with a similarity of at least 1/4 (1/5 at containment 0.8) a window
misses all bands with probability under 1e-8 (1e-6). A window that shares a band is compared exactly: the share of
the template's shingles found in the window must reach ``CONTAINMENT``.

A window without any shingle of a template shares no minimum with one (the hash functions are one to one); stretches of text
without such shingles are passed over, which loses nothing. The templates are notices, grants and disclaimers; a licence
whose notice differs by a word or a version from another's may report both, each with its containment.

One Arrow map over whole texts, no shuffle. Defined results: null and empty texts have no licence; a licence
that occurs several times is listed once, with its best containment and first word; repeated rows are scanned alike;
other columns are carried.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_batches

SHINGLE, HASHES, CONTAINMENT = 5, 64, 0.8

# Notices by which public licences are named or granted.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                         "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT line": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
                 "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                 "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
                 "the following conditions:",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
                      "are met:",
    "MIT licence": "This project is licensed under the MIT License",
    "MIT short": "licensed under the MIT License",
    "MIT disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                      "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
                      "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
                      "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD clauses": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
                   "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
                   "materials provided with the distribution.",
    "BSD-3 endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                         "software without specific prior written permission.",
    "BSD disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
                      "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
                      "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
                      "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
                      "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
                      "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                 "copyright notice and this permission notice appear in all copies.",
    "ISC disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
                      "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
                      "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
                      "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
            "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
            "redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
                 "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                      "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0 name": "Mozilla Public License Version 2.0",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                      "https://www.eclipse.org/legal/epl-2.0",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                      "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
                    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
                       "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
                       "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
                       "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC0-1.0 notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public "
                      "domain worldwide. This software is distributed without any warranty.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}
# SPDX names, as they stand in tags.
SPDX = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
        "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
TEMPLATES |= {f"SPDX {name}": f"SPDX-License-Identifier: {name}" for name in SPDX}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ROWS = 1 << 14  # shingles hashed at once


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


class Scanner:
    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        rng = np.random.Generator(np.random.PCG64(7))
        self.a = rng.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, HASHES, np.uint64)
        self.containment, self.codes = containment, {}
        self.groups: dict[int, list[tuple[str, np.ndarray, frozenset]]] = {}
        for name, text in templates.items():
            words = words_of(text)
            if len(words) < SHINGLE:
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            exact = frozenset(zip(*(words[i:] for i in range(SHINGLE)), strict=False))
            size = 4
            while size < 2 * (len(words) - SHINGLE):
                size *= 2
            self.groups.setdefault(size, []).append((name, self.minima(self.shingles(words)).min(1), exact))
        self.any_shingle = np.unique(np.concatenate([self.shingles(words_of(t)) for t in templates.values()] or [np.zeros(0, np.uint64)]))

    def shingles(self, words: list[bytes]) -> np.ndarray:
        codes = self.codes
        for w in words:
            if w not in codes:
                codes[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
        if len(codes) > 500_000:
            codes.clear()
        out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            out = (out ^ h[i:len(h) - SHINGLE + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def minima(self, h: np.ndarray) -> np.ndarray:
        return self.a[:, None] * h + self.b[:, None]

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """``(template, containment, first word of the window)``, best per template, by name."""
        words = words_of(text)
        found: dict[str, tuple[float, int]] = {}
        if len(words) >= SHINGLE:
            h = self.shingles(words)
            places = np.flatnonzero(np.isin(h, self.any_shingle))
            for size in sorted(self.groups) if len(places) else []:
                for at in range(0, len(h), _ROWS):  # _ROWS is a multiple of every half window
                    if np.searchsorted(places, at) == np.searchsorted(places, at + _ROWS + size // 2):
                        continue
                    part = h[at:at + _ROWS + size // 2]
                    half = np.minimum.reduceat(self.minima(part), np.arange(0, len(part), size // 2), axis=1)
                    window = np.minimum(half[:, :-1], half[:, 1:]) if half.shape[1] > 1 else half
                    for name, signature, exact in self.groups[size]:
                        for k in np.flatnonzero((window == signature[:, None]).any(0)).tolist():
                            begin = at + k * (size // 2)
                            own = words[begin:begin + size + SHINGLE - 1]
                            share = len(exact & set(zip(*(own[i:] for i in range(SHINGLE)), strict=False))) / len(exact)
                            if share >= self.containment and share > found.get(name, (0.0, 0))[0]:
                                found[name] = share, begin
        return [(n, *found[n]) for n in sorted(found)]


def scan_licenses(df: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Every row of ``df`` without its text, plus n_licenses, licenses (JSON: name, containment, first word)."""
    given = dict(TEMPLATES if templates is None else templates)
    carried = [c for c in df.columns if c not in (text_col, "n_licenses", "licenses")]
    schema = T.StructType([df.schema[c] for c in carried] + [T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, containment)
        for batch in batches:
            hits = [scanner.scan(t) for t in batch.column(text_col).to_pylist()]
            shown = [json.dumps([[n, round(c, 6), w] for n, c, w in x]) for x in hits]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array([len(x) for x in hits], pa.int64()), pa.array(shown, pa.string())], schema.names)

    return map_batches(df.select(*carried, text_col), run, schema)
