"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates are grouped by size class S, a power of two of shingles. A text's shingles are cut into blocks of S, and any
two blocks side by side are a window: an occurrence of up to S shingles lies whole in one of them. A window's signature
is the least value of each of some hash functions, each a band of its own; windows are looked up in the sorted values of
a band's templates, and those that share one are candidates. A class has as many bands as it takes that a window which holds `share` of a template's shingles shares
none with a probability under `MISS`. Candidates are verified by the exact share of shingles in the window;
where templates overlap, that of which most shingles are there stays.

Templates are the full texts in license_texts/ and the notices below; a caller may give others.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.arrow import add_columns
from limpid.llm.words import ALNUM, cut, mix, slices, utf8

MISS = 1e-4
SHINGLE = 5
U = np.uint64

#: Notices that stand for a license without its text. Fixed values.
NOTICES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-license": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-distributed": "Distributed under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def known_templates() -> dict[str, str]:
    """The notices, and the texts in license_texts/ by their files' names with `-text` behind."""
    return NOTICES | {f"{p.stem}-text": p.read_text("utf-8", "replace") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("licenses", T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())])))])


def salt(band: int) -> np.uint64:
    """The odd factor that orders shingles' hashes in a band."""
    return mix(np.array([band + 1], U))[0] | U(1)


def bands_for(size: int, share: float) -> int:
    """Bands for templates of size / 2 < n <= size shingles: a window of 2 * size has `share` of n in common with them."""
    least = min(common / (2 * size + n - common) for n in range(size // 2 + 1, size + 1) for common in (math.ceil(share * n - 1e-9),))
    return math.ceil(math.log(MISS) / math.log(1 - least))


class Templates:
    """Shingles and band tables of templates, by size class."""

    def __init__(self, texts: dict[str, str], share: float):
        data, off = utf8(pa.array([*texts.values()], pa.string()))
        w = cut(data, off, ALNUM)
        self.names, self.sets, sizes = [], [], {}
        for d, name in enumerate(texts):
            n = int(w.counts[d])
            if n < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            own = np.unique(w.runs(np.arange(w.first[d], w.first[d + 1] - SHINGLE + 1), SHINGLE))
            sizes.setdefault(1 << (len(own) - 1).bit_length(), []).append(len(self.names))
            self.names.append(name)
            self.sets.append(own)
        #: For each size class and band: the sorted least values of its templates, and the templates in this order.
        self.bands: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in sorted(sizes):
            own = np.array(sizes[size])
            self.bands[size] = []
            for k in range(bands_for(size, share)):
                value = np.array([(self.sets[t] * salt(k)).min() for t in own], U)
                order = np.argsort(value, kind="stable")
                self.bands[size].append((value[order], own[order]))
        self.salts = [salt(k) for k in range(max(map(len, self.bands.values()), default=0))]


def scan_slice(w, templates: Templates, share: float) -> list[list[tuple]]:
    """For each text of a slice: (license, first word, end word, share) of each verified occurrence that stays."""
    out: list[list[tuple]] = [[] for _ in range(w.hi - w.lo)]
    at, first = w.starts_of(SHINGLE)
    if not len(at):
        return out
    h = w.runs(at, SHINGLE)
    count = np.diff(first)
    sizes = [*templates.bands]
    blocks, at_least = {}, None
    for size in sizes:
        n = -(-count // size)
        text = np.repeat(np.arange(len(count)), n)
        begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * size
        # Blocks of the class before lie whole in those of this one.
        blocks[size] = text, begin, np.cumsum(n)[n > 0] - 1, np.searchsorted(at_least, begin) if at_least is not None else begin
        at_least = begin
    found: dict[int, set[tuple[int, int]]] = {size: set() for size in sizes}
    for k, factor in enumerate(templates.salts):
        least = h * factor
        for size in sizes:
            _, _, last, cuts = blocks[size]
            least = np.minimum.reduceat(least, cuts) if size > 1 else least
            if k < len(templates.bands[size]):
                window = np.r_[least[1:], least[-1:]]
                window[last] = least[last]
                np.minimum(window, least, out=window)
                values, own = templates.bands[size][k]
                lo, hi = np.searchsorted(values, window, side="left"), np.searchsorted(values, window, side="right")
                for i in np.flatnonzero(lo < hi).tolist():
                    found[size] |= {(i, int(t)) for t in own[lo[i] : hi[i]]}
    for size in sizes:
        text, begin, _, _ = blocks[size]
        for i, t in sorted(found[size]):
            lo, d = int(begin[i]), int(text[i])
            hi = min(lo + 2 * size, int(first[d + 1]))
            mine = templates.sets[t]
            hit = np.flatnonzero(np.isin(h[lo:hi], mine))
            there = len(np.unique(h[lo:hi][hit]))
            if there >= share * len(mine) - 1e-9:
                a, e = int(at[lo + hit[0]] - w.first[d]), int(at[lo + hit[-1]] - w.first[d]) + SHINGLE
                out[d].append((there, there / len(mine), templates.names[t], a, e))
    return [apart(x) for x in out]


def apart(found: list[tuple]) -> list[tuple]:
    """Of overlapping (shingles there, share, license, start, end) that with most shingles, then the largest share, then
    the first in place and name; as (license, start, end, share) by place."""
    kept: list[tuple[int, int, str, float]] = []
    for _, share, name, a, e in sorted(set(found), key=lambda x: (-x[0], -x[1], x[3], x[2])):
        i = bisect_left(kept, (a, e))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or e <= kept[i][0]):
            kept.insert(i, (a, e, name, share))
    return [(name, a, e, share) for a, e, name, share in kept]


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, share: float = 0.8) -> DataFrame:
    """docs with n_words and licenses: (license, start, end, share), in words, by place.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; shingles have five. Of overlapping
    occurrences that of which most shingles are there stays, see apart(). Null and empty texts have none.
    Repeated rows get a result each. Columns of the results' names are replaced, all others are kept. The templates are
    a parameter of the driver's, with at least five words each; they are broadcast, some 8 bytes a word and 16 a band.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(known_templates() if templates is None else templates, share))

    def make(b: pa.RecordBatch) -> list:
        words, found = [], []
        for w in slices(b.column(text_col), ALNUM):
            words += w.counts.tolist()
            found += [[dict(zip(("license", "start", "end", "share"), x, strict=True)) for x in own] for own in scan_slice(w, shared.value, share)]
        return [words, found]

    return add_columns(docs, RESULT, make)


def license_names(col: str = "licenses"):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(col, lambda x: x["license"]))), ",")
