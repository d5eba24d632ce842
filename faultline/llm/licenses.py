"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template of s shingles is looked for in windows of 2C shingles at distance C, where C is the power of two at or above
s, so each occurrence lies whole in a window. Each band is one minimum. A window that holds a share `t` of the template
has a similarity of t*s / (2C + (1-t)*s) at least, from which the number of bands follows: see bands_for().

Defined results: null and blank texts have no match; repeated rows repeat their matches. Words are runs of letters,
digits and non-ASCII characters, with A-Z lower-cased. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, ship, text_slices

#: Words of a shingle, share of a template's shingles that a match has, and how seldom a window that has it is missed.
SHINGLE, CONTAINED, MISSED = 5, 0.8, 1e-6

# License notices as their licenses word them.
TEMPLATES = {
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-short": "GNU General Public License, version 3",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
# Short forms: so few words (eight at most) that a match has all of them, as the version is often the last.
SHORT = {
    "MIT": [
        "Licensed under the MIT License",
        "Distributed under the MIT License",
        "Available under the MIT License",
        "Under the terms of the MIT License",
        "The MIT License (MIT)",
        "Licensed under MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License 2.0",
        "Licensed under the Apache 2.0 License",
        "Licensed under Apache 2.0",
        "Apache License, Version 2.0",
    ],
    "GPL-2.0": [
        "GNU General Public License, version 2",
        "GNU General Public License v2",
        "GNU GPL version 2",
        "Licensed under the GPL version 2",
        "Licensed under the GPLv2",
        "Licensed under GPLv2",
    ],
    "GPL-3.0": [
        "GNU General Public License v3",
        "GNU GPL version 3",
        "Licensed under the GPL version 3",
        "Licensed under the GPLv3",
        "Licensed under GPLv3",
    ],
    "LGPL-2.1": [
        "GNU Lesser General Public License, version 2.1",
        "GNU Lesser General Public License v2.1",
        "GNU LGPL version 2.1",
        "Licensed under the LGPL version 2.1",
    ],
    "LGPL-3.0": [
        "GNU Lesser General Public License, version 3",
        "GNU Lesser General Public License v3",
        "GNU LGPL version 3",
        "Licensed under the LGPL version 3",
    ],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "Licensed under the AGPL version 3"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause License", "3-Clause BSD License"],
    "BSD": ["governed by a BSD-style license", "Licensed under the BSD License"],
    "ISC": ["Licensed under the ISC License", "Released under the ISC License", "Licensed under ISC"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Licensed under CC0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"],
}
SPDX = [
    "MIT",
    "Apache-2.0",
    "GPL-2.0",
    "GPL-3.0",
    "LGPL-2.1",
    "LGPL-3.0",
    "AGPL-3.0",
    "BSD-2-Clause",
    "BSD-3-Clause",
    "0BSD",
    "ISC",
    "MPL-2.0",
    "EPL-2.0",
    "BSL-1.0",
    "EUPL-1.2",
    "Zlib",
    "WTFPL",
    "Unlicense",
    "CC0-1.0",
    "CC-BY-4.0",
    "CC-BY-SA-4.0",
    "CC-BY-ND-4.0",
    "CC-BY-NC-4.0",
    "CC-BY-NC-SA-4.0",
    "CC-BY-NC-ND-4.0",
]
TEMPLATES |= {f"{name}-short-{k}": text for name, forms in SHORT.items() for k, text in enumerate(forms, 1)}
TEMPLATES |= {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in SPDX}

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def bands_for(size: int, width: int, t: float = CONTAINED) -> int:
    """Bands so that a window with a share t of a template of `size` shingles is missed with probability MISSED at most."""
    similarity = math.ceil(t * size) / (2 * width + size - math.ceil(t * size))
    return math.ceil(math.log(MISSED) / math.log(1 - similarity))


class Templates:
    """Templates grouped by shingle length and window width, with the minimum of each band."""

    def __init__(self, texts: dict[str, str], t: float = CONTAINED) -> None:
        self.t, self.names = t, list(texts)
        w = Words(pa.array(list(texts.values())), _BREAK)
        self.sets, self.groups = [], {}
        for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            n = min(SHINGLE, b - a)
            part = Words(pa.array([texts[self.names[i]]]), _BREAK)
            self.sets.append(np.unique(part.rolled(n)) if n else np.zeros(0, np.uint64))
            if n:
                width = 1 << (len(self.sets[-1]) - 1).bit_length()
                self.groups.setdefault(n, {}).setdefault(width, []).append(i)
        self.bands = {
            n: {width: max(bands_for(len(self.sets[i]), width, t) for i in own) for width, own in by.items()} for n,
            by in self.groups.items()
        }
        self.factors = mix(np.arange(1, 1 + max((b for by in self.bands.values() for b in by.values()), default=1), dtype=np.uint64)) | np.uint64(1)
        # the minimum of each template in each band
        self.least = [np.array(
            [(own * factor).min() for factor in self.factors],
            np.uint64,
        ) if len(own) else np.zeros(0, np.uint64) for own in self.sets]

    def candidates(self, shingles: np.ndarray, n: int) -> set[tuple[int, int, int]]:
        """(first shingle, end, template) of windows that have a template's minimum in some band."""
        out: set[tuple[int, int, int]] = set()
        top = max(self.groups[n])
        padded = np.full(-(-(len(shingles) + 1) // (2 * top)) * 2 * top, np.iinfo(np.uint64).max, np.uint64)
        lows = np.empty_like(padded)
        for band, factor in enumerate(self.factors[: max(self.bands[n].values())]):
            padded[: len(shingles)] = shingles * factor
            lows, width = padded, 1
            for want, own in sorted(self.groups[n].items()):
                while width < want:
                    lows, width = np.minimum(lows[0::2], lows[1::2]), width * 2
                if band >= self.bands[n][want]:
                    continue
                window = np.minimum(lows[:-1], lows[1:]) if len(lows) > 1 else lows
                least = {i: self.least[i][band] for i in own}
                if len(own) > 8:
                    known = np.array(sorted(set(least.values())), np.uint64)
                    place = np.minimum(np.searchsorted(known, window), len(known) - 1)
                    hits = np.flatnonzero(known[place] == window)
                    found = [(i, hits[window[hits] == v]) for i, v in least.items()]
                else:
                    found = [(i, np.flatnonzero(window == v)) for i, v in least.items()]
                for i, hits in found:
                    out.update((int(h) * want, int(h) * want + 2 * want, i) for h in hits)
        return out

    def matches(self, w: Words) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, end, share) of each text's matches."""
        out: dict[tuple[int, int, int], tuple[int, float]] = {}
        for n in self.groups:
            shingles = w.rolled(n)
            for first, end, i in self.candidates(shingles, n):
                at = np.arange(first, min(end, len(shingles)))
                at = at[np.isin(shingles[at], self.sets[i])]
                text = np.searchsorted(w.first, at, "right") - 1
                at = at[w.first[text + 1] >= at + n]
                text = np.searchsorted(w.first, at, "right") - 1
                for one in np.unique(text):
                    own = at[text == one]
                    share = len(np.unique(shingles[own])) / len(self.sets[i])
                    if share >= self.t:
                        key = int(one), i, int(own[0] - w.first[one])
                        out[key] = max(out.get(key, (0, 0.0)), (int(own[-1] + n - w.first[one]), share))
        rows: list[tuple[int, int, int, int, float]] = []
        for (text, i, start), (end, share) in sorted(out.items()):
            if rows and rows[-1][:2] == (text, i) and start < rows[-1][3]:  # two windows saw parts of one occurrence
                rows[-1] = text, i, rows[-1][2], max(end, rows[-1][3]), max(share, rows[-1][4])
            else:
                rows.append((text, i, start, end, share))
        return rows


def texts_of(templates: DataFrame) -> dict[str, str]:
    """Templates of a table (name, text): a list of licenses, which every task gets. Rows without a name or a text are none;
    of rows that share a name, the longest text counts."""
    rows = templates.select("name", F.col("text").cast("string").alias("text")).where("name is not null and text is not null")
    return {r["name"]: r["x"]["text"] for r in rows.groupBy("name").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("x")).collect()}


def scan(documents: DataFrame, texts: dict[str, str] | None = None, t: float = CONTAINED) -> DataFrame:
    """doc_id, license, start, end (words, end exclusive) and share: each match of a template in each document."""
    ship(documents.sparkSession)
    templates = Templates(texts or TEMPLATES, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = templates.matches(Words(part.column(1), _BREAK))
                text, which, start, end, share = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(text, pa.int64())),
                        pa.array([templates.names[i] for i in which], pa.string()),
                        pa.array(start, pa.int64()),
                        pa.array(end, pa.int64()),
                        pa.array(share, pa.float64()),
                    ],
                    names=["doc_id", "license", "start", "end", "share"],
                )

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, license string, start long, end long, share double")
