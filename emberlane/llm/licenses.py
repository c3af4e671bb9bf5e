"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.text import U64, blocks, buffers, gram_hashes, mix, slice_hashes, stream
from emberlane.llm.toxicity import LOWER, tokens

SHINGLE = 5
#: Sixteen bands of two: windows and templates of Jaccard 0.6 meet with probability 1 - (1 - 0.36)^16 > 0.999, of 0.8 with
#: more than 0.9999999.
BANDS, ROWS = 16, 2

#: Wordings of license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def shingles(raw: np.ndarray, offsets: np.ndarray):
    """Hashes of SHINGLE lower-cased words in a row, their row and place there, and the words' bounds."""
    starts, ends, first = tokens(raw, offsets)
    words = slice_hashes(LOWER[raw], starts, ends, 1) if len(raw) else np.zeros(0, dtype=U64)
    grams = gram_hashes(words, SHINGLE)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(grams)]
    ok = np.arange(len(grams)) + SHINGLE <= first[row + 1] if len(grams) else np.zeros(0, dtype=bool)
    return grams, ok, row, starts, ends, first


class Templates:
    """An index of templates by bands of MinHash signatures, for each window length that occurs."""

    def __init__(self, templates, bands: int = BANDS, rows: int = ROWS):
        self.names, self.sets, self.bands, self.rows = [], [], bands, rows
        self.by_length: dict[int, list[int]] = defaultdict(list)
        self.buckets: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        self.seeds = stream(501, bands * rows)
        for name, text in templates:
            raw, offsets = buffers(pa.array([text]))
            grams, ok, *_ = shingles(raw, offsets)
            grams = grams[ok]
            if not len(grams):
                raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
            i = len(self.names)
            self.names.append(name)
            self.sets.append(np.unique(grams))
            self.by_length[self.window(len(grams))].append(i)
            for b, key in enumerate(self.keys(grams[None, :])[0].tolist()):
                self.buckets[self.window(len(grams)), b, key].append(i)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, dtype=U64)

    @staticmethod
    def window(n: int) -> int:
        """Window lengths for short templates are exact, then grow by quarters, so a template fills most of its window."""
        size = 1
        while size < n:
            size = max(size + 1, size * 5 // 4)
        return size

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Band keys [windows, bands] of shingle hashes [windows, length]."""
        out = np.zeros((len(windows), self.bands), dtype=U64)
        with np.errstate(over="ignore"):
            for b in range(self.bands):
                key = np.zeros(len(windows), dtype=U64)
                for r in range(self.rows):
                    key = mix(key * U64(31) + mix(windows ^ self.seeds[b * self.rows + r]).min(axis=1))
                out[:, b] = key
        return out

    def matches(self, grams: np.ndarray, ok: np.ndarray, row: np.ndarray, first: np.ndarray, least: float):
        """(row, template, containment, first and last shingle) of templates that a row's text contains.

        Windows of each length begin at every quarter of it, and at a row's last full window. A window that holds no
        template's shingle cannot share a band with one, so only windows around known shingles are signed.
        """
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1) if len(grams) else np.zeros(0, dtype=np.int64)
        hits = np.flatnonzero((self.known[at] == grams) & ok) if len(self.known) and len(grams) else at[:0]
        if not len(hits):
            return []
        base, total = first[row[hits]], np.maximum(0, first[row[hits] + 1] - first[row[hits]] - SHINGLE + 1)
        found: dict[tuple[int, int], list] = defaultdict(list)
        for length in self.by_length:
            step = max(1, length // 4)
            place = hits - base
            last = np.maximum(0, total - length)
            window = [base + last]
            for k in range(-(-length // step) + 1):
                start = (place // step - k) * step
                window.append((base + np.minimum(start, last))[start >= 0])
            window = np.unique(np.concatenate(window))
            r = row[window]
            m = np.maximum(0, first[r + 1] - first[r] - SHINGLE + 1)
            size = np.minimum(length, m - (window - first[r]))
            for i in range(0, len(window), 4096):
                w, n = window[i : i + 4096], size[i : i + 4096]
                inner = np.minimum(np.arange(length)[None, :], n[:, None] - 1)  # short rows repeat their last shingle
                sign = self.keys(grams[w[:, None] + inner])
                for b in range(self.bands):
                    keys, back = np.unique(sign[:, b], return_inverse=True)
                    for u, key in enumerate(keys.tolist()):
                        for t in self.buckets.get((length, b, key), ()):
                            for x in np.flatnonzero(back == u).tolist():
                                found[int(row[w[x]]), t].append(int(w[x]))
        out = []
        for (r, t), windows in found.items():
            low, high = int(first[r]), int(first[r + 1]) - SHINGLE + 1
            length = self.window(len(self.sets[t]))
            for w in sorted(set(windows)):
                a, b = max(low, w - length // 2), min(high, w + length + length // 2)
                part = grams[a:b]
                inside = np.flatnonzero(np.isin(part, self.sets[t]))
                share = len(np.unique(part[inside])) / len(self.sets[t])
                if share >= least:
                    out.append((r, t, share, a + int(inside[0]) - low, a + int(inside[-1]) - low))
        return out


def scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, containment, from_char, to_char: one row for each place where a document contains a license notice.

    Whole texts, lower-cased words, shingles of five. A notice is found if at least this share of its shingles stands
    together; of matches that overlap in a document the one with the larger containment stays (then the longer, the
    earlier, the first in the list). Null and empty texts and texts of under five words match nothing; repeated rows give
    repeated results. The templates are a fixed list in every task; documents are never shuffled.
    """
    index = Templates(templates)

    def search(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j in blocks(offsets):
                part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                grams, ok, row, starts, ends, first = shingles(part, rows)
                by_row = defaultdict(set)
                for r, t, share, a, b in index.matches(grams, ok, row, first, least):
                    by_row[r].add((-share, a - b, a, t, b))
                out = []
                for r in sorted(by_row):
                    taken = []
                    for share, _, a, t, b in sorted(by_row[r]):
                        if all(b < x or a > y for x, y, *_ in taken):
                            taken.append((a, b, t, -share))
                    base = int(rows[r])
                    for a, b, t, share in sorted(taken):
                        p, q = int(starts[first[r] + a]), int(ends[first[r] + b + SHINGLE - 1])
                        count = lambda x, y: int(((part[x:y] & 0xC0) != 0x80).sum())
                        out.append((i + r, index.names[t], share, count(base, p), count(base, q)))
                columns = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())],
                    names=["doc_id", "license", "containment", "from_char", "to_char"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, license string, containment double, from_char int, to_char int")
