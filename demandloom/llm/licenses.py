"""License texts in documents: MinHash over overlapping windows retrieves templates, exact containment verifies them.

A document is its row of five-word shingles. Templates of more than ``SHORT`` shingles are put in size classes (ratio
1.25); for each class windows of that size start every eighth of it. A window retrieves a template if one of ``BANDS``
MinHash values (bands of one value) agrees. A template of which 0.8 are in a document has a similarity of at least
0.47 to some window, and is missed with a probability below 1e-6 (``missed``). For shorter templates a window is one
shingle and a band its value, so that any shared shingle retrieves them. What is retrieved is verified: at least 0.8 of
the template's distinct shingles must stand within twice its length around the window. Whole texts are scanned, in
overlapping stretches.

Null and empty texts match nothing. Templates of fewer than five words are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import rows_of
from demandloom.llm.shingles import WORDS, MinHash, in_order, words_of

THRESHOLD = 0.8
BANDS = 24
SHORT = 8
RATIO = 1.25
STRETCH = 20_000
_MINHASH = MinHash(BANDS, seed=9)

# Short notices and opening passages of public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def missed(containment: float = THRESHOLD) -> float:
    """Bound on the probability that windows don't retrieve a long template of which this share is in a text."""
    overlap = containment - RATIO / 16
    return (1 - overlap / (1 + RATIO - overlap)) ** BANDS


@dataclass
class _Template:
    name: str
    grams: np.ndarray
    minima: np.ndarray
    window: int


def _compiled(templates: dict[str, str]) -> list[_Template]:
    out = []
    for name in sorted(templates):
        words = words_of(templates[name])
        if len(words) < WORDS:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
        grams = np.unique(in_order(words))
        window, long = 1, len(words) - WORDS + 1
        if long > SHORT:
            size = float(SHORT)
            while size < long:
                size *= RATIO
            window = int(np.ceil(size))
        out.append(_Template(name, grams, _MINHASH.minima(grams), window))
    return out


class Scanner:
    """Matches of templates in one text."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = _compiled(templates)
        self.short = [t for t in self.templates if t.window == 1]
        self.short_grams = np.unique(np.concatenate([t.grams for t in self.short])) if self.short else np.empty(0, np.uint64)
        self.classes: dict[int, list[_Template]] = {}
        for t in self.templates:
            if t.window > 1:
                self.classes.setdefault(t.window, []).append(t)
        self.widest = max([2 * SHORT, *self.classes])

    def _retrieved(self, grams: np.ndarray) -> dict[str, list[tuple[int, int]]]:
        """Template -> stretches of shingles (from, to) to verify."""
        found: dict[str, list[tuple[int, int]]] = {}
        if len(self.short_grams):
            for at in np.flatnonzero(np.isin(grams, self.short_grams)).tolist():
                for t in self.short:
                    if grams[at] in t.grams:
                        reach = 2 * len(t.grams)
                        found.setdefault(t.name, []).append((max(0, at - reach), at + reach + 1))
        if not self.classes:
            return found
        values = _MINHASH.values(grams)
        for window, some in self.classes.items():
            stride = max(1, window // 8)
            low = np.minimum.reduceat(values, np.arange(0, len(grams), stride), axis=1)
            blocks = -(-window // stride)
            minima = low.copy()
            for k in range(1, min(blocks, low.shape[1])):  # a window is so many blocks; the last ones are shorter
                np.minimum(minima[:, :-k], low[:, k:], out=minima[:, :-k])
            for t in some:
                hits = np.flatnonzero((minima == t.minima[:, None]).any(axis=0))
                found.setdefault(t.name, []).extend((max(0, int(h) * stride - window // 2), int(h) * stride + window + window // 2) for h in hits)
        return {name: spans for name, spans in found.items() if spans}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, words) of the best match of each template found."""
        grams = in_order(words_of(text))
        by_name = {t.name: t for t in self.templates}
        best: dict[str, tuple[float, int, int]] = {}
        for start in range(0, max(1, len(grams)), STRETCH):
            part = grams[start : start + STRETCH + 2 * self.widest]
            if not len(part):
                break
            for name, spans in self._retrieved(part).items():
                own = by_name[name].grams
                for low, high in spans:
                    inside = np.isin(part[low:high], own)
                    share = len(np.unique(part[low:high][inside])) / len(own)
                    if share >= self.threshold - 1e-9:
                        places = np.flatnonzero(inside)
                        first, last = start + low + int(places[0]), start + low + int(places[-1])
                        match = (share, -first, last - first + WORDS)
                        if name not in best or match[:2] > best[name][:2]:
                            best[name] = match
        return [(n, m[0], -m[1], m[2]) for n, m in sorted(best.items())]


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license_id, containment, first_word, n_words: one row per document and template found in it."""
    templates = TEMPLATES if templates is None else templates
    _compiled(templates)  # errors show here, not in a task

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(templates, threshold)
        for batch in batches:
            for part in rows_of(batch, 1024):
                rows = [
                    (doc_id, *match)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for match in scanner.scan(text)
                ]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "license_id", "containment", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, license_id string, containment double, first_word int, n_words int"
    )
