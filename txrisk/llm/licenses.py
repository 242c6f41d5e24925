"""License scans: MinHash bands of overlapping windows find templates, exact containment decides.

Texts and templates are runs of five-word shingles. A template is looked for through windows of a
power of two of shingles, the largest that it holds. Windows start at every shingle, in texts and in
templates alike, and each has ``BANDS`` MinHash values, one to a band. A text window that has half
of its shingles in common with a template window (by Jaccard) shares a band with it with probability
1 - 0.5 ** BANDS, so 0.999; equal windows always do.

What shares a band is verified: the share of the template's distinct shingles that stand in the text
where the template would lie, give or take a quarter of its length. ``CONTAINMENT`` of them makes a
match. Neighbouring matches of one template are one, the fullest.

Null and empty texts, and texts under five words, have no matches. Copies and repeated rows have the
same matches each; texts of any length are read whole; an empty table or an empty list of templates
gives no rows. Templates under five words are an error. Columns other than id and text are ignored.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from txrisk.llm import words as W

register_pickle_by_value(sys.modules[__name__])

BANDS, CONTAINMENT, LARGEST_WINDOW = 10, 0.8, 32
MAX_TEMPLATE_WORDS = 200_000  # all templates together; what the broadcast may hold
GATE_BITS = 20
MATCHES = (
    "id BIGINT, license STRING, first_word BIGINT, last_word BIGINT, matched INT, template_shingles INT, "
    "containment DOUBLE"
)

# Wordings of well-known licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
}


def runs(data, offsets):
    """(text, place of its first word in the text, hash) of every full five-word shingle, in order."""
    text, _, _, hashes = W.words(data, offsets)
    size = W.SHINGLE_WORDS
    if len(hashes) < size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    full = np.flatnonzero(text[:len(text) - size + 1] == text[size - 1:])
    factors, total = W._factors(size), np.zeros(len(full), np.uint64)
    for j in range(size):
        total += hashes[full + j] * factors[j]
    begins = np.searchsorted(text, text[full])
    return text[full], full - begins, W.mix(total)


def _band_values(shingles, band):
    return W.mix(shingles ^ np.uint64((band + 1) * W._STEP & (1 << 64) - 1))


def _minima(values, largest):
    """(window, minima of all windows of that many values) for 1, 2, 4 and so on up to ``largest``."""
    window = 1
    while len(values):
        yield window, values
        if window * 2 > largest or len(values) <= window:
            return
        values = np.minimum(values[:-window], values[window:])
        window *= 2


class Templates:
    """Templates as shingles, and their windows by band value."""

    def __init__(self, texts):
        self.names, self.shingles, self.sets = list(texts), [], []
        found = {}
        for number, name in enumerate(self.names):
            raw = texts[name].encode()
            _, _, shingles = runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if not len(shingles):
                raise ValueError(f"template {name} has fewer than {W.SHINGLE_WORDS} words")
            self.shingles.append(shingles)
            self.sets.append(np.unique(shingles))
            size = min(LARGEST_WINDOW, 1 << (len(shingles).bit_length() - 1))
            for band in range(BANDS):
                for window, minima in _minima(_band_values(shingles, band), size):
                    if window == size:
                        for place, value in enumerate(minima.tolist()):
                            found.setdefault((window, band), {}).setdefault(value, []).append((number, place))
        if sum(map(len, self.shingles)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words don't fit a broadcast")
        self.windows = found
        self.largest = max((window for window, _ in found), default=0)
        self.gates = {}
        for key, values in found.items():
            gate = np.zeros(1 << GATE_BITS, bool)  # quickly passes over values of no template
            gate[np.array(list(values), np.uint64) >> np.uint64(64 - GATE_BITS)] = True
            self.gates[key] = gate


def candidates(templates, shingles):
    """Distinct (template, shingle where it would begin) that share a band with the text."""
    found = set()
    for band in range(BANDS if templates.largest else 0):
        for window, minima in _minima(_band_values(shingles, band), templates.largest):
            gate = templates.gates.get((window, band))
            if gate is None:
                continue
            values = templates.windows[window, band]
            for at in np.flatnonzero(gate[minima >> np.uint64(64 - GATE_BITS)]).tolist():
                for number, place in values.get(int(minima[at]), ()):
                    found.add((number, at - place))
    return sorted(found)


def matches(templates, text, place, shingles, least=CONTAINMENT):
    """(text, template, first word, last word, shingles matched) of one batch of texts."""
    found = []
    for number, begin in candidates(templates, shingles):
        wanted, length = templates.sets[number], len(templates.shingles[number])
        slack = length // 4
        middle = min(max(begin + length // 2, 0), len(shingles) - 1)
        owners = {int(text[min(max(p, 0), len(text) - 1)]) for p in (begin, middle, begin + length - 1)}
        for owner in owners:
            low = max(begin - slack, int(np.searchsorted(text, owner)))
            high = min(begin + length + slack, int(np.searchsorted(text, owner, side="right")))
            if low >= high:
                continue
            part = shingles[low:high]
            at = np.minimum(np.searchsorted(wanted, part), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == part)
            count = len(np.unique(at[hit]))
            if count >= least * len(wanted):
                first = int(place[low + hit[0]])
                last = int(place[low + hit[-1]]) + W.SHINGLE_WORDS - 1
                found.append((owner, number, first, last, count))
    kept = []
    for match in sorted(set(found), key=lambda m: (m[0], m[1], m[2], -m[4])):
        if kept and kept[-1][:2] == match[:2] and match[2] <= kept[-1][3]:
            if match[4] > kept[-1][4]:
                kept[-1] = match
        else:
            kept.append(match)
    return kept


def scan(docs, texts=None, id_column="doc_id", text_column="text", least=CONTAINMENT):
    """One row per match: id, license, first and last word, and how much of the template is there."""
    templates = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if texts is None else texts))

    def search(tables):
        own = templates.value
        for table in tables:
            ids = table.column(0)
            for row, data, offsets in W.batches(table.column(1)):
                found = matches(own, *runs(data, offsets), least)
                if not found:
                    continue
                owners, numbers, firsts, lasts, counts = map(np.array, zip(*found))
                sizes = np.array([len(own.sets[n]) for n in numbers])
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(row + owners)), pa.array([own.names[n] for n in numbers]),
                    pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(counts, pa.int32()),
                    pa.array(sizes, pa.int32()), pa.array(counts / sizes),
                ], names=["id", "license", "first_word", "last_word", "matched", "template_shingles", "containment"])

    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.where(F.col("text").isNotNull()).mapInArrow(search, MATCHES).withColumnRenamed("id", id_column)
