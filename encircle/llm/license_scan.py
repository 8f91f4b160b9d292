"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Licence templates are split into words; every run of GRAM words has a hash, and the smallest hash of
every WINDOW consecutive runs is a fingerprint.  The fingerprints of all templates form an inverted
index of (template, position).  A text is fingerprinted the same way; runs with words that no
template has can never match and count as infinitely large, which only adds fingerprints.  Hits that
lie near one diagonal are one candidate.  A banded alignment of the template around that diagonal
(BAND words wide to either side, a quarter of the template for short ones, a fiftieth for long ones)
counts the words that agree in order, and gives the coverage of the template and the span of words in
the text.  A shared run of GRAM + WINDOW - 1 words always gives a candidate for templates of up to
LONG words; longer ones, which share common phrases with any text, need a hit per HIT_WORDS words.

The templates are short notices, and the standard headers (``-header``) and whole texts (``-full``)
of the files in ``licenses``, named by SPDX identifier; ``read_templates`` reads other folders.
They are sent to the tasks with the code; texts are read whole, row by row, without a shuffle.  Null and empty texts have no matches.  Repeated rows match alike.  Of overlapping
matches of one template the better one stays, of equal ones the earlier.  So does the better one of
two templates for much the same words, as the headers of the GNU licences are.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encircle.llm.shared import row_step

GRAM, WINDOW = 3, 2
BAND = 8
#: Words of a template up to which one hit is enough, and words per hit that longer ones need.
LONG, HIT_WORDS = 200, 20
COVERAGE = 0.8

#: Short notices of common licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Headers and whole texts, one file per template.
FOLDER = Path(__file__).parent / "licenses"

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def read_templates(folder: str | Path = FOLDER) -> dict[str, str]:
    """The texts of the ``.txt`` files in a folder by their names; read on the driver."""
    return {file.stem: file.read_text("utf-8") for file in sorted(Path(folder).glob("*.txt"))}


def _band(words: int) -> int:
    return max(min(BAND, words // 4), words // 50)


def _best_of(found: list[dict]) -> list[dict]:
    """Without matches that share most of their span with a better one of another template."""
    kept: list[dict] = []
    for m in sorted(found, key=lambda m: (-m["coverage"], -m["matched"], m["license"])):
        common = ((min(m["past"], o["past"]) - max(m["first"], o["first"]), o) for o in kept)
        if all(2 * c <= max(m["past"] - m["first"], o["past"] - o["first"]) for c, o in common):
            kept.append(m)
    return kept


def _winnowed(codes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints of a sequence of run codes (below zero: a run that cannot match)."""
    if not len(codes):
        return np.empty(0, np.int64)
    hashes = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    hashes = np.where(codes < 0, np.uint64(1 << 63), hashes)
    width = min(WINDOW, len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    # of equal hashes the last in the window
    places = np.unique(np.arange(len(windows)) + width - 1 - np.argmin(windows[:, ::-1], axis=1))
    return places[codes[places] >= 0]


def aligned(template: list[int], text: list[int], start: int, band: int = BAND) -> tuple[int, int, int]:
    """Words in common, first and last place in ``text``, of the best alignment within ``band`` of
    the diagonal on which the template begins at ``start``."""
    best: dict[int, tuple[int, int, int]] = {}  # place in text -> words, first, last (negated for ties)
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        left = (0, 0, 0)
        for j in range(max(0, start + i - band), min(len(text), start + i + band + 1)):
            options = [left, best.get(j, (0, 0, 0))]
            if text[j] == word:
                words, first, _ = best.get(j - 1, (0, 0, 0))
                options.append((words + 1, first if words else -j, -j))
            left = row[j] = max(options)
        if not row:
            if start + i < 0:
                continue  # the text begins inside the template
            break
        lowest = min(row)
        # what was reached before the band moved on stays reachable
        row[lowest - 1] = max((best[j] for j in best if j < lowest), default=(0, 0, 0))
        best = row
    words, first, last = max(best.values(), default=(0, 0, 0))
    return words, -first, -last


def common_words(template: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, which no alignment exceeds; bit-parallel."""
    masks: dict[int, int] = {}
    for j, word in enumerate(text):
        masks[word] = masks.get(word, 0) | 1 << j
    full = (1 << len(text)) - 1
    row = full
    for word in template:
        met = row & masks.get(word, 0)
        row = ((row + met) | (row - met)) & full
    return len(text) - row.bit_count()


def _scanner(templates: Mapping[str, str], coverage: float):
    def make():
        names = sorted(templates)
        split = [_words(templates[name]) for name in names]
        vocabulary = {w: i for i, w in enumerate(sorted({w for words in split for w in words}))}
        base = len(vocabulary) + 1

        def coded(ids: np.ndarray) -> np.ndarray:
            if len(ids) < GRAM:
                return np.empty(0, np.int64)
            count = len(ids) - GRAM + 1
            codes, known = np.zeros(count, np.int64), np.ones(count, bool)
            for j in range(GRAM):
                codes = codes * base + ids[j : j + count]
                known &= ids[j : j + count] >= 0
            return np.where(known, codes, -1)

        index: dict[int, list[tuple[int, int]]] = {}
        numbered = [[vocabulary[w] for w in words] for words in split]
        for t, ids in enumerate(numbered):
            codes = coded(np.array(ids, np.int64))
            for place in _winnowed(codes):
                index.setdefault(int(codes[place]), []).append((t, int(place)))
        wanted = np.array(sorted(index), np.int64)
        get = vocabulary.get

        def matches(text: str | None) -> list[dict]:
            words = _words(text)
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            codes = coded(ids)
            if not len(wanted) or not (wanted[np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)] == codes).any():
                return []
            starts: dict[int, dict[int, int]] = {}  # template -> diagonal -> hits
            for place in _winnowed(codes):
                for t, position in index.get(int(codes[place]), ()):
                    hits = starts.setdefault(t, {})
                    hits[int(place) - position] = hits.get(int(place) - position, 0) + 1
            plain, found = ids.tolist(), []
            for t, diagonals in sorted(starts.items()):
                kept: list[tuple] = []
                last = None
                size = len(numbered[t])
                band = _band(size)
                order = sorted(diagonals)
                upto = np.cumsum([0, *(diagonals[s] for s in order)])
                near = upto[np.searchsorted(order, np.add(order, band), "right")] - upto[np.searchsorted(order, np.subtract(order, band))]
                for start in np.array(order)[near >= (size // HIT_WORDS if size > LONG else 1)].tolist():
                    if last is not None and start - last <= band // 2:
                        continue  # well inside the band of the one before
                    last = start
                    around = plain[max(0, start - band) : max(0, start + size + band)]
                    if common_words(numbered[t], around) / size < coverage:
                        continue
                    common, first, end = aligned(numbered[t], plain, start, band)
                    share = common / size
                    if share >= coverage:
                        kept.append((-share, first, end + 1, common))
                taken: list[tuple] = []
                for match in sorted(kept):
                    if all(match[2] <= other[1] or match[1] >= other[2] for other in taken):
                        taken.append(match)
                found += [
                    {"license": names[t], "coverage": -m[0], "matched": m[3], "first": m[1], "past": m[2]} for m in taken
                ]
            return sorted(_best_of(found), key=lambda m: (m["first"], m["license"]))

        kind = pa.list_(
            pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first", pa.int32()), ("past", pa.int32())])
        )
        return lambda batch: [pa.array([matches(text) for text in batch.column(0).to_pylist()], kind)]

    return make


def scan_licenses(
    docs: DataFrame, text: str = "text", templates: Mapping[str, str] | None = None, coverage: float = COVERAGE
) -> DataFrame:
    """``docs`` with ``matches``: structs of license, coverage, matched words, and the span of words
    from ``first`` up to ``past``, in the order of the text.

    ``templates``: by name; all that come with the code by default."""
    if templates is None:
        templates = TEMPLATES | read_templates()
    match = T.StructType(
        [
            T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
            T.StructField("matched", T.IntegerType()), T.StructField("first", T.IntegerType()),
            T.StructField("past", T.IntegerType()),
        ]
    )
    inputs = {"text": F.col(f"`{text}`").cast("string")}
    return row_step(docs, inputs, _scanner(dict(templates), coverage), {"matches": T.ArrayType(match)})
