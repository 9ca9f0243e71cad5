"""License scans: Dice coefficient over word bigrams against licence notices and full licence texts.

A text is normalised to its words in lower case. It matches a template if some
window of it, any run of words, whatever lines, sentences or paragraphs it
crosses, has a set of word bigrams whose Dice coefficient with that of the
template is at least ``LEAST``; the best window counts. A window with a bigrams
can only reach that with templates of b bigrams for
LEAST / (2 - LEAST) <= a / b <= (2 - LEAST) / LEAST: others are not compared.

Null and empty texts match nothing. A text that matches several templates has
each of their licences once, with its best coefficient; ties go by name.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from functools import cache
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.sources.splits import spread

LEAST = 0.8

# Notices and short licence texts, by SPDX name; full texts are in ``licence_texts``.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}

FULL_TEXTS = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")

WORD = re.compile(r"[^\W_]+")
PARAGRAPH, LINE, SENTENCE = re.compile(r"\n[ \t]*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+")
Bigrams = frozenset[tuple[str, str]]


@cache
def all_templates() -> dict[str, list[str]]:
    """Notices and full texts by SPDX name; of the MIT text also the grant alone."""
    full = {name: pkgutil.get_data("noteflow.llm", f"licence_texts/{name}.txt").decode() for name in FULL_TEXTS}
    found = {name: [*NOTICES.get(name, []), *([full[name]] if name in full else [])] for name in sorted({*NOTICES, *full})}
    found["MIT"].append(PARAGRAPH.split(full["MIT"])[0])
    return found


def bigrams(text: str) -> Bigrams:
    words = WORD.findall(text.lower())
    return frozenset(zip(words, words[1:]))


class Templates:
    """The bigrams of each template."""

    def __init__(self, notices: dict[str, list[str]], least: float = LEAST) -> None:
        self.least = least
        self.all = [(name, bigrams(t)) for name, texts in sorted(notices.items()) for t in texts]
        self.known = frozenset().union(*(b for _, b in self.all))

    def bounds(self, n: int) -> tuple[int, int]:
        ratio = self.least / (2 - self.least)
        return ceil(n * ratio - 1e-9), floor(n / ratio + 1e-9)


def units(text: str) -> Iterator[str]:
    """The text, its paragraphs, lines and sentences: natural windows, to hold the scan against."""
    yield text
    paragraphs = PARAGRAPH.split(text)
    if len(paragraphs) > 1:
        yield from paragraphs
    lines = LINE.split(text)
    if len(lines) > 1:
        yield from lines
    for line in lines:
        sentences = SENTENCE.split(line)
        if len(sentences) > 1:
            yield from sentences


def best_window(before: np.ndarray, after: np.ndarray, hit: np.ndarray, n: int, bounds: tuple[int, int]) -> float:
    """Best Dice coefficient of any window with a template of n bigrams.

    before, after: the places where each place's bigram stands last and next; hit: whether the template
    has it. A best window begins and ends with a hit, and its first bigram does not come
    again inside (the window without it has the same set), so a start looks no further than that, nor
    than the largest size that can match.
    """
    low, high = bounds
    best, starts = 0.0, np.flatnonzero(hit)
    for i in starts.tolist():
        end, step = int(after[i]), 4 * high
        size = shared = 0
        for at in range(i, end, step):
            new = before[at : min(at + step, end)] < i
            a = size + np.cumsum(new)
            k = shared + np.cumsum(new & hit[at : at + len(new)])
            inside = int(np.searchsorted(a, high, side="right"))
            if inside and k[inside - 1] >= low:
                best = max(best, float((2 * k[:inside] / (a[:inside] + n)).max()))
            if inside < len(a):
                break
            size, shared = int(a[-1]), int(k[-1])
    return best


def best_matches(text: str, templates: Templates) -> dict[str, float]:
    """Best coefficient of each licence that a window of the text reaches."""
    return {name: dice for name, (dice, _) in sized_matches(text, templates).items()}


def sized_matches(text: str, templates: Templates) -> dict[str, tuple[float, int]]:
    """The same, and the bigrams of the largest template that reaches it."""
    best: dict[str, tuple[float, int]] = {}
    words = WORD.findall(text.lower())
    pairs = list(zip(words, words[1:]))
    shared = templates.known.intersection(pairs)
    # a window shares at least the lower size bound of bigrams with a template that it reaches, and so does the text
    able = [(name, b) for name, b in templates.all if len(b) and len(shared) >= templates.bounds(len(b))[0] and len(shared & b) >= templates.bounds(len(b))[0]]
    if not able:
        return best
    numbers: dict[tuple[str, str], int] = {}
    codes = np.fromiter((numbers.setdefault(p, len(numbers)) for p in pairs), np.int64, len(pairs))
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before, after = np.full(len(codes), -1), np.full(len(codes), len(codes))
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    for name, b in able:
        has = np.zeros(len(numbers), bool)
        has[[numbers[p] for p in shared & b]] = True
        dice = best_window(before, after, has[codes], len(b), templates.bounds(len(b)))
        if dice >= templates.least:
            best[name] = max(best.get(name, (0.0, 0)), (dice, len(b)))
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, n_licences, licence (the best, null if none), dice, licences (``name:coefficient`` by name).

    Of equal coefficients the one of the larger template is the best, then the
    first name: a text that another one contains does not hide it.
    """
    notices = all_templates() if notices is None else notices

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(notices, least)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                found = sized_matches(text, templates)
                first = min(found, key=lambda name: (-found[name][0], -found[name][1], name), default=None)
                best = {name: dice for name, (dice, _) in found.items()}
                rows.append((key, len(best), first, best.get(first), ",".join(f"{k}:{v:.4f}" for k, v in sorted(best.items()))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_licences", "licence", "dice", "licences"]).astype({"doc_id": "Int64"})

    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_licences long, licence string, dice double, licences string")
