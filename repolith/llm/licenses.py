"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm._common import mix, prepare

# Short public licence notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

WORD = re.compile(r"\w+")
_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    h = 0
    for b in word.encode("utf-8"):
        h = (h * 1000003 + b + 1) & 0xFFFFFFFFFFFFFFFF
    if len(_hashes) < 500_000:
        _hashes[word] = h
    return h


def shingles(text: str, width: int) -> np.ndarray:
    """64-bit hashes of the word shingles (letters lower-cased, punctuation dropped); a shorter text is one shingle."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    known = _hashes
    h = mix(np.array([known[w] if w in known else _hash(w) for w in words], np.uint64))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)


class Scanner:
    """Templates by class of window: windows of L shingles, half overlapping, hold any run of up to L / 2 + 1 shingles."""

    def __init__(self, templates: dict[str, str], width: int = 5, containment: float = 0.8, miss: float = 1e-3, seed: int = 3):
        self.width, self.containment = width, containment
        self.names = sorted(n for n, t in templates.items() if WORD.search(t))
        self.sets = [np.unique(shingles(templates[n], width)) for n in self.names]
        self.length = [len(shingles(templates[n], width)) for n in self.names]
        #: Window length of each template, and the least Jaccard similarity of a match with a window that holds it.
        self.window = [2 if n <= 2 else 1 << math.ceil(math.log2(2 * (n - 1))) for n in self.length]
        least = min(
            (math.ceil(containment * len(s)) / (w + len(s) - math.ceil(containment * len(s))) for s, w in zip(self.sets, self.window)),
            default=1.0
        )
        #: Bands of one row each: a match is retrieved with probability 1 - miss at least.
        self.bands = max(1, math.ceil(math.log(miss) / math.log(1 - min(least, 0.999))))
        rnd = np.random.default_rng(seed)
        self.salts = rnd.integers(1, 1 << 63, self.bands, dtype=np.int64).astype(np.uint64)
        self.signature = [self.minhash(s) for s in self.sets]
        self.any = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.any & np.uint64(0xFFFF)).astype(np.int64)] = True

    def minhash(self, s: np.ndarray) -> np.ndarray:
        return mix(s[:, None] ^ self.salts[None, :]).min(axis=0)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, best containment, matches, first word) of each template found in the whole text."""
        s = shingles(text, self.width)
        near = np.flatnonzero(self.low[(s & np.uint64(0xFFFF)).astype(np.int64)])
        near = near[np.isin(s[near], self.any)]
        # a window without any template's shingle has no band in common with a template
        if not len(near):
            return []
        out = []
        for length in sorted(set(self.window)):
            half, of = length // 2, [i for i, w in enumerate(self.window) if w == length]
            ends: dict[int, list[tuple[float, int, int]]] = {}
            for w in np.unique(np.concatenate([near // half - 1, near // half])).tolist():
                a = max(0, w * half)
                part = s[a : a + length]
                sig = self.minhash(part)
                for i in of:
                    if not (sig == self.signature[i]).any():
                        continue
                    start = max(0, a - half)
                    wide = s[start : a + length + half]
                    hit = np.flatnonzero(np.isin(wide, self.sets[i]))
                    share = len(np.unique(wide[hit])) / len(self.sets[i])
                    if share >= self.containment:
                        ends.setdefault(i, []).append((share, start + int(hit[0]), start + int(hit[-1])))
            for i, found in ends.items():
                matches, reach = 0, -1
                for _, a, b in sorted(found, key=lambda x: (x[1], x[2])):
                    matches += a > reach
                    reach = max(reach, b)
                out.append((self.names[i], max(f[0] for f in found), matches, min(f[1] for f in found)))
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] = NOTICES, width: int = 5, containment: float = 0.8, miss: float = 1e-3) -> DataFrame:
    """doc_id, license, containment, matches, first_word: a row for each document and template found in it.

    Whole texts are read row by row and nothing is shuffled; templates are few and
    travel with the task.  Null and empty texts have no match; a template shorter
    than ``width`` words is one shingle; repeated rows give repeated results;
    other columns are ignored; an empty table or no templates give no rows.
    """
    prepare(docs.sparkSession)

    def run(batches):
        scanner = Scanner(templates, width, containment, miss)
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for r in scanner.scan(t)]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [
                ("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()),
                ("matches", pa.int64()), ("first_word", pa.int64())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], names=[n for n, _ in kinds])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, license string, containment double, matches long, first_word long"
    )
