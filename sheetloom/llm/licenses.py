"""Licence scans by a trained paragraph classifier, confirmed against templates.

Every paragraph (line) of every text is read in overlapping windows of WINDOW words. Their word n-grams, hashed, go
through a multinomial logistic regression over licence families and a class for anything else. It is trained on the
templates below, cut, reworded by dropping words and set among words of ordinary paragraphs, against windows of such
paragraphs; a temperature, fitted on windows held out, makes its probabilities honest. A window whose best family has
less than SURE is unknown. A family is confirmed if a template's n-grams are mostly there, around the window, and all
that are confirmed count. Templates share wording: one counts beside others that fit better only if OWN of the n-grams
that it doesn't share with them are there. A window that is a licence by UNKNOWN or more but fits no template counts as
an unknown licence, also in a text that has known ones.

Ordinary paragraphs are drawn from at most SAMPLE documents, those with the smallest hashes of doc_id: of each the LINES
with the smallest hashes, wherever they stand in it, that are not empty and don't speak of licences; a paragraph gives
at most WINDOWS windows. The driver gets the doc_ids first, then their lines. Null and empty
texts have no licences; texts of any length are read whole; equal texts have equal results; rows are kept as they
come, with or without a doc_id.
Columns other than doc_id and text aren't looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, slices

WINDOW, STEP, ORDERS, BUCKETS = 24, 12, (1, 2, 3), 1 << 14
SAMPLE, LINES, WINDOWS, SURE, UNKNOWN, CONFIRMED, OWN = 400, 8, 6, 0.5, 0.95, 0.6, 0.75
LEGAL = "licen[sc]|copyright|rights reserved|public domain"
TOGETHER = 1_000_000
WORD = re.compile(r"[a-z0-9.+-]*[a-z0-9+]")

# Short notices by which licences are named.
TEMPLATES = {
    "agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "licensed under the gnu affero general public license version 3"],
    "apache-2.0": ["licensed under the apache license, version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache.org licenses license-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license", "licensed under the bsd 3-clause license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "text is available under the creative commons attribution-sharealike license"],
    "cc0": ["dedicated to the public domain under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "gpl": ["this work is licensed under the gnu general public license, version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "licensed under the gnu general public license version 2"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license, v. 2.0", "licensed under the mozilla public license 2.0"],
    "proprietary": ["all rights reserved", "no part of this publication may be reproduced distributed or transmitted in any form without the prior written permission of the publisher"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
#: Sentences that share words with licences and are none.
NEAR = ["the driver showed a license to the officer and drove on", "the public library is free and open to all", "general rights and duties of the public are a matter of law", "he released the version of the file in the morning", "a table was reserved for all of us at the source of the river", "the software was modified and distributed to every person in the office", "the mit campus and the apache river were part of the work", "creative work in the commons is for any purpose"]
FAMILIES = list(TEMPLATES)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(codes: np.ndarray, line: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each word, and whether the n-gram stays in its line."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.full(n, np.uint32(order))
    for k in range(order):
        h = (h ^ codes[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h % np.uint32(BUCKETS)).astype(np.int64), line[:n] == line[order - 1 :]


def codes_of(words: list[str], known: dict[str, int]) -> np.ndarray:
    for w in set(words) - known.keys():
        known[w] = zlib.crc32(w.encode())
    return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))


def window_sums(codes: np.ndarray, line: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of every line: mean weights of its n-grams (by class), its first word and its last (excluded)."""
    n = len(codes)
    edges = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1], [True]])) if n else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    many = np.maximum(1, -(-(sizes - WINDOW) // STEP) + 1)
    of = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    first = edges[:-1][of] + np.minimum(nth * STEP, np.maximum(sizes[of] - WINDOW, 0))
    last = np.minimum(first + WINDOW, edges[1:][of])
    total, count = np.zeros((len(of), weights.shape[1]), np.float32), np.zeros(len(of), np.float32)
    for order in ORDERS:
        b, ok = grams(codes, line, order)
        sums = np.zeros((len(b) + 1, weights.shape[1]), np.float64)
        np.cumsum(np.where(ok[:, None], weights[b], 0), axis=0, out=sums[1:])
        here = np.concatenate([[0], np.cumsum(ok)])
        end = np.maximum(np.minimum(last - order + 1, len(b)), np.minimum(first, len(b)))
        start = np.minimum(first, len(b))
        total += (sums[end] - sums[start]).astype(np.float32)
        count += here[end] - here[start]
    return total / np.maximum(count, 1)[:, None], first, last


class Scanner:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature, self.known = weights, bias, temperature, {}
        self.templates = [(f, self.parts(t)) for f, ts in TEMPLATES.items() for t in ts]

    @staticmethod
    def parts(text: str) -> set[tuple[str, ...]]:
        w = words_of(text)
        n = min(3, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def confirmed(self, has: dict[int, set[tuple[str, ...]]]) -> set[str]:
        """Families with a template whose n-grams are mostly among those there are, and not only by what a better one shares."""
        fits = []
        for f, t in self.templates:
            there = t & has[len(next(iter(t)))]
            if len(there) >= CONFIRMED * len(t):
                fits.append((len(there) / len(t), len(there), f, t))
        names: set[str] = set()
        told: set[tuple[str, ...]] = set()
        for _, _, f, t in sorted(fits, key=lambda x: (-x[0], -x[1], x[2])):
            own = t - told
            if f in names or own and len(own & has[len(next(iter(t)))]) >= (OWN if names else CONFIRMED) * len(own):
                names.add(f)
                told |= t
        return names

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def scan(self, texts: list[str]) -> list[tuple[list[str], int, float]]:
        """Of each text its licences (confirmed families, and 'unknown' for others), how many windows tell of one, and the surest."""
        out: list[tuple[list[str], int, float]] = []
        for start, end in slices(texts, TOGETHER):
            words, line, owner = [], [], []
            k = 0
            for i, text in enumerate(texts[start:end]):
                for part in text.split("\n"):
                    w = words_of(part)
                    words += w
                    line.append(np.full(len(w), k))
                    owner.append(i)
                    k += 1
            found: list[set[str]] = [set() for _ in range(end - start)]
            hits, best = [0] * (end - start), [0.0] * (end - start)
            lines = np.concatenate(line) if line else np.zeros(0, np.int64)
            if words:
                means, first, last = window_sums(codes_of(words, self.known), lines, self.weights)
                p = self.probabilities(means)
                some = np.flatnonzero(p[:, -1] < 1 - SURE)
                ends = np.searchsorted(lines, lines, side="right")
                starts = np.searchsorted(lines, lines, side="left")
                for x in some.tolist():
                    doc = owner[lines[first[x]]]
                    a, b = max(starts[first[x]], first[x] - WINDOW), min(ends[first[x]], last[x] + WINDOW)
                    has = {n: {tuple(words[i : i + n]) for i in range(a, b - n + 1)} for n in (1, 2, 3)}
                    names = self.confirmed(has)
                    if not names and p[x, -1] > 1 - UNKNOWN:
                        continue
                    found[doc] |= names or {"unknown"}
                    hits[doc] += 1
                    best[doc] = max(best[doc], float(1 - p[x, -1]))
            out += [(sorted(f), n, s) for f, n, s in zip(found, hits, best, strict=True)]
            if len(self.known) > 300_000:
                self.known.clear()
        return out


def fit(paragraphs: list[str], rounds: int = 400, seed: int = 1) -> Scanner:
    """A scanner trained on the templates and on ordinary paragraphs."""
    rng = np.random.default_rng(seed)
    ordinary = [w for w in (words_of(p) for p in paragraphs) if w] or [["the", "of", "and"]]
    noise = lambda n: [str(w) for w in (lambda p: [p[i % len(p)] for i in range(n)])(ordinary[rng.integers(len(ordinary))])]
    samples: list[tuple[list[str], int]] = []
    for k, family in enumerate(FAMILIES):
        for _ in range(120):
            w = words_of(TEMPLATES[family][rng.integers(len(TEMPLATES[family]))])
            if len(w) > 6:
                w = [x for x in w if rng.random() > 0.05]
            if len(w) > WINDOW - 4:
                at = rng.integers(0, len(w) - WINDOW // 2)
                w = w[at : at + WINDOW]
            spare = max(0, WINDOW - len(w))
            before = int(rng.integers(0, spare + 1)) if rng.random() < 0.6 else 0
            after = int(rng.integers(0, spare - before + 1)) if rng.random() < 0.6 else 0
            samples.append((noise(before) + w + noise(after), k))
    none = len(FAMILIES)
    for p in ordinary:
        samples += [(p[i : i + WINDOW], none) for i in range(0, max(1, len(p) - WINDOW // 2), WINDOW)][:WINDOWS]
        short, at = int(rng.integers(1, 9)), int(rng.integers(0, len(p)))
        samples.append((p[at : at + short], none))
    for _ in range(400):
        samples.append((noise(int(rng.integers(0, 8))) + words_of(NEAR[rng.integers(len(NEAR))]) + noise(int(rng.integers(0, 8))), none))
    rows, columns, values = [], [], []
    known: dict[str, int] = {}
    for i, (w, _) in enumerate(samples):
        codes = codes_of(w, known)
        parts = [b[ok] for b, ok in (grams(codes, np.zeros(len(w), int), o) for o in ORDERS)]
        b = np.concatenate(parts)
        rows.append(np.full(len(b), i))
        columns.append(b)
        values.append(np.full(len(b), 1 / max(1, len(b)), np.float32))
    rows, columns, values = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    y = np.array([k for _, k in samples])
    used, packed = np.unique(columns, return_inverse=True)
    share = np.where(y == none, 6.0, 1.0) / np.bincount(y, minlength=none + 1)[y]  # most of what is read is no licence
    held = rng.random(len(y)) < 0.2
    w, bias = np.zeros((len(used), none + 1)), np.zeros(none + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(held, 0, share / share[~held].sum())
    logits = lambda: np.add.reduceat(w[packed] * values[:, None], np.searchsorted(rows, np.arange(len(y)))) + bias
    target = np.eye(none + 1)[y]
    for t in range(1, rounds // 4 + 1):
        z = logits()
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - target) * weight[:, None]
        g = np.zeros_like(w)
        np.add.at(g, packed, d[rows] * values[:, None])
        g += 1e-6 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g**2
        w -= 1.0 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        bias -= 2 * d.sum(axis=0)
    z = logits()[held]
    loss = lambda t: -(z / t - np.log(np.exp(z / t - (z / t).max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - (z / t).max(axis=1, keepdims=True))[np.arange(len(z)), y[held]].mean()
    temperature = min(np.geomspace(0.2, 5, 25), key=loss)
    weights = np.zeros((BUCKETS, none + 1), np.float32)
    weights[used] = w
    return Scanner(weights, bias.astype(np.float32), float(temperature))


def scanned(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, licenses, n_windows, score) of each row: licences separated by commas, empty if none."""
    source = only(docs, doc_id="long", text="string")
    ids = source.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    drawn = source.join(F.broadcast(ids), "doc_id")  # at most `sample` ids
    plain = F.filter(F.split("text", "\n"), lambda p: (F.trim(p) != "") & ~F.lower(p).rlike(LEGAL))
    hashed = F.array_sort(F.transform(plain, lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p"))))
    chosen = drawn.groupBy("doc_id").agg(F.min(F.slice(hashed["p"], 1, LINES)).alias("lines")).orderBy(F.xxhash64("doc_id"), "doc_id")
    paragraphs = [p for r in chosen.collect() for p in r["lines"] or []]
    scanner = fit(paragraphs)
    shipped = docs.sparkSession.sparkContext.broadcast((scanner.weights, scanner.bias, scanner.temperature))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(*shipped.value)
        for batch in batches:
            found = own.scan([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([",".join(f) for f, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([round(s, 6) for _, _, s in found], pa.float64())], names=["doc_id", "licenses", "n_windows", "score"])

    return source.mapInArrow(run, "doc_id long, licenses string, n_windows long, score double")
