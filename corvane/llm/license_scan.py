"""Licence scan: a trained paragraph classifier whose hits templates must confirm.

Paragraphs (lines with a word) are bags of hashed word unigrams and bigrams; a multinomial logistic regression gives each licence
family and the class "unknown" a probability. It is trained on templates with words dropped, swapped in or added, and on a bounded
sample of corpus paragraphs: those that contain nearly all of a template carry its family, those that share little are unknown.
Half of that sample calibrates: a temperature by likelihood, then the smallest probability at which hits are right often enough.
A hit counts only if the paragraph holds most word pairs of one of the family's templates.

A notice may be wrapped: runs of adjacent lines that together hold most word pairs of a template are classified too, with what a
template's length can reach of their outer lines. Comment marks are not words. Such a hit has the number of its first line; it
replaces unconfirmed hits of its family on its lines, and is left out if one of its lines has a confirmed hit of the family.

Cases: null and empty texts have no paragraphs; repeated rows are scanned each; very long texts and lines are read whole; without
corpus paragraphs the classifier is trained on templates alone; an empty table gives an empty table; input columns named like a
result are replaced.
"""

from __future__ import annotations

import math
import random
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.llm.common import map_text

# Short notices of public licences, as their stewards recommend them.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Released under the BSD 3-Clause License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
CLASSES = ["unknown", *TEMPLATES]
#: Hashed features, corpus paragraphs that the fit may see (half of them to calibrate), and altered copies per template.
FEATURES, MOST_PARAGRAPHS, COPIES = 1 << 14, 6000, 40
#: Share of a template's word pairs that confirms a hit, and that makes a corpus paragraph a training example of the family.
CONFIRM, LABEL = 0.6, 0.8
#: Wanted share of right hits when the threshold is chosen.
PRECISION = 0.995
_WORD = re.compile(rb"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]|[^\x00-\x7f]+")


def words(line: bytes) -> list[bytes]:
    return _WORD.findall(line.lower())


def features(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of all lines in a row, and where each line begins; every line has a bias feature (0)."""
    known: dict[bytes, int] = {}
    for w in set().union(*lines) if lines else ():
        known[w] = crc32(w)
    sizes = np.array([len(x) for x in lines], np.int64)
    flat = np.fromiter((known[w] for x in lines for w in x), np.int64, int(sizes.sum()))
    line = np.repeat(np.arange(len(lines)), sizes)
    pair = (flat[:-1] * 31 + flat[1:] * 17 + 7) % 4294967291
    same = line[1:] == line[:-1]
    ids = np.concatenate([np.zeros(len(lines), np.int64), 1 + flat % (FEATURES - 1), 1 + pair[same] % (FEATURES - 1)])
    of = np.concatenate([np.arange(len(lines)), line, line[1:][same]])
    order = np.argsort(of, kind="stable")
    return ids[order], np.searchsorted(of[order], np.arange(len(lines)))


def log_probabilities(weights: np.ndarray, lines: list[list[bytes]], temperature: float = 1.0) -> np.ndarray:
    ids, starts = features(lines)
    count = np.diff(np.append(starts, len(ids)))[:, None]
    z = np.add.reduceat(weights[ids], starts, axis=0) / np.sqrt(count) / temperature
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def pairs(line: list[bytes]) -> set:
    return set(zip(line, line[1:]))


_TEMPLATE_PAIRS = {f: [pairs(words(t.encode())) for t in ts] for f, ts in TEMPLATES.items()}


def similarity(line: list[bytes], family: str) -> float:
    """Largest share of a template's word pairs that the paragraph holds."""
    held = pairs(line)
    return max((len(t & held) / len(t) for t in _TEMPLATE_PAIRS[family]), default=0.0)


_ALL_PAIRS = frozenset().union(*[t for ts in _TEMPLATE_PAIRS.values() for t in ts])
#: Words of the longest template, and the fewest word pairs that confirm any.
WIDEST = max(len(words(t.encode())) for ts in TEMPLATES.values() for t in ts)
FEWEST = min(math.ceil(CONFIRM * len(t)) for ts in _TEMPLATE_PAIRS.values() for t in ts)


def wrapped(lines: list[list[bytes]], block: list[int]) -> list[tuple[int, int, str, float, list[bytes]]]:
    """First and last line, family, similarity and words of runs of lines of one ``block`` that would confirm the family."""
    held = [_ALL_PAIRS.intersection(zip(x, x[1:])) for x in lines]
    found = []
    for i in range(len(lines) - 1):
        if block[i + 1] != block[i] or not (held[i] or (lines[i][-1], lines[i + 1][0]) in _ALL_PAIRS):
            continue
        shared, text, j = set(held[i]), lines[i][-WIDEST:], i + 1
        inner = 0
        while j < len(lines) and block[j] == block[i] and inner < WIDEST:
            shared |= held[j]
            shared |= _ALL_PAIRS & {(lines[j - 1][-1], lines[j][0])}
            if len(shared) >= FEWEST:
                whole = text + lines[j][:WIDEST]
                for family, templates in _TEMPLATE_PAIRS.items():
                    if any(len(t & shared) >= CONFIRM * len(t) for t in templates) and (near := similarity(whole, family)) >= CONFIRM:
                        found.append((i, j, family, near, whole))
            inner += len(lines[j])
            text = text + lines[j]
            j += 1
    return found


def altered(seed: int = 5) -> list[tuple[list[bytes], int]]:
    """Templates with words dropped, put in, or text around them."""
    rnd, out = random.Random(seed), []
    around = [b"copyright", b"2021", b"the", b"authors", b"all", b"rights", b"reserved", b"see", b"file", b"project", b"text", b"and", b"of"]
    for k, family in enumerate(TEMPLATES, 1):
        for t in TEMPLATES[family]:
            base = words(t.encode())
            out.append((base, k))
            for _ in range(COPIES):
                line = [w for w in base if rnd.random() > 0.06]
                line = rnd.choices(around, k=rnd.randint(0, 4)) + line + rnd.choices(around, k=rnd.randint(0, 4))
                out.append((line, k))
    # words that notices share, without a licence's name
    common = sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t.encode())} - {b"apache", b"mit", b"gnu", b"bsd", b"mozilla", b"creative", b"cc"})
    out += [(rnd.choices(common + around, k=rnd.randint(2, 12)), 0) for _ in range(8 * COPIES)]
    return out


def fit(rows: list[tuple[list[bytes], int]], steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression by full-batch gradients over the sparse features (a bounded number of rows)."""
    lines, y = [x for x, _ in rows], np.array([k for _, k in rows])
    ids, starts = features(lines)
    count = np.diff(np.append(starts, len(ids)))
    row = np.repeat(np.arange(len(lines)), count)
    used, column = np.unique(ids, return_inverse=True)
    share = 1 / np.sqrt(count)
    # every class weighs the same
    weight = 1.0 / np.bincount(y, minlength=len(CLASSES))[y] / len(CLASSES)
    w, mean, square = np.zeros((len(used), len(CLASSES))), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.add.reduceat(w[column], starts, axis=0) * share[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        miss = -p / p.sum(axis=1, keepdims=True)
        miss[np.arange(len(y)), y] += 1
        miss *= (weight * share)[:, None]
        slope = np.stack([np.bincount(column, miss[row, k], len(used)) for k in range(len(CLASSES))], axis=1) - decay * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    out = np.zeros((FEATURES, len(CLASSES)), np.float32)
    out[used] = w
    return out


def calibrate(weights: np.ndarray, rows: list[tuple[list[bytes], int]]) -> tuple[float, float]:
    """Temperature and least probability of a hit, from rows that the fit has not seen."""
    if not rows:
        return 1.0, 0.9
    lines, y = [x for x, _ in rows], np.array([k for _, k in rows])
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -log_probabilities(weights, lines, t)[np.arange(len(y)), y].mean())
    p = np.exp(log_probabilities(weights, lines, temperature))
    best, top = p.argmax(axis=1), p.max(axis=1)
    for level in np.arange(0.5, 0.96, 0.05):
        hits = (best > 0) & (top >= level)
        if not hits.any() or (best[hits] == y[hits]).mean() >= PRECISION:
            return temperature, float(level)
    return temperature, 0.95


def train(df: DataFrame, text: str = "text") -> tuple[np.ndarray, float, float]:
    """Weights, temperature and threshold, from templates and a bounded sample of the corpus's paragraphs."""
    lines = df.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    marked = F.lower("line").rlike("licen|redistribut|permission|creative commons|public domain")
    seen = []
    for part in (lines.where(marked), lines.where(~marked)):
        n = part.count()
        sample = part.sample(min(1.0, MOST_PARAGRAPHS / 2 / n), seed=3).limit(MOST_PARAGRAPHS) if n else part
        seen += [words(r["line"].encode()) for r in sample.collect()]
    labelled = []
    for line in seen:
        near = {f: similarity(line, f) for f in TEMPLATES}
        family = max(near, key=near.get)
        if near[family] >= LABEL:
            labelled.append((line, CLASSES.index(family)))
        elif near[family] <= CONFIRM / 2:
            labelled.append((line, 0))
    labelled.sort()
    made = altered()
    weights = fit([x for x in labelled[::2] if x[0]] + made)
    return weights, *calibrate(weights, [x for x in labelled[1::2] if x[0]] + altered(seed=6))


HITS = T.ArrayType(T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()),
                                 T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType())]))


def scan_licenses(df: DataFrame, text: str = "text", model: tuple[np.ndarray, float, float] | None = None) -> DataFrame:
    """Adds ``n_paragraphs`` and ``license_hits``: per hit the paragraph's number, family, probability, similarity to the nearest
    template and whether that confirms it. No shuffle."""
    weights, temperature, level = model or train(df, text)
    shared = df.sparkSession.sparkContext.broadcast(weights)  # FEATURES x families floats

    def run(texts: list) -> dict[str, list]:
        lines, owner, block, n_blocks = [], [], [], 0
        for i, t in enumerate(texts):
            n_blocks += 1
            for line in (t or "").encode().split(b"\n"):
                found = words(line)
                if found:
                    lines.append(found)
                    owner.append(i)
                    block.append(n_blocks)
                else:
                    n_blocks += 1
        hits: list[list] = [[] for _ in texts]
        taken: dict[tuple[int, str], list[tuple[int, int]]] = {}
        counts = np.bincount(np.array(owner, np.int64), minlength=len(texts))
        first = np.cumsum(counts) - counts
        if lines:
            p = np.exp(log_probabilities(shared.value, lines, temperature))
            best, top = p.argmax(axis=1), p.max(axis=1)
            for k in np.flatnonzero((best > 0) & (top >= level)).tolist():
                family = CLASSES[best[k]]
                near = similarity(lines[k], family)
                hits[owner[k]].append({"paragraph": int(k - first[owner[k]]), "family": family, "probability": round(float(top[k]), 4),
                                       "similarity": round(near, 4), "confirmed": near >= CONFIRM})
        if runs := wrapped(lines, block):
            p = np.exp(log_probabilities(shared.value, [r[4] for r in runs], temperature))
            sure = [(r, float(q[k])) for r, q in zip(runs, p) if (k := int(q.argmax())) and q[k] >= level and CLASSES[k] == r[2]]
            # the nearest run first, then the shortest; each line belongs to one hit of a family
            for (i, j, family, near, _), top in sorted(sure, key=lambda x: (-x[0][3], x[0][1] - x[0][0], x[0][0])):
                mine, base = hits[owner[i]], int(first[owner[i]])
                spans = taken.setdefault((owner[i], family), [(h["paragraph"] + base,) * 2 for h in mine if h["family"] == family and h["confirmed"]])
                if any(a <= j and i <= b for a, b in spans):
                    continue
                spans.append((i, j))
                mine[:] = [h for h in mine if h["confirmed"] or h["family"] != family or not i <= h["paragraph"] + base <= j]
                mine.append({"paragraph": i - base, "family": family, "probability": round(top, 4), "similarity": round(near, 4), "confirmed": True})
                mine.sort(key=lambda h: h["paragraph"])
        return {"n_paragraphs": counts.tolist(), "license_hits": hits}

    return map_text(df, run, [("n_paragraphs", T.LongType()), ("license_hits", HITS)], text)
