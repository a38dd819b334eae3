"""Licence families of paragraphs: a sparse n-gram classifier, confirmed by templates."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.hashing import BYTE_VALUES, U64, Rolling, mix, word_spans

# Usual licence notices by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "PUBLIC-DOMAIN": ["This work has been released into the public domain.", "Dedicated to the public domain under CC0 1.0."],
    "PROPRIETARY": ["All rights reserved. No part of this publication may be reproduced without permission.", "Copyright 2020 the authors. All rights reserved."],
}
#: Paragraphs about licences that are none.
OTHERS = [
    "The driver renewed the license at the office.",
    "A license is required to fish in this lake.",
    "He studied public law and general management.",
    "The software version was released in spring under a new name.",
    "The committee granted permission to use the room without restriction.",
    "Apache helicopters flew over the base.",
    "Students at MIT published the work.",
]
UNKNOWN = "unknown"
BUCKETS = 1 << 18
_KEEP = np.array([(c if chr(c).isalnum() or c >= 128 else 32) for c in range(256)], np.uint8)
_KEEP[65:91] += 32


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Buckets of the words and word pairs of each paragraph, with the paragraph numbers."""
    clean = _KEEP[data]
    start, end, of = word_spans(clean, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), start
    one = Rolling(BYTE_VALUES[clean]).spans(start, end)
    pairs = np.flatnonzero(of[1:] == of[:-1])
    two = mix(one[pairs] * U64(3) + one[pairs + 1])
    bucket = np.concatenate((one, two)) % U64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate((of, of[pairs])), np.bincount(of, minlength=len(offsets) - 1)


def _paragraph_bytes(texts: list[str]):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


@dataclass
class Classifier:
    families: list[str]
    weight: np.ndarray  # buckets x classes, the last class unknown
    bias: np.ndarray
    temperature: float
    live: np.ndarray  # buckets with a weight

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, of, _ = _grams(data, offsets)
        n, live = len(offsets) - 1, self.live[bucket]  # most pairs of words are in no notice
        bucket, of_live = bucket[live], of[live]
        size = np.sqrt(np.maximum(1, np.bincount(of, minlength=n)))
        sums = np.stack([np.bincount(of_live, self.weight[bucket, k], minlength=n) for k in range(self.weight.shape[1])], axis=1)
        z = (sums / size[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(corpus: list[str], seed: int = 11, steps: int = 150) -> Classifier:
    """Train on pieces of the templates, ``OTHERS`` and ``corpus`` paragraphs (unknown); calibrate on a quarter kept aside."""
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    texts, y = [], []
    for k, family in enumerate(families):
        for text in TEMPLATES[family]:
            words = text.split()
            texts += [text] * 6
            y += [k] * 6
            for _ in range(10):  # numbers, years and leading words vary
                some = [str(rng.integers(1, 10)) + "." + str(rng.integers(0, 10)) if any(c.isdigit() for c in w) else w for w in words]
                lead = list(rng.choice(["This", "project", "file", "data", "Code", "is", "The", "text", "work"], rng.integers(0, 4)))
                texts.append(" ".join(lead + some))
                y.append(k)
            for at in range(0, len(words) - PIECE, PIECE // 2):  # as lines of a wrapped notice
                texts.append(" ".join(words[at : at + PIECE + 4]))
                y.append(k)
            for x in re.split(r"(?<=[.]) (?=[A-Z])", text):
                texts += [x] * (x not in _SHARED and x != text)
                y += [k] * (x not in _SHARED and x != text)
    some = OTHERS * 8 + list(corpus)
    texts += some
    y += [len(families)] * len(some)
    y, classes = np.array(y), len(families) + 1
    data, offsets = _paragraph_bytes(texts)
    bucket, of, _ = _grams(data, offsets)
    used, slot = np.unique(bucket, return_inverse=True)
    value = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(y))))[of]
    aside = rng.random(len(y)) < 0.25
    goal = np.eye(classes)[y]
    share = (1 / np.maximum(1, np.bincount(y[~aside], minlength=classes)))[y] * ~aside
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def logits():
        return np.stack([np.bincount(of, w[slot, k] * value, minlength=len(y)) for k in range(classes)], axis=1) + b

    for t in range(1, steps + 1):
        z = logits()
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = (z / z.sum(axis=1, keepdims=True) - goal) * share[:, None] / classes
        gw = np.stack([np.bincount(slot, g[of, k] * value, minlength=len(used)) for k in range(classes)], axis=1) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= 0.5 * g.sum(axis=0)
    w[np.abs(w) < 0.02] = 0  # sparse
    z = logits()[aside]

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[aside]] - np.log(np.exp(s).sum(axis=1))).mean())

    best = min(np.geomspace(0.3, 3, 25), key=loss) if aside.any() else 1.0
    full = np.zeros((BUCKETS, classes), np.float32)
    full[used] = w
    return Classifier(families, full, b, float(best), np.any(full != 0, axis=1))


def _shape(text: str) -> set[str]:
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    words = ["#" if w.isdigit() else w for w in words]
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


#: Words that say nothing of licences when they stand side by side.
_PLAIN = frozenset("a all and any are as at be been by for from has have in is it may not of on or that the this to under was will with".split())
#: Sentences of templates that name no family.
_SHARED = frozenset(["See the LICENSE file for details."])
#: Words of a paragraph from which on it counts as a piece of a template; shorter ones must hold a whole sentence.
PIECE = 8
#: Words without a pair of a template that a wrapped notice may hold in a row.
GAP = 8
_SHAPES = {family: [_shape(t) for t in texts] for family, texts in TEMPLATES.items()}
_SENTENCES = {
    family: [_shape(x) for t in texts for x in re.split(r"(?<=[.]) (?=[A-Z])", t) if x not in _SHARED and len(x.split()) >= 3]
    for family, texts in TEMPLATES.items()
}


def template_similarity(text: str, family: str) -> float:
    """Best share of a template's words and word pairs that the paragraph has, or the other way round for pieces.

    A paragraph of ``PIECE`` words or more also scores by the share of its own words and pairs that one template has.
    A paragraph with all words and pairs of a template's sentence scores 1, however short.
    """
    mine = _shape(text)
    if any(s <= mine for s in _SENTENCES[family]):
        return 1.0
    best = max((len(mine & t) / max(1, len(t)) for t in _SHAPES[family]), default=0.0)
    if sum(" " not in x for x in mine) >= PIECE:
        best = max(best, max((len(mine & t) / len(mine) for t in _SHAPES[family]), default=0.0))
    return best


def _template_pairs() -> np.ndarray:
    """Which buckets hold word pairs of templates, without pairs of plain words."""
    told = {f"{a} {b}" for texts in TEMPLATES.values() for t in texts for w in ["".join(c.lower() if c.isalnum() else " " for c in t).split()] for a, b in zip(w, w[1:]) if not (a in _PLAIN and b in _PLAIN)}
    out = np.zeros(BUCKETS, bool)
    for pair in told:
        out[_grams(*_paragraph_bytes([pair]))[0][2:]] = True
    return out


def wrapped(data: np.ndarray, texts: np.ndarray, lines: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of stretches over several lines that may be a notice; a blank line ends one.

    Every stretch of word pairs of templates, with ``GAP`` words between two of them at most, is given.
    """
    clean = _KEEP[data]
    start, end, of = word_spans(clean, texts)
    if len(start) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = Rolling(BYTE_VALUES[clean]).spans(start, end)
    near = of[1:] == of[:-1]
    hit = np.flatnonzero(near & pairs[(mix(one[:-1] * U64(3) + one[1:]) % U64(BUCKETS)).astype(np.int64)])
    # Lines are blank if all their bytes are white space.
    ink = np.concatenate(([0], np.cumsum(~np.isin(data, np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8)))))
    block = np.cumsum(ink[lines[1:]] == ink[lines[:-1]])
    line = lambda at: np.searchsorted(lines, at, side="right") - 1
    here, after = line(start[hit]), line(start[hit + 1])
    whole = block[here] == block[after]
    hit, here, after = hit[whole], here[whole], after[whole]
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((np.diff(hit) > GAP) | (of[hit[1:]] != of[hit[:-1]]) | (block[here[1:]] != block[here[:-1]])) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(hit)])) - 1
    long = here[first] < after[last]
    return start[hit[first[long]]], end[hit[last[long]] + 1]


def train(docs: DataFrame, sample: int = 300, seed: int = 11) -> Classifier:
    """Unknown paragraphs come from ``sample`` documents at most, drawn by a hash, without those that name licences."""
    # A share of the rows by a hash, about ``sample`` of them, whatever the table's size.
    usable = docs.where(F.col("text").isNotNull() & (F.octet_length("text") < 20_000))
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(max(1, docs.count()))) < sample
    drawn = sorted(usable.where(share).select("text").collect())
    cue = ("licen", "copyright", "warrant", "gpl", "creative commons", "public domain", "rights reserved")
    lines = [x for r in drawn for x in r["text"].split("\n") if x.strip()]
    return fit([x for x in lines if not any(c in x.lower() for c in cue)][: 8 * sample], seed)


_OUT = "doc_id bigint, paragraph int, family string, probability double, similarity double, confirmed boolean, text string"


def scan(docs: DataFrame, model: Classifier, least: float = 0.5, similar: float = 0.6) -> DataFrame:
    """Paragraphs (lines that are not blank) of whole texts that hold a licence notice, and notices over several lines.

    The classifier names a family with a calibrated probability; unknown, or a probability below ``least``, gives no
    row.  ``confirmed``: the paragraph has at least ``similar`` of a template of the family, or is a piece of one (see
    ``template_similarity``).  A notice that is wrapped over lines of a block (lines without a blank one between) is
    given once, at its first line, if it is confirmed and none of its lines is for that family.  Null texts have no
    paragraphs; a null ``doc_id`` is kept; repeated rows are scanned each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times classes numbers, whatever the data
    names = [x.split()[0] for x in _OUT.split(", ")]
    told = _template_pairs()

    def run(batches):
        for batch in batches:
            m, rows = shared.value, {c: [] for c in names}
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, texts = part.column("doc_id").to_pylist(), pc.fill_null(part.column("text"), b"")
                data = np.frombuffer(b"".join(x + b"\n" for x in texts.to_pylist()), np.uint8)
                ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64) + 1)
                lines = np.concatenate(([0], np.flatnonzero(data == 10) + 1)).astype(np.int64)
                p = m.probabilities(data, lines)
                best = p[:, :-1].argmax(axis=1)
                sure = p[np.arange(len(p)), best]
                raw, done = data.tobytes(), set()

                def add(i, text, k, sure, score):
                    doc = int(np.searchsorted(ends, lines[i], side="right"))
                    first = int(np.searchsorted(lines, ends[doc - 1] if doc else 0))
                    before = sum(bool(raw[a:b].strip()) for a, b in zip(lines[first:i], lines[first + 1 : i + 1]))
                    for c, x in zip(names, (ids[doc], before, m.families[k], float(sure), score, score >= similar, text)):
                        rows[c].append(x)

                for i in np.flatnonzero((sure >= least) & (sure > p[:, -1])).tolist():
                    text = raw[lines[i] : lines[i + 1] - 1].decode("utf-8", "replace")
                    if not text.strip():
                        continue
                    score = template_similarity(text, m.families[best[i]])
                    add(i, text, best[i], sure[i], score)
                    if score >= similar:
                        done.add((i, int(best[i])))
                begin, end = wrapped(data, np.concatenate(([0], ends)), lines, told)
                if not len(begin):
                    continue
                pieces = [raw[a:e] for a, e in zip(begin.tolist(), end.tolist())]
                p = m.probabilities(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum(end - begin))))
                best = p[:, :-1].argmax(axis=1)
                sure = p[np.arange(len(p)), best]
                for j in np.flatnonzero((sure >= least) & (sure > p[:, -1])).tolist():
                    i, to = (int(x) for x in np.searchsorted(lines, [begin[j], end[j] - 1], side="right") - 1)
                    text = pieces[j].decode("utf-8", "replace")
                    score = template_similarity(text, m.families[best[j]])
                    if score >= similar and not any((x, int(best[j])) in done for x in range(i, to + 1)):
                        add(i, text, best[j], sure[j], score)
            yield pa.RecordBatch.from_pydict(
                rows,
                schema=pa.schema([("doc_id", pa.int64()), ("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_()), ("text", pa.string())]),
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _OUT)
