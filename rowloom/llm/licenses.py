"""Licence scans: a trained paragraph classifier with a template comparison behind it.

Paragraphs are lines. A multinomial logistic regression over sparse word n-grams is fitted to
paragraphs made from the templates below (their families), to notices of made-up licences (the class
`unknown`), and to a bounded sample of the corpus's own paragraphs and of prose with single words of
notices in it (the class `none`). Its probabilities are calibrated by a temperature on paragraphs that were
not fitted. A family counts from CERTAIN on and only if the paragraph also holds enough of the family's
template; else the paragraph is `unknown` if all but `none` together reach CERTAIN, and `none` otherwise.

Every n-gram of the model holds an anchor, a word of the templates that paragraphs beside notices
rarely have, or a key, one of the word pairs that no paragraph with enough of a template can lack
all of. A paragraph without either therefore has no features and is `none` whatever the rest: it is
passed over without computing that. However common a notice is, it keeps its keys.

Nulls: a null text is empty and has no paragraphs; a null id is kept. Repeated rows give equal results.
Ties of two classes go to the first by name. Very long texts are scanned whole; for fitting, a sampled
paragraph counts in pieces of PIECE_WORDS. Other columns are ignored, whatever their names. An empty table
gives an empty result, and a corpus without paragraphs a model of the templates alone.
"""

from __future__ import annotations

import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What notices of each family say, in short.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3", "released under the agpl 3.0 license",
        "gnu affero general public license as published by the free software foundation", "spdx license identifier agpl 3.0 or later",
        "gnu affero general public license",
        "gnu affero gpl",
        "gnu agpl",
    ],
    "apache": [
        "licensed under the apache license version 2.0", "you may obtain a copy of the license at www.apache.org licenses", "spdx license identifier apache 2.0",
        "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "apache license version 2.0",
        "apache 2.0 license",
        "apache license",
        "see the license for the specific language governing permissions and limitations under the license",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd 3 clause license",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "spdx license identifier bsd 3 clause",
        "bsd license",
        "bsd style license",
        "bsd 2 clause",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ],
    "cc-by": [
        "licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "spdx license identifier cc by 4.0",
        "creative commons attribution license",
        "cc by 3.0",
    ],
    "cc-by-nc": [
        "licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc 4.0",
        "creative commons attribution noncommercial license",
        "cc by nc",
    ],
    "cc-by-sa": [
        "licensed under a creative commons attribution sharealike 4.0 international license", "licensed under cc by sa 4.0",
        "creative commons attribution sharealike license",
        "cc by sa",
    ],
    "cc0": [
        "dedicated to the public domain under the creative commons zero universal dedication", "released under cc0 1.0", "spdx license identifier cc0 1.0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights",
        "creative commons zero",
        "cc0 1.0 universal",
        "cc0 public domain dedication",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3", "redistribute it and or modify it under the terms of the gnu general public license", "released under the gpl 2.0 license",
        "this program is free software you can redistribute it and or modify", "gnu general public license as published by the free software foundation", "you should have received a copy of the gnu general public license along with this program",
        "spdx license identifier gpl 3.0 or later", "spdx license identifier gpl 2.0 only",
        "gnu general public license",
        "gnu gpl",
        "licensed under gplv2",
        "licensed under gplv3",
        "gpl version 2",
        "gpl version 3",
        "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "see the gnu general public license for more details",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license",
        "provided that the above copyright notice and this permission notice appear in all copies", "spdx license identifier isc",
        "isc license",
        "the software is provided as is and the author disclaims all warranties with regard to this software",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2.1", "released under the lgpl 3.0 license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "spdx license identifier lgpl 2.1 or later",
        "gnu lesser general public license",
        "gnu lgpl",
        "gnu library general public license",
        "lgpl version 2.1",
    ],
    "mit": [
        "released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the mit license",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "spdx license identifier mit",
        "mit license",
        "mit licensed",
        "the above notice shall be included in all copies or substantial portions of this software",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under mpl 2.0", "spdx license identifier mpl 2.0",
        "mozilla public license version 2.0",
        "mozilla public license",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "proprietary": ["all rights reserved", "copyright all rights reserved no part may be reproduced without prior written permission"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software",
        "spdx license identifier unlicense",
        "for more information please refer to unlicense.org",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    ],
    "zlib": [
        "in no event will the authors be held liable for any damages arising from the use of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "spdx license identifier zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "this notice may not be removed or altered from any source distribution",
    ],
}
NONE, UNKNOWN = "none", "unknown"
#: How notices of licences that have no template read; two made-up names and a number go into each.
STRANGERS = [
    "licensed under the {} license version {}", "licensed under the {} license", "released under the {} public license", "released under the {} {} license", "subject to the {} terms of use version {}",
    "distributed under the {} software license version {}", "this file is made available under the {} license", "see the {} license for the language governing permissions", "this software is provided under the {} license agreement",
    "use of this work is governed by the {} licence version {}", "published under the {} open content licence {}", "available under the terms of the {} {} license {}",
]
#: Words that name a licence; always anchors, and half of the words that prose for the class `none` gets.
NAMES = ("copyright", "licence", "licenced", "license", "licensed")
#: Bounds of the sample of unlabelled rows that gives the class `none`, and paragraphs made of each template.
SAMPLE_DOCS, NEGATIVES, VARIANTS = 2_000, 8_000, 40
#: Words of a piece of a sampled paragraph, made-up notices, and pieces of prose with single words of notices.
PIECE_WORDS, NOTICES, LOOSE = 200, 1_200, 2_400
MOST_GRAM, ROUNDS, RATE, DECAY = 3, 300, 0.5, 1e-4
#: An anchor is in at most this share of the corpus's sampled paragraphs, notices left out.
ANCHOR_SHARE = 0.002
CERTAIN, LEAST_COVER = 0.7, 0.6

_WORD = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")
_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c in b".\n\r" or c >= 128 else 32 for c in range(256))


def paragraphs(text: bytes | None) -> list[bytes]:
    return [p for p in re.split(rb"[\n\r]+", (text or b"").translate(_BLANK)) if p.strip()]


def blocks(text: bytes | None) -> list[tuple[int, int]]:
    """Runs of lines, as places in `paragraphs`: a line goes on in the next one unless it ends with a full stop or a blank line follows."""
    out, at, begin = [], 0, 0
    for line in re.split(rb"\r\n|[\n\r]", (text or b"").translate(_BLANK)):
        if line.strip():
            at += 1
        if at > begin and (not line.strip() or line.rstrip().endswith(b".")):
            out.append((begin, at))
            begin = at
    return out + ([(begin, at)] if at > begin else [])


def words(paragraph: bytes) -> list[str]:
    return [w.decode() for w in _WORD.findall(paragraph)]


def features(ws: list[str], anchors: frozenset[str] | set[str], keys: frozenset[tuple[str, str]] = frozenset()) -> set[str]:
    """n-grams up to MOST_GRAM words that hold an anchor or a key."""
    at = [i for i, w in enumerate(ws) if w in anchors]
    out = {" ".join(ws[s : s + n]) for i in at for n in range(1, MOST_GRAM + 1) for s in range(max(0, i - n + 1), i + 1) if s + n <= len(ws)}
    if keys:
        at = [i for i, k in enumerate(zip(ws, ws[1:], strict=False)) if k in keys]
        out |= {" ".join(ws[s : s + n]) for i in at for n in range(2, MOST_GRAM + 1) for s in range(max(0, i - n + 2), i + 1) if s + n <= len(ws)}
    return out


def key_pairs(anchors: frozenset[str], seen: Counter) -> frozenset[tuple[str, str]]:
    """Of each template's word pairs so many that a paragraph with LEAST_COVER of them has one: those with anchors and seldom seen words first."""
    out = set()
    for t in (t.split() for ts in TEMPLATES.values() for t in ts):
        pairs = sorted(set(zip(t, t[1:], strict=False)), key=lambda k: (anchors.isdisjoint(k), min(seen[w] for w in k), k))
        out.update(pairs[: sum(1 for gone in range(len(pairs)) if (len(pairs) - gone) / len(pairs) >= LEAST_COVER)])
    return frozenset(out)


def _variants(rng: random.Random, filler: list[str]) -> list[tuple[str, list[str]]]:
    """Paragraphs of each family: templates with words lost, changed or around them."""
    out = []
    for family, templates in TEMPLATES.items():
        for t in templates:
            out.append((family, t.split()))
            for _ in range(VARIANTS):
                ws = [w for w in t.split() if rng.random() > (0.06 if t.count(" ") > 3 else 0)]  # short ones say nothing without a word
                around = [rng.choice(filler) for _ in range(rng.choice((0, 0, 3, 10)))]
                cut = rng.randint(0, len(around))
                out.append((family, around[:cut] + ws + around[cut:]))
    return out


def _strangers(rng: random.Random, n: int, filler: list[str]) -> list[list[str]]:
    """Notices of licences with names of one to three made-up words, some within other words."""
    name = lambda: " ".join("".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(n):
        t = rng.choice(STRANGERS)
        slots = [name() for _ in range(t.count("{}") - 1)] if t.endswith("{}") else [name() for _ in range(t.count("{}"))]
        if len(slots) < t.count("{}"):
            slots.append(str(rng.randint(1, 9)) + rng.choice(["", ".0", ".1"]))
        around = [rng.choice(filler) for _ in range(rng.choice((0, 0, 3, 10)))]
        cut = rng.randint(0, len(around))
        out.append([*around[:cut], *t.format(*slots).split(), *around[cut:]])
    return out


def _loose(rng: random.Random, n: int, filler: list[str], vocabulary: list[str]) -> list[list[str]]:
    """Prose with one or two words of notices, each between other words."""
    out = []
    for _ in range(n):
        ws = [rng.choice(filler) for _ in range(rng.randint(5, 16))]
        for _ in range(rng.randint(1, 2)):
            ws.insert(rng.randint(1, len(ws)), rng.choice(vocabulary if rng.random() < 0.5 else NAMES))
        out.append(ws)
    return out


def fit(rows: list[tuple[int, set[str]]], classes: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Softmax regression by full-batch steps; (feature numbers, weights, bias)."""
    df = Counter(g for _, fs in rows for g in fs)
    index = {g: k for k, g in enumerate(sorted(g for g, n in df.items() if n >= 2))}
    feat = np.array([index[g] for _, fs in rows for g in sorted(fs) if g in index], np.int64)
    row_of = np.array([r for r, (_, fs) in enumerate(rows) for g in sorted(fs) if g in index], np.int64)
    y = np.zeros((len(rows), classes))
    y[np.arange(len(rows)), [c for c, _ in rows]] = 1
    w, bias = np.zeros((len(index), classes)), np.log(y.sum(0) + 1) - np.log(len(rows) + classes)
    push = np.full_like(w, 1e-8)
    for _ in range(ROUNDS):
        z = np.stack([np.bincount(row_of, w[feat, c], len(rows)) for c in range(classes)], axis=1) + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p - y
        g = np.stack([np.bincount(feat, d[row_of, c], len(index)) for c in range(classes)], axis=1) + DECAY * len(rows) * w / 100
        push += g * g
        w -= RATE * g / np.sqrt(push)
    return index, w, bias


def train(docs: DataFrame, text_col: str = "text", seed: int = 9) -> dict:
    """Model; the corpus only gives the class `none`, from a bounded sample of its documents."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sample = common.bounded_sample(docs.select(F.col(text_col).cast("binary").alias("text")), SAMPLE_DOCS)
    least = {w for ts in TEMPLATES.values() for t in ts for w in t.split()}

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in (p for t in b.column("text").to_pylist() for p in paragraphs(t)):
                ws = words(p)
                out += [" ".join(ws[k : k + PIECE_WORDS]) for k in range(0, len(ws), PIECE_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["p"])

    found = [r[0].split() for r in sample.mapInArrow(take, "p string").orderBy(F.xxhash64("p")).limit(NEGATIVES).collect()]
    rng = random.Random(seed)
    # paragraphs that repeat a template nearly whole are notices, not negatives
    notices = [set(t.split()) for ts in TEMPLATES.values() for t in ts]
    negatives = [ws for ws in found if not (s := set(ws) & least) or max(len(s & t) / len(t) for t in notices) < LEAST_COVER]
    seen = Counter(w for ws in negatives for w in set(ws) & least)
    anchors = frozenset(w for w in least if not w.replace(".", "").isdigit() and seen[w] <= max(1, ANCHOR_SHARE * len(found)) and len(w) > 1) | set(NAMES)
    keys = key_pairs(anchors, seen)
    filler = [w for ws in negatives[:200] for w in ws] or ["and"]
    families = sorted(TEMPLATES)
    made = _variants(rng, filler)
    rng.shuffle(made)
    none, unknown = len(families), len(families) + 1
    vocabulary = sorted(w for w in anchors if w.isalpha())
    rows = [(families.index(f), ws) for f, ws in made] + [(none, ws) for ws in negatives + _loose(rng, LOOSE, filler, vocabulary)] + [(unknown, ws) for ws in _strangers(rng, NOTICES, filler)]
    rng.shuffle(rows)
    rows = [(c, fs) for c, fs in ((c, features(ws, anchors, keys)) for c, ws in rows) if fs]
    index, w, bias = fit([r for k, r in enumerate(rows) if k % 5], len(families) + 2)
    model = {"families": families, "anchors": anchors, "keys": keys, "index": index, "w": w, "bias": bias, "temperature": 1.0, "key": uuid.uuid4().hex}
    model["temperature"] = _temperature(model, rows[::5])
    return model


def _temperature(model: dict, rows: list[tuple[int, set[str]]]) -> float:
    """The temperature under which held-out paragraphs, strangers among them, are likeliest."""

    def loss(t: float) -> float:
        return -sum(np.log(max(1e-12, probabilities(model, fs, t)[c])) for c, fs in rows)

    return min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=loss)


def probabilities(model: dict, fs: set[str], temperature: float | None = None) -> np.ndarray:
    ids = [model["index"][g] for g in fs if g in model["index"]]
    z = (model["w"][ids].sum(0) + model["bias"]) / (temperature or model["temperature"])
    p = np.exp(z - z.max())
    return p / p.sum()


def cover(ws: list[str], family: str) -> float:
    """Largest share of a template's word pairs, in order, that the paragraph has."""
    pairs = set(zip(ws, ws[1:], strict=False))
    best = 0.0
    for t in TEMPLATES[family]:
        tw = t.split()
        want = set(zip(tw, tw[1:], strict=False))
        best = max(best, len(want & pairs) / len(want))
    return best


def classify(model: dict, paragraph: bytes) -> tuple[str, float]:
    """Family, `unknown` or `none`, with its probability."""
    ws = words(paragraph)
    fs = features(ws, model["anchors"], model["keys"])
    if not any(g in model["index"] for g in fs):
        return NONE, 1.0
    p = probabilities(model, fs)
    n = len(model["families"])
    k = int(p.argmax())
    if k < n and p[k] >= CERTAIN and cover(ws, model["families"][k]) >= LEAST_COVER:
        return model["families"][k], float(p[k])
    some = float(1 - p[n])
    return (UNKNOWN, some) if some >= CERTAIN else (NONE, 1 - some)


def found(model: dict, ps: list[bytes], joined: list[tuple[int, int]]) -> list[tuple[int, str, float]]:
    """(paragraph, family or `unknown`, probability) of paragraphs with a notice; one that is wrapped over lines
    counts where a line has its family alone, else at its first line."""
    out = {k: g for k, g in ((k, classify(model, p)) for k, p in enumerate(ps)) if g[0] != NONE}
    for begin, end in joined:
        inside = [k for k in range(begin, end) if k in out]
        known = {out[k][0] for k in inside} - {UNKNOWN}
        unknown = [k for k in inside if out[k][0] == UNKNOWN]
        if end - begin < 2 or len(known) > 1 or (known and not unknown):
            continue
        whole = classify(model, b" ".join(ps[begin:end]))
        if whole[0] in known or (not known and whole[0] not in (NONE, UNKNOWN)):
            for k in unknown:
                del out[k]
            if not known:
                out[begin] = whole
    return [(k, *out[k]) for k in sorted(out)]


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families (comma-joined), first_paragraph, score: one row per input row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand n-grams of the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        anchors = frozenset(a.encode() for a in m["anchors"])
        # of keys without an anchor both words must be there; numbers may be cut differently here, so they are not asked for
        loose = {frozenset(w.encode() for w in k if "." not in w) for k in m["keys"] if m["anchors"].isdisjoint(k)}
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                low = (t or b"").translate(_BLANK)
                had = {*low.replace(b".", b" ").split(), *low.split()}
                if anchors.isdisjoint(had) and not any(k <= had for k in loose):
                    rows.append((sum(1 for p in low.replace(b"\r", b"\n").split(b"\n") if p.strip()), 0, "", -1, 0.0))
                    continue
                ps = paragraphs(t)
                got = found(m, ps, blocks(t))
                rows.append((len(ps), len(got), ",".join(sorted({g[1] for g in got})), got[0][0] if got else -1, max((g[2] for g in got), default=0.0)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n_paragraphs", "n_licences", "families", "first_paragraph", "score"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_paragraphs int, n_licences int, families string, first_paragraph int, score double")


def licences(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))
