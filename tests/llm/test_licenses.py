"""Licence notices that are as common as other lines."""

import pytest

from rowloom.llm import licenses

COMMON = {
    "proprietary": "All rights reserved.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


@pytest.mark.parametrize("beside", ["", "\nThey reserved all the rights and the fee for use of the software in this form"])
def test_common_notices_are_found(spark, beside):
    rows = [(k, f"The day was long and number {k} went home.\nNothing else came of it.{beside}", None) for k in range(80)]
    rows += [(100 + k, f"A line before it, {k}.\n{COMMON[f]}\nand one after", f) for k, f in enumerate(sorted(COMMON) * 20)]
    got = {r["doc_id"]: r["families"] for r in licenses.licences(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert [(k, f, got[k]) for k, _, f in rows if got[k] != (f or "")] == []


def test_enough_of_a_template_has_a_key():
    keys = licenses.key_pairs(frozenset(), licenses.Counter())
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            ws = t.split()
            for s in range(len(ws)):
                for e in range(s + 2, len(ws) + 1):
                    pairs = set(zip(ws[s:e], ws[s + 1 : e], strict=False))
                    assert licenses.cover(ws[s:e], family) < licenses.LEAST_COVER or pairs & keys or len(pairs) < 2


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_real_licences_without_a_template_are_unknown(model):
    notices = ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the EUPL License", "This file is made available under the Zlib license", "Released under the Eclipse Public License", "available under the terms of the Artistic License 2.0", "Licensed under the European Union Public Licence version 1.2", "Published under the Open Database License 1.0", "Use of this software is governed by the Sleepycat license"]
    got = [licenses.classify(model, licenses.paragraphs(t.encode())[0])[0] for t in notices]
    assert sum(g == "unknown" for g in got) >= 7, list(zip(notices, got, strict=True))


def test_prose_with_words_of_notices_is_none(model):
    prose = ["She lost her driver's license on the bus yesterday", "The book enters copyright law history", "He was granted permission to leave and took the train", "The general public was not amused", "A licensed plumber came in the morning", "They hold the rights and reserved a table for four", "Her licence plate was stolen", "This version of the story is the better one"]
    got = [licenses.classify(model, licenses.paragraphs(t.encode())[0])[0] for t in prose]
    assert sum(g == "none" for g in got) >= 7 and got[0] == "none" and got[1] == "none", list(zip(prose, got, strict=True))


def test_held_out_paragraphs(model, spark):
    import random

    rng = random.Random(77)
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    prose = [p for t in rows for p in licenses.paragraphs((t or "").encode())]
    filler = [w for p in prose[:100] for w in licenses.words(p)]
    made = [(f, " ".join(ws)) for f, ws in licenses._variants(rng, filler)] + [("unknown", " ".join(ws)) for ws in licenses._strangers(rng, 300, filler)]
    right = {}
    for f, t in made:
        right.setdefault(f, []).append(licenses.classify(model, t.encode())[0] == f)
    share = {f: sum(x) / len(x) for f, x in right.items()}
    assert all(v >= 0.6 for v in share.values()) and sum(map(sum, right.values())) >= 0.85 * len(made), (share, sum(map(sum, right.values())) / len(made))
    clean = [licenses.classify(model, p)[0] for p in prose if not any(licenses.cover(licenses.words(p), f) >= 0.3 for f in licenses.TEMPLATES)]
    assert sum(c != "none" for c in clean) <= 0.005 * len(clean)


#: Real lines around sentences that the templates have.
NOTICES = [
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License v3"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl", "// SPDX-License-Identifier: GPL-3.0-or-later"),
    ("apache", "# SPDX-License-Identifier: Apache-2.0"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify"),
    ("gpl", "along with this program. You should have received a copy of the GNU General Public License; if not, write to the Free Software Foundation"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "3. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("bsd", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache", "you may not use this file except in compliance with the License."),
    ("isc", "copyright notice and this permission notice appear in all copies, provided that the above"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"),
    ("cc-by", "This chapter is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("cc0", "To the extent possible this data is released under CC0 1.0"),
    ("mit", "Code samples are licensed under the MIT License unless noted."),
    ("proprietary", "(c) 2019 Example Corp. All rights reserved."),
]

WRAPPED = {
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to\nany person obtaining a copy\nof this software and associated documentation files, to deal\nin it without restriction",
    "gpl": "you can redistribute it and/or\nmodify it under the terms of the GNU\nGeneral Public License",
}


def test_real_notices_are_told(model):
    got = [licenses.found(model, licenses.paragraphs(t.encode()), licenses.blocks(t.encode())) for _, t in NOTICES]
    right = [f in {g[1] for g in found} for (f, _), found in zip(NOTICES, got, strict=True)]
    assert sum(right) >= 0.9 * len(NOTICES), [(t, g) for r, t, g in zip(right, NOTICES, got, strict=True) if not r]


def test_notices_over_line_ends_are_joined(model):
    for family, t in WRAPPED.items():
        raw = f"A first line.\n\n{t}\n\nAnd more prose".encode()
        found = licenses.found(model, licenses.paragraphs(raw), licenses.blocks(raw))
        assert {g[1] for g in found} == {family}, (family, found)
    assert licenses.blocks(b"a\nb.\n\nc\r\nd\n \ne") == [(0, 2), (2, 4), (4, 5)] and licenses.blocks(None) == []


def test_probabilities_are_calibrated(model, spark):
    """What is said with a probability is right about as often, on made paragraphs that were not trained on."""
    import random

    rng = random.Random(123)
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    prose = [licenses.words(p) for t in rows[:80] for p in licenses.paragraphs((t or "").encode())]
    filler = [w for p in prose[:100] for w in p]
    names = [*model["families"], licenses.NONE, licenses.UNKNOWN]
    made = licenses._variants(rng, filler) + [(licenses.UNKNOWN, ws) for ws in licenses._strangers(rng, 300, filler)]
    said = []
    for f, ws in made:
        fs = licenses.features(ws, model["anchors"], model["keys"])
        p = licenses.probabilities(model, fs)
        said.append((float(p.max()), names[int(p.argmax())] == f))
    error = 0.0
    for lo in range(10):
        own = [(p, r) for p, r in said if lo / 10 < p <= (lo + 1) / 10]
        if own:
            error += len(own) / len(said) * abs(sum(p for p, _ in own) / len(own) - sum(r for _, r in own) / len(own))
    assert error < 0.06
