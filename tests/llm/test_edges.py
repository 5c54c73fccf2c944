"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables."""

import zlib

import pytest

from rowloom.llm import chroma, ctw, exact_dedup, language_id, licenses, mixing, packing, pii, simhash_dedup, toxicity
from rowloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, n long, size long, length int, prob string, word string"
ROWS = [
    (1, "The end of the day. Mail 7@x.example now", "en", "a", 9),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, "der Tag und die Nacht " * 4000, "de", "b", 88000),
    (5, "The end of the day. Mail 7@x.example now", "en", "a", 9),
    (5, "The end of the day. Mail 7@x.example now", "en", "a", 9),
    (6, " The end of the day.\tMail 7@x.example now", "en", None, 10),
    (None, "der Tag ist da +1 (017) 555-7713", "de", "b", 5),
    (None, "1 2 3 ... 4000 0000 0000 0002 1.2.3.999 10.0.0.1", None, "c", 4),
    (8, "Licensed under the Apache License, Version 2.0.\nder Tag", "de", "b", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, "x", 1, 2, 3, "p", "w") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_language(docs, none):
    got = rows(language_id.identify(docs))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[4]["lang_pred"] == "de" and by[1]["lang_pred"] == "en"
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"])
    assert rows(language_id.identify(none)) == []


def test_language_scores(docs, none):
    import math

    got = rows(ctw.lm_scores(docs))
    assert len(got) == len(ROWS)
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in ROWS}
    train = [w for r in ROWS if not held[r[0]] for w in [*(r[1] or "").lower().split(), None]]
    v = len(set(train))
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"]) if r["doc_id"] else None
        if r["doc_id"]:
            ws = [*(text or "").lower().split(), None]
            assert r["n_tokens"] == len(ws) and r["train_tokens"] == len(train)
            assert r["base_score"] == pytest.approx(sum(math.log10((train.count(w) + 1) / (len(train) + v + 1)) for w in ws[:50]) if len(ws) <= 50 else r["base_score"])
        assert r["score"] < 0
    assert rows(ctw.lm_scores(none)) == []


def test_personal_data(docs, none):
    got = rows(pii.personal_data(docs))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[1]["spans"] == "email:25:36" and by[2]["spans"] == "" and by[4]["spans"] == ""
    nameless = sorted(r["spans"] for r in got if r["doc_id"] is None)
    assert nameless == ["ip:40:48", "phone:15:32"]
    assert rows(pii.personal_data(none)) == []


def test_contexts_discover_an_unseen_identifier(spark):
    seen = [(k, f"write to contact {k}@host{k}.example please") for k in range(40)]
    docs = spark.createDataFrame([*seen, (90, "write to contact ann55@intranet please"), (91, "number 123456 is no contact")], "doc_id long, text string")
    by = {r["doc_id"]: r["spans"] for r in rows(pii.personal_data(docs))}
    assert by[90] == "email:17:31" and by[91] == ""


def test_packing(docs, none):
    got = rows(packing.pack(docs, sequence=64))
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 4)
    assert all(x[2] == 64 for x in long[1:]) and [x[1] for x in long[1:]] == [long[0][2] + 64 * k for k in range(len(long) - 1)]
    assert sorted(r["length"] for r in got if r["doc_id"] in (2, 3)) == [1, 1]
    assert rows(packing.pack(none)) == []


def test_near_duplicates(docs, none):
    got = rows(simhash_dedup.near_groups(docs))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[1]["component_id"] == by[5]["component_id"] == by[6]["component_id"] == 1
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 2
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert rows(simhash_dedup.near_groups(none)) == []


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(60) if k != 30] + [(100, 200), (150, 200)]
    got = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert all(got[k] == (0 if k <= 30 else 31) for k in range(61)) and got[200] == got[150] == 100


def test_exact_duplicates(docs, none, spark):
    got = rows(exact_dedup.exact_groups(docs))
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[1]["keep_id"] == by[5]["keep_id"] == 6 and by[6]["kept"] and by[6]["group_size"] == 4
    assert by[2]["group_size"] == 2 and by[2]["kept"] and not by[3]["kept"]
    assert sum(r["kept"] for r in got) == 6 and len(got) == len(ROWS)
    assert rows(exact_dedup.exact_groups(none)) == []
    from pyspark.sql import functions as F

    weak = rows(exact_dedup.exact_groups(docs, digest=lambda c: F.length(c) % 2))  # every digest collides
    key = lambda r: (r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"], r["text_sha256"])
    assert sorted(map(key, weak)) == sorted(map(key, got))


def test_probe_asks_filters_first(spark):
    index = exact_dedup.DigestIndex(spark)
    log = spark.range(100).selectExpr("id as doc_id", "id * 3 as digest", "1 as points", "id as uid")
    index.flush(log, 100)
    batch = spark.createDataFrame([(0, 3), (1, 4), (2, 297)], "k int, digest long")
    assert sorted(r["k"] for r in rows(index.probe(batch))) == [0, 2]


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (8, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    got = rows(toxicity.toxicity(docs, labels))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert rows(toxicity.toxicity(none, labels.limit(0))) == []


def test_licences(docs, none):
    by = {r["doc_id"]: r for r in rows(licenses.licences(docs)) if r["doc_id"]}
    assert by[8]["families"] == "apache" and by[8]["first_paragraph"] == 0 and by[1]["n_licences"] == 0 and by[2]["n_paragraphs"] == 0
    assert rows(licenses.licences(none)) == []


def test_mixing(docs, none):
    got = rows(mixing.mix(docs))
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert got == rows(mixing.mix(docs)) or sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(docs))))
    total = sum(r["size"] for r in got)
    assert sum({r["source_size"]: r["target"] for r in got}.values()) == pytest.approx(total)
    assert rows(mixing.mix(none)) == []


def test_targets_reshare_what_a_cap_leaves(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 500), (3, "c", 490), (4, None, 0)], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in rows(mixing.source_targets(sizes))}
    # weights 5 2 1 5: a is capped at 30, null at 0, the others share 970 as 2 to 1
    assert got["a"] == 30 and got[None] == 0 and got["b"] == pytest.approx(970 * 2 / 3) and got["c"] == pytest.approx(970 / 3)


def test_media(spark):
    import random

    rng = random.Random(1)
    vec = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    data = [(0, vec[0]), (1, vec[0]), (50, vec[1][13:] + vec[1][:13]), (3, vec[1]), (4, None), (None, vec[2])]
    got = {r["media_id"]: r for r in rows(chroma.match(chroma.recordings(spark.createDataFrame(data, "vec_id long, embedding array<double>"))))}
    assert len(got) == 6 and got[0]["class_id"] == got[1]["class_id"] == 0
    assert got[50]["best_class"] == 3 and got[50]["bit_errors"] <= 0.25 and got[3]["n_matches"] is None and got[4]["n_frames"] == 0


def test_unique_digests_take_no_part_in_the_compaction(spark, monkeypatch):
    from rowloom.llm import exact_dedup as ed

    log = spark.range(4000).selectExpr("id as doc_id", "xxhash64(id % 3900) as digest", "1 as points", "id as uid")
    index = ed.DigestIndex(spark)
    index.flush(log, 4000)
    merged = {r["digest"]: r["n"] for r in index.compact().collect()}
    assert sum(n == 2 for n in merged.values()) == 100 and len(merged) < 2000
    monkeypatch.setattr(ed, "BROADCAST_BYTES", 0)  # the same where filters are asked by a shuffle
    assert {r["digest"]: r["n"] for r in index.compact().collect()} == merged


def test_mixing_of_many_rows_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    docs = spark.createDataFrame([(None if k % 2 else 7, "a b c", "s" if k % 3 else "t") for k in range(900)], "doc_id long, text string, source string")
    got = rows(mixing.mix(docs))
    assert len(got) == 900
    for size in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 6


@pytest.mark.parametrize("source", [None, "a"])
def test_mixing_takes_words_near_targets(spark, source):
    import random

    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(["w"] * rng.randint(0, 60)), source if k % 5 else rng.choice("abcdef")) for k in range(3000)], "doc_id long, text string, source string")
    got = rows(mixing.mix(docs))
    taken, target = {}, {}
    for r in got:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        target[r["source_size"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 120 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(docs))))
