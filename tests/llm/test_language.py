"""Word-first backoff against brute force, letters by Unicode category, held-out accuracy on a whole table."""

import math
from collections import Counter

import pytest
import regex

from rowloom.llm import language_id, queries


def test_letters_are_letters():
    assert language_id.letters("² ½ ① Ⅷ 12_x".encode()) == ["x"]
    assert language_id.letters("नमस्ते".encode()) == ["नमस्ते"]
    assert language_id.letters("l'ÉTÉ".encode()) == ["l", "été"]


def brute(rows, texts, least):
    """Posteriors by the definition: word counts first, then the longest order of which a gram is known."""
    train = [(lang, w) for t, lang in rows for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower())]
    langs = sorted({x for _, x in rows})
    counts = {k: Counter() for k in range(6)}
    for lang, w in train:
        counts[0][lang, w] += 1
        for k in range(1, 6):
            p = f"^{w}$" if k > 1 else w
            for i in range(len(p) - k + 1):
                counts[k][lang, p[i : i + k]] += 1
    total = {k: Counter() for k in counts}
    for k, c in counts.items():
        for (lang, key), n in c.items():
            total[k][lang] += n
    known = {k: {key for key in {x for _, x in c} if sum(c[x, key] for x in langs) >= least} for k, c in counts.items()}
    log = lambda k, lang, key: math.log((counts[k][lang, key] + 0.5) / (total[k][lang] + 0.5 * (len(known[k]) + 1)))
    out = []
    for t in texts:
        ws = regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower())
        z = {x: math.log(sum(y == x for _, y in rows) / len(rows)) for x in langs}
        for w in ws:
            for k in (0, 5, 4, 3, 2, 1):
                p = w if k in (0, 1) else f"^{w}$"
                found = [w] if k == 0 else [p[i : i + k] for i in range(len(p) - k + 1)]
                found = [g for g in found if g in known[k]]
                if found:
                    for x in langs:
                        z[x] += sum(log(k, x, g) for g in found) / len(found)
                    break
        best = max(langs, key=lambda x: z[x])
        out.append((best, 1 / sum(math.exp(z[x] - z[best]) for x in langs)) if ws else ("und", 0.0))
    return out


def test_scores_equal_the_definition(spark):
    rows = [("der Tag und die Nacht", "de"), ("the day and the night is long", "en"), ("le jour et la nuit", "fr"), ("die lange Nacht", "de"), ("and the long day", "en"), ("une nuit et un jour", "fr")] * 3
    texts = ["Nachtigall", "the longest day", "journal 12", "12 ½ ²", "", "zzz qqq", "Tagesnacht and nuit"]
    model = language_id.train(spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(k, t, 0.5, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, score double, lang_pred string, `__text` string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, model, keep=("score", "lang_pred", "__text")).collect()}
    for k, (lang, p) in enumerate(brute(rows, texts, language_id.LEAST_COUNT)):
        assert got[k]["lang_pred"] == lang and got[k]["score"] == pytest.approx(p, abs=1e-9), texts[k]
        assert got[k]["__text"] == "y"
    kept = language_id.with_language(docs, model).collect()
    assert [r["doc_id"] for r in kept] == [0, 1, 2, 5, 6] and kept[0].asDict() == {"doc_id": 0, "text": "Nachtigall", "score": 0.5, "lang_pred": "x", "__text": "y"}


def test_held_out_rows_of_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
