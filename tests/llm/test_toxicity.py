"""Held-out quality of the toxicity scores on a whole table."""

import pytest
from pyspark.sql import functions as F

from rowloom.llm import queries, toxicity


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert len(toxic) > 50 and len(clean) > 500
    found, wrong = sum(r["predicted"] for r in toxic) / len(toxic), sum(r["predicted"] for r in clean) / len(clean)
    print("found", found, "wrong", wrong)
    assert found >= 0.75 and wrong <= 0.02
    assert all(r["worst_sentence"] >= 0 for r in toxic if r["predicted"])


def _by_definition(model, text):
    """1 - (1 - leak) x product over sentences of 1 - logistic(bias + weights of its different words)."""
    import math
    import re

    quiet, worst, at = 1 - model["leak"], 0.0, -1
    k = 0
    for s in re.split(r"[.!?\n\r]", text or ""):
        words = {w.lower() for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", s)}
        if not words:
            continue
        own = [float(model["weights"][model["words"][w.encode()]]) for w in words if w.encode() in model["words"]]
        p = 1 / (1 + math.exp(-(toxicity.BIAS + sum(own))))
        if own and p > worst:
            worst, at = p, k
        quiet *= 1 - p
        k += 1
    return 1 - quiet, at, worst


def test_scores_of_a_whole_table_equal_the_definition(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null")
    model = toxicity.train(docs.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id"))
    assert len(model["words"]) > 5
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        want, at, worst = _by_definition(model, texts[r["doc_id"]])
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["worst_sentence"] == at and r["worst_score"] == pytest.approx(worst, abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7)
