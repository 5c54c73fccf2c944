"""Rows that once broke an operator: more null or equal ids than a sample holds, runs of blanks, scripts without blanks."""

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import common, language_id, licenses, packing, queries

EN, DE = "the day and the night are long and the river runs to the sea", "der Tag und die Nacht sind lang und der Fluss fliesst in das Meer"


def _texts(spark, n, doc_id):
    text = F.concat(F.when(F.col("id") % 2 == 0, EN).otherwise(DE), F.lit(" "), F.col("id").cast("string"))
    return spark.range(n).select(F.lit(doc_id).cast("long").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.lit("s").alias("source"), F.length(text).cast("long").alias("n_chars"))


@pytest.mark.parametrize(("n", "doc_id"), [(12_000, None), (50_000, None), (20_000, 7)])
def test_a_sample_is_exact_whatever_the_ids(spark, n, doc_id):
    rows = _texts(spark, n, doc_id)
    assert common.bounded_sample(rows, 8_000).count() == 8_000
    assert common.bounded_sample(rows.select("doc_id"), 500).count() == 500
    assert common.bounded_sample(rows, n).count() == n


@pytest.mark.parametrize("doc_id", [None, 3])
def test_languages_are_learnt_without_ids(spark, doc_id):
    rows = _texts(spark, 12_000, doc_id)
    by = {(r["lang"], r["lang_pred"]): r["count"] for r in language_id.predict(rows, language_id.train(rows), keep=("lang",)).groupBy("lang", "lang_pred").count().collect()}
    assert by == {("en", "en"): 6_000, ("de", "de"): 6_000}
    assert corpus_pipeline.identify_language(spark, rows, "").count() == 12_000


def test_notices_are_learnt_without_ids(spark):
    rows = _texts(spark, 6_000, None)
    assert licenses.train(rows)["families"]


def test_long_runs_are_scored_and_not_kept():
    model = {"langs": ["x", "y"], "words": {}, "grams": {"日": 0, "本": 1}, "logs": np.log(np.array([[0.6, 0.4], [0.3, 0.7]])), "prior": np.zeros(2), "key": "k"}
    s = language_id.Scorer(model)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for k in range(0, 2_000, 100):  # 120 MB of runs of 60 kB
        langs, p = s.score([("日本" * 10_000 + chr(0x4E00 + k + j)).encode() for j in range(100)])
        assert set(langs) == {"y"}
    assert s.held < 1_000 and not s.index
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    short, _ = s.score(["日 本 本 本".encode(), "日".encode()])
    assert short == ["y", "x"] and len(s.index) == 2


def test_the_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(language_id, "CACHE_BYTES", 4_000)
    model = {"langs": ["x"], "words": {}, "grams": {"a": 0}, "logs": np.zeros((1, 1)), "prior": np.zeros(1), "key": "k"}
    s = language_id.Scorer(model)
    for k in range(200):
        s.score([b"a" + bytes([97 + k % 26, 97 + k // 26])])
        assert s.held <= 4_200


BLANKS = [" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000, " \n\t\r" * 500_000 + "x", " " * 2_000_000 + "word", " " * 1_500_000, "a" + " " * 1_200_000]


def test_runs_of_blanks_have_the_plain_ids():
    enc = packing.encoder(packing.default_tokenizer())
    for t, ids in zip(BLANKS, enc.encode(BLANKS), strict=True):
        assert ids == enc.whole(t)


def test_runs_of_blanks_are_packed_by_query_and_pipeline(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*BLANKS[:2], BLANKS[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(_texts(spark, 40, None))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op4_best_fit_packing(spark, str(tmp_path))
    tokens = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    enc = packing.encoder(packing.default_tokenizer())
    assert [tokens[k] for k in range(3)] == [len(enc.whole(r[1])) // 4 + 1 for r in rows]
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 2").count() > 0


def test_equal_rows_are_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 10)
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    out = packing.pack(docs, sequence=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 400
