"""Stages of the pipeline on rows without an id or with the id of another row."""

from collections import Counter

import corpus_pipeline as cp
from rowloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], SCHEMA)


def prose(k: int, n: int = 80) -> str:
    return " ".join(f"w{k * 1000 + i}" for i in range(n))


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_dedup_decides_by_row(spark):
    a, b, c, d = map(prose, range(4))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, c, "s"), (3, d, "s"), (None, a, "s"), (None, prose(5), "s"), (None, prose(5), "s")]
    want = sorted([(1, a), (2, b), (3, c), (3, d), (None, prose(5))], key=str)
    assert kept(cp.drop_exact_copies(spark, table(spark, rows), "")) == want
    near = [(k, t + " end" if n in (1, 5, 7) else t, s) for n, (k, t, s) in enumerate(rows)]
    got = kept(cp.drop_near_copies(spark, table(spark, near), ""))
    assert [k for k, _ in got] == [k for k, _ in want] and {(2, b), (3, c), (3, d), (1, a)} <= set(got)


def test_mix_carries_rows_without_and_with_the_same_id(spark):
    rows = [(None if k % 3 == 0 else k // 4, prose(k, 20 + k % 7), "ab"[k % 2]) for k in range(60)]
    docs = table(spark, rows)
    got = cp.mix_sources(spark, docs, "").collect()
    want = sum(r["copies"] for r in mixing.mix(docs).collect())
    assert got and len(got) == want and any(r["doc_id"] is None for r in got)
    most = {s: max(n for t, n in Counter(r["text"] for r in got).items() if (t, s) in {(t, s) for _, t, s in rows}) for s in "ab"}
    words = sum(len(r["text"].split()) for r in got)
    assert all(n <= 3 for n in most.values()) and abs(words - sum(len(t.split()) for _, t, _ in rows)) <= 60


ODD = "doc_id long, text string, lang string, source string, n_chars int, score double, lang_pred string, copies int, uid long, kept boolean, size long"


def odd(spark):
    rows = [(k // 2 if k % 5 else None, None if k % 11 == 3 else "" if k % 11 == 4 else f"the day and the night number {k % 17} " * (3000 if k == 20 else 3), "en" if k % 3 else None, None if k % 7 == 0 else "ab"[k % 2], k) for k in range(60)]
    return spark.createDataFrame([(*r, 0.5, "x", 9, 1, False, 3) for r in rows], ODD)


def test_every_stage_on_nulls_repeats_long_texts_and_clashing_columns(spark):
    docs = odd(spark)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        got = got.collect()
        assert got and all(r["score"] == 0.5 and r["lang_pred"] == "x" and r["copies"] == 9 and r["kept"] is False for r in got), name
        if name == "language_id":
            assert len(got) == sum(bool(r["text"]) for r in docs.collect())
        if name == "exact_dedup":
            assert len({(r["text"] or "").replace(" ", "") for r in docs.collect()}) == len(got)
    packed = cp.pack_sequences(spark, docs, "").collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) >= docs.count()


def test_every_stage_on_an_empty_table(spark):
    docs = odd(spark).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    """Language, exact and near copies leave what brute force leaves; each row then comes as often as the mix says, packed whole."""
    from tests.llm.test_similar import whole

    a = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r["text"] for r in a.collect() if any(c.isalpha() for c in r["text"] or "")}
    texts: dict = {}
    for k, t in rows.items():
        texts.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), k))
    kept = sorted(min(ks)[1] for ks in texts.values())
    groups, _ = whole([rows[k] for k in kept])
    left = {min(kept[i] for i in g) for g in groups.values()}
    packed = cp.run(spark, str(tmp_path)).collect()
    got = {r["doc_id"] for r in packed}
    assert got <= left and len(got) >= 0.5 * len(left)
    places: dict = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 and sorted(p)[0][0] == 0 for p in places.values())
