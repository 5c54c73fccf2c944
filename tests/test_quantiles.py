"""Quantile state: exact below its size, within its error above, merged over shards, batches and a restarted stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import quantiles
from rowloom.operators import transforms as tr
from rowloom.sources import sinks
from rowloom.streaming import running


def _counts(spark):
    x = np.random.default_rng(1465).integers(100, size=(1000, 5))
    rows = [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "cell_id long, gene_id int, x double")


@pytest.mark.parametrize("normalised", [False, True])
def test_median_of_three_shards_is_within_one_percent(spark, normalised, tmp_path):
    m = _counts(spark)
    m = tr.normalize_total(m, 10_000, 0.0) if normalised else m
    parts = None
    for lo, hi in ((0, 200), (200, 500), (500, 1000)):
        sinks.save_state(quantiles.sketches(m.where(f"cell_id >= {lo} and cell_id < {hi}")), str(tmp_path / str(hi)), k=quantiles.SIZE)
        own, meta = sinks.load_state(spark, str(tmp_path / str(hi)))
        assert meta == {"k": quantiles.SIZE}
        parts = own if parts is None else parts.unionByName(own)
    got = {r["gene_id"]: r["value"] for r in quantiles.quantiles(quantiles.merged(parts), [0.5]).collect()}
    for g, rows in m.toPandas().groupby("gene_id"):
        assert got[g] == pytest.approx(np.median(rows["x"]), rel=0.01)


def test_large_columns_stay_within_the_stated_error(spark):
    m = spark.range(400_000).select(F.lit(1).alias("gene_id"), (F.abs(F.hash("id")) % 1_000_003 + 1.0).alias("x"))
    parts = [quantiles.sketches(m.where(F.pmod(F.xxhash64("x"), F.lit(7)) == k)) for k in range(7)]
    state = parts[0]
    for p in parts[1:]:
        state = quantiles.merged(state.unionByName(p))  # one batch after the other
    qs = [0.01, 0.1, 0.5, 0.9, 0.99]
    e = quantiles.rank_error()
    assert e < 0.002
    for r in quantiles.held_rank(m, quantiles.quantiles(state, qs)).collect():
        assert r["n"] == 400_000 and r["least"] - e <= r["q"] <= r["most"] + e and r["low"] <= r["value"] <= r["high"]
    r = state.select(quantiles.rank(F.col("sketch"), F.lit(500_001.0)).alias("r")).first()["r"]
    assert r == pytest.approx(0.5, abs=0.004)


def test_zeros_nulls_and_empty_keys(spark):
    df = spark.createDataFrame([(1, 0.0), (1, None), (2, float("nan")), (2, 3.0), (None, 5.0), (None, 7.0)], "gene_id int, x double")
    got = {r["gene_id"]: (r["n"], r["value"]) for r in quantiles.quantiles(quantiles.sketches(df), [0.5]).collect()}
    assert got == {2: (1, 3.0), None: (2, 5.0)}
    assert quantiles.merged(quantiles.sketches(df.where("false"))).count() == 0


def test_a_restarted_stream_equals_one_pass(spark, tmp_path):
    m = spark.range(20_000).select((F.col("id") % 3).cast("int").alias("gene_id"), (F.col("id") % 997 + 1.0).alias("x"), (F.col("id") % 21).cast("int").alias("file"))
    for k in range(21):
        m.where(f"file = {k}").drop("file").coalesce(1).write.parquet(str(tmp_path / "all" / f"f={k:02d}"))
    read = lambda n, where: running.running_quantiles(spark, str(tmp_path / "some" / "*"), "gene_id int, x double", "gene_id", "x", checkpoint=str(tmp_path / where))  # noqa: E731, ARG005
    import shutil

    for upto in (5, 13, 21):  # files arrive; each run is a restart
        for k in range(21):
            if k < upto and not (tmp_path / "some" / f"f={k:02d}").exists():
                shutil.copytree(tmp_path / "all" / f"f={k:02d}", tmp_path / "some" / f"f={k:02d}")
        state = read(upto, "ckpt")
        want = {r["gene_id"]: r["n"] for r in m.where(f"file < {upto}").groupBy("gene_id").agg(F.count("*").alias("n")).collect()}
        assert {r["gene_id"]: r["n"] for r in quantiles.quantiles(state, [0.5]).collect()} == want
    e = quantiles.rank_error()
    for r in quantiles.held_rank(m, quantiles.quantiles(state, [0.1, 0.5, 0.9])).collect():
        assert r["least"] - e <= r["q"] <= r["most"] + e
