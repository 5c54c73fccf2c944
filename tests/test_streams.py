"""Streams with state: samples and passes that are stopped and started again equal the batch result."""

import shutil

import pytest
from pyspark.sql import functions as F

from rowloom.operators import sampling
from rowloom.streaming import running


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    rows = spark.range(3_000).select("id", (F.col("id") % 3).alias("split"), (F.col("id") * 7919 % 1000 / 10.0).alias("x"))
    for k in range(6):
        rows.where(F.pmod("id", F.lit(6)) == k).coalesce(1).write.parquet(str(base / f"f={k}"))
    return base, rows


def _some(base, to, ks):
    for k in ks:
        if not (to / f"f={k}").exists():
            shutil.copytree(base / f"f={k}", to / f"f={k}")


@pytest.mark.parametrize("group", [None, "split"])
def test_a_restarted_sample_is_the_batch_sample(spark, files, tmp_path, group):
    base, rows = files
    go = lambda: running.running_sample(spark, str(tmp_path / "in" / "*"), "id long, split long, x double", "id", 40, 5, group, checkpoint=str(tmp_path / "ckpt"))
    for upto in ([4, 1], [0, 5, 2], [3]):
        _some(base, tmp_path / "in", upto)
        got = {r["id"] for r in go().collect()}
    want = sampling.priority_sample(rows, "id", 40, 5, group)
    assert got == {r["id"] for r in want.collect()} and len(got) == (40 if group is None else 120)
    if group is None:
        assert got == {r["id"] for r in sampling.reservoir(rows, "id", 40, 5).collect()}
    plan = want._jdf.queryExecution().executedPlan().toString()
    assert group is None or "WindowGroupLimit" in plan  # tasks pass on few rows


def test_samples_are_uniform(spark):
    rows = spark.range(2_000).withColumnRenamed("id", "k")
    n = [0] * 4
    for seed in range(12):
        for r in sampling.priority_sample(rows, "k", 200, seed).collect():
            n[r["k"] // 500] += 1
    assert sum(n) == 2_400 and all(520 < x < 680 for x in n)
    assert sampling.priority_sample(rows, "k", 5_000, 1).count() == 2_000


def test_two_passes_stopped_in_the_second_go_on(spark, files, tmp_path):
    base, rows = files
    calls = []

    def count(batch, before):
        calls.append("first")
        return batch.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))

    def mean(parts):
        return parts.groupBy("split").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))

    def above(batch, before):
        calls.append("second")
        if calls.count("second") == 4 and "stopped" not in calls:
            calls.append("stopped")
            raise RuntimeError("stop")
        return batch.join(before, "split").where("x > mean").groupBy("split").agg(F.count(F.lit(1)).alias("n"))

    def total(parts):
        return parts.groupBy("split").agg(F.sum("n").alias("n"))

    go = lambda: running.running_passes(spark, str(base / "*"), "id long, split long, x double", [(count, mean), (above, total)], checkpoint=str(tmp_path / "ckpt"))
    with pytest.raises(Exception, match="stop"):
        go()
    got = {r["split"]: r["n"] for r in go().collect()}
    assert calls.count("first") == 6 and calls.count("second") == 7
    want = rows.join(rows.groupBy("split").agg(F.avg("x").alias("mean")), "split").where("x > mean").groupBy("split").count()
    assert got == {r["split"]: r["count"] for r in want.collect()}
    assert {r["split"]: r["n"] for r in go().collect()} == got and calls.count("first") == 6


def test_windows_count_late_files_and_restarts(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:59:59", "a", 2.0), ("2024-01-01 11:00:00", "b", 4.0), ("2024-01-01 10:30:00", "a", 8.0), (None, "a", 16.0)]
    go = lambda: running.stream_windows(spark, str(tmp_path / "in" / "*"), "ts timestamp, event_type string, value double", checkpoint=str(tmp_path / "ckpt"))
    for k, part in enumerate((rows[:3], rows[3:])):
        df = spark.createDataFrame(part, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.select("ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in" / f"f={k}"))
        got = {(r["h"], r["event_type"]): (r["n"], r["total"]) for r in go().select(F.date_format("window.start", "HH").alias("h"), "event_type", "n", "total").collect()}
    assert got == {("10", "a"): (3, 11.0), ("11", "b"): (1, 4.0)}
