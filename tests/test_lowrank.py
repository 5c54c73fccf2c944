"""Truncated decomposition of sparse rows against numpy's of the dense matrix; merged and streamed fits; the driver's memory."""

import shutil

import numpy as np
import pytest

from rowloom.operators import lowrank
from rowloom.plans import catalogue
from rowloom.sources import virtual
from rowloom.streaming import running


def _sparse(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "cell_id long, gene_id long, x double")


def _error(x, v):
    return np.linalg.norm(x - x @ v.T @ v)


@pytest.mark.parametrize("correct", [False, True])
@pytest.mark.parametrize("k", [30, 80])
def test_flat_spectra_are_within_six_percent_of_the_least_error(spark, correct, k):
    rng = np.random.default_rng(1465)
    x = rng.normal(size=(2002, 100)) + rng.normal(size=100)
    z = x - x.mean(0) if correct else x
    m = _sparse(spark, x)
    genes = list(range(100))
    f = lowrank.fit(lowrank.sparse_rows(m, genes), genes, 2002, k, correct)
    least = np.sqrt((np.linalg.svd(z, compute_uv=False)[k:] ** 2).sum())
    assert _error(z, f.components) < 1.06 * least
    assert np.allclose(f.mean, x.mean(0) if correct else 0) and f.total == pytest.approx((z**2).sum() / 2002)
    assert np.allclose(f.components @ f.components.T, np.eye(k), atol=1e-9)


def test_whole_matrix_equals_numpy(spark, folder):
    m, cells = catalogue._norm(spark, folder), virtual.cells(spark, folder)
    genes = lowrank.vocabulary(m)
    rows = lowrank.sparse_rows(m, genes, cells)
    n = cells.count()
    f = lowrank.fit(rows, genes, n, 4, passes=12)
    ids = {r["cell_id"]: k for k, r in enumerate(cells.orderBy("cell_id").collect())}
    x = np.zeros((n, len(genes)))
    for r in m.collect():
        x[ids[r["cell_id"]], genes.index(r["gene_id"])] = r["x"]
    z = x - x.mean(0)
    s = np.linalg.svd(z, compute_uv=False)
    assert f.explained == pytest.approx(s[:4] ** 2 / n, rel=1e-3) and f.noise == pytest.approx((s[4:] ** 2).sum() / n / (len(genes) - 4), rel=1e-3)
    p = z @ f.components.T
    for r in lowrank.project(rows, f).collect():
        assert r["value"] == pytest.approx(p[ids[r["cell_id"]], r["pc"] - 1], abs=1e-9)


def test_chunks_and_empty_cells(spark, monkeypatch):
    monkeypatch.setattr(lowrank, "CHUNK", 40)
    x = np.random.default_rng(2).poisson(0.4, (60, 9)).astype(float)
    x[5] = x[17] = 0
    m, cells = _sparse(spark, x), spark.range(60).withColumnRenamed("id", "cell_id")
    rows = lowrank.sparse_rows(m, list(range(9)), cells)
    f = lowrank.fit(rows, list(range(9)), 60, 9)
    z = x - x.mean(0)
    assert f.explained == pytest.approx(np.linalg.svd(z, compute_uv=False) ** 2 / 60, abs=1e-9)
    got = {(r["cell_id"], r["pc"]): r["value"] for r in lowrank.project(rows, f).collect()}
    assert len(got) == 540 and got[5, 1] == pytest.approx(float(z[5] @ f.components[0]))


def test_many_genes_need_no_square_matrix(spark):
    genes = list(range(36_601))
    m = spark.range(3_000).selectExpr("id % 300 as cell_id", "pmod(hash(id), 36601) as gene_id", "1.0 + id % 7 as x").groupBy("cell_id", "gene_id").agg({"x": "sum"}).withColumnRenamed("sum(x)", "x")
    f = lowrank.fit(lowrank.sparse_rows(m, genes), genes, 300, 5, passes=2)
    assert f.components.shape == (5, 36_601) and (np.diff(f.explained) <= 0).all()


@pytest.mark.parametrize("correct", [False, True])
def test_a_restarted_stream_equals_one_pass(spark, tmp_path, correct):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 4)) @ rng.normal(size=(4, 30)) * 3 + rng.normal(size=(800, 30)) + 1
    for k in range(8):
        m = _sparse(spark, x[100 * k : 100 * k + 100]).selectExpr(f"cell_id + {100 * k} as cell_id", "gene_id", "x")
        m.coalesce(1).write.parquet(str(tmp_path / "all" / f"f={k}"))
        shutil.copytree(tmp_path / "all" / f"f={k}", tmp_path / "once" / f"f={k}")
        if k < 5:
            shutil.copytree(tmp_path / "all" / f"f={k}", tmp_path / "twice" / f"f={k}")
    go = lambda where: running.running_svd(spark, str(tmp_path / where / "*"), "cell_id long, gene_id long, x double", list(range(30)), 12, checkpoint=str(tmp_path / f"{where}-state"), correct=correct)
    once = go("once")
    assert go("twice").n == 500
    for k in range(5, 8):
        shutil.copytree(tmp_path / "all" / f"f={k}", tmp_path / "twice" / f"f={k}")
    twice = go("twice")
    z = x - x.mean(0) if correct else x
    least = np.sqrt((np.linalg.svd(z, compute_uv=False)[12:] ** 2).sum())
    for f in (once, twice):
        assert f.n == 800 and _error(z, f.components) < 1.06 * least and f.total == pytest.approx((z**2).sum() / 800)
    assert twice.explained == pytest.approx(once.explained, rel=1e-6)
