"""Ontology regression: stationary fits, against long plain proximal steps in numpy; label subsets; predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import estimators, ontology
from rowloom.plans import catalogue


def _data(spark, n=300, d=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    leaf = (x @ rng.normal(size=(d, 4))).argmax(1)
    y = np.where(np.arange(n) % 4 == 0, np.where(leaf < 2, 4, 5), leaf)
    desc = np.eye(6, dtype=bool)
    desc[4, :2] = desc[5, 2:4] = True
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "vec_id long, embedding array<double>, y int")
    return estimators.dense_rows(rows, F.col("y")), x, y, desc


def _gradient(x, y, desc, w, b):
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    under = desc[y] * p
    dz = (p - under / under.sum(1, keepdims=True)) / len(x)
    return -np.log(under.sum(1)).mean(), dz.T @ x, dz.sum(0)


def _soft(v, c):
    return np.sign(v) * np.maximum(np.abs(v) - c, 0)


@pytest.mark.parametrize("scale", [0.02, 1.0])
def test_fits_are_stationary_and_as_good_as_long_plain_steps(spark, scale):
    rows, x, y, desc = _data(spark)
    fit = estimators.ontology_regression(rows, 8, desc, scale, tolerance=1e-4)
    cost = 1 / (scale * len(x))
    assert fit.converged and fit.residual <= 1e-4 and fit.passes < 400
    loss, gw, gb = _gradient(x, y, desc, fit.w, fit.b)
    assert fit.objective == pytest.approx(loss + cost * np.abs(fit.w).sum())
    t = 1e-3
    assert np.abs(fit.w - _soft(fit.w - t * gw, t * cost)).max() / t < 2e-4 and np.abs(gb).max() < 2e-4
    w, b = np.zeros((6, 8)), np.zeros(6)
    for _ in range(6000):
        loss, gw, gb = _gradient(x, y, desc, w, b)
        w, b = _soft(w - 0.5 * gw, 0.5 * cost), b - 0.5 * gb
    assert fit.objective <= loss + cost * np.abs(w).sum() + 1e-4
    assert (np.abs(fit.w) < 1e-12).any()


def test_wrong_input_is_refused_and_few_passes_are_told(spark):
    rows, _, _, desc = _data(spark, 60)
    for bad in (np.zeros((2, 3), bool), np.zeros((2, 2), bool)):
        with pytest.raises(ValueError, match="diagonal"):
            estimators.ontology_regression(rows, 8, bad)
    fit = estimators.ontology_regression(rows, 8, desc, most_passes=4)
    assert not fit.converged and fit.passes <= 6


def test_subsets_take_their_ancestors(spark):
    clo = ontology.closure(spark.createDataFrame([("all", "a"), ("all", "b"), ("a", "a1"), ("a", "a2"), ("b", "a2")], "parent string, child string"))
    names, desc = estimators.hierarchy(clo)
    assert names == ["a", "a1", "a2", "all", "b"] and desc.sum() == 5 + 2 + 1 + 4
    names, desc = estimators.hierarchy(clo, ["a2"])
    assert names == ["a", "a2", "all", "b"] and desc[names.index("all")].all() and desc[0].tolist() == [True, True, False, False]
    assert estimators.hierarchy(clo, ["a1", "a2"], with_ancestors=False)[0] == ["a1", "a2"]
    with pytest.raises(ValueError, match="no such"):
        estimators.hierarchy(clo, ["zz"])


def test_labels_outside_the_subset_are_refused(spark):
    rows = spark.range(6).select(F.col("id").alias("cell_id"), F.array(F.lit(0)).alias("at"), F.array(F.lit(1.0)).alias("x"))
    labels = rows.select("cell_id", F.when(F.col("cell_id") < 3, "a").otherwise("b").alias("name"))
    got = estimators.labelled(rows, labels, ["a", "b"])
    assert {r["cell_id"]: r["y"] for r in got.collect()} == {k: int(k >= 3) for k in range(6)}
    with pytest.raises(ValueError, match="'b'"):
        estimators.labelled(rows, labels, ["a"])


def test_sparse_cells_learn_tissues_over_an_ontology(spark, folder):
    """Counts of genes against nations under regions, end to end on the given tables."""
    from rowloom.operators import lowrank
    from rowloom.sources import virtual

    m, cells = catalogue._norm(spark, folder), virtual.cells(spark, folder)
    names, desc = estimators.hierarchy(ontology.closure(virtual.edges(spark, folder)))
    genes = lowrank.vocabulary(m)
    rows = estimators.labelled(lowrank.sparse_rows(m, genes), cells.select("cell_id", F.col("tissue").alias("name")), names)
    fit = estimators.ontology_regression(rows, len(genes), desc, prior_scale=0.02, tolerance=1e-2)
    assert fit.converged
    p = estimators.ontology_predict(rows, fit.w, fit.b, desc).collect()
    root = names.index("ALL")
    assert all(r["p"][root] == pytest.approx(1.0) for r in p)
    plain = np.array([r["p"] for r in sorted(estimators.ontology_predict(rows, fit.w, fit.b, desc, propagate=False).collect(), key=lambda r: r["cell_id"])])
    full = np.array([r["p"] for r in sorted(p, key=lambda r: r["cell_id"])])
    assert np.allclose(full, np.minimum(plain @ desc.T, 1))
