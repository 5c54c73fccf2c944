"""The interpolation tree against direct fits, ties and retries, speed at the size of a genome; argument checks."""

import time

import numpy as np
import pytest

from rowloom.operators import hvg


def _genes(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.normal(-1.5, 0.8, n))
    return x, 0.3 + 1.1 * x + 0.15 * x**2 + rng.normal(0, 0.2, n)


def test_few_fits_are_close_to_a_fit_at_each_point():
    x, y = _genes(1200)
    a, b = hvg.loess_interpolated(x, y), hvg.loess(x, y)
    assert np.abs(a - b).max() < 0.03 and np.abs(a - b).mean() < 0.005
    std = lambda e: y - e
    top = lambda e: set(np.argsort(std(e))[::-1][:200].tolist())
    assert len(top(a) & top(b)) / len(top(a) | top(b)) > 0.95


def test_a_quadratic_is_met_exactly_and_order_does_not_matter():
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 3, 500)
    y = 2 - x + 0.5 * x**2
    assert hvg.loess_interpolated(x, y, 0.4) == pytest.approx(y, abs=0.02)
    lin = 4 - 3 * x
    assert hvg.loess_interpolated(x, lin) == pytest.approx(lin, abs=1e-9)


def test_a_genome_takes_seconds():
    x, y = _genes(36_601)
    t = time.time()
    hvg.loess_interpolated(x, y)
    assert time.time() - t < 10


def test_ties_are_cut_beside_and_retried():
    x, y = _genes(400)
    x = np.round(x, 1)
    assert np.abs(hvg.loess_with_jitter(x, y) - hvg.loess(x, y)).mean() < 0.05
    same = np.concatenate([np.full(300, 0.5), np.linspace(0, 1, 100)])
    assert np.abs(hvg.loess_interpolated(same, same) - same).max() < 1e-6
    with pytest.raises(ValueError, match="three places"):
        hvg.loess_interpolated(np.full(50, 2.0), np.arange(50.0))
    assert np.isfinite(hvg.loess_with_jitter(np.full(50, 2.0), np.arange(50.0))).all()
    assert np.abs(hvg.loess_with_jitter(same, same) - same).max() < 0.05
    with pytest.raises(ValueError, match="span"):
        hvg.loess_interpolated(x[:8], y[:8])
    with pytest.raises(ValueError, match="jitter"):
        hvg.loess_with_jitter(x[:8], y[:8])


def test_jitter_grows_until_the_fit_succeeds(monkeypatch):
    tried = []

    def fails(x, y, span):
        tried.append(float(np.abs(x - x0).max()))
        if len(tried) < 5:
            raise ValueError("singular")
        return y

    x0, y = _genes(60)
    monkeypatch.setattr(hvg, "loess_interpolated", fails)
    assert (hvg.loess_with_jitter(x0, y, least=1e-9) == y).all()
    assert tried[0] == 0 and all(t <= 1e-9 * 10**k for k, t in enumerate(tried[1:])) and tried[4] > 1e-7
    tried.clear()
    with pytest.raises(ValueError, match="jitter"):
        hvg.loess_with_jitter(x0, y, least=1e-7, most=1e-6)
    assert len(tried) == 3


def test_moments_are_checked(spark):
    df = lambda rows: spark.createDataFrame(rows, "batch string, gene_id long, mean double, var double")
    good = [("a", 1, 1.0, 1.0), ("a", 2, 1.0, 1.0), ("b", 1, 1.0, 1.0), ("b", 2, 1.0, 1.0)]
    hvg.check_moments(df(good), 2, "batch")
    hvg.check_moments(df(good[:2]), 1)
    for rows, n, text in (([*good, ("c", 1, 1.0, 1.0)], 1, "missing in c"), ([*good, ("a", 1, 2.0, 1.0)], 1, "repeated in a"), ([*good, ("b", 3, None, 1.0), ("a", 3, 1.0, 1.0)], 1, "without moments"), ([*good, ("a", None, 1.0, 1.0)], 1, "unnamed"), (good, 3, "cannot be flagged"), (good, 0, "cannot be flagged")):
        with pytest.raises(ValueError, match=text):
            hvg.check_moments(df(rows), n, "batch")
    with pytest.raises(ValueError, match="no columns"):
        hvg.check_moments(df(good).drop("var"))
    with pytest.raises(ValueError, match="surface"):
        hvg.loess_trend(df(good), surface="flat")
