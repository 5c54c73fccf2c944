"""A fit at each gene, for very many genes and for ties and outliers."""

import time

import numpy as np
import pytest

from rowloom.operators import hvg


def test_a_fit_at_each_of_many_genes_takes_seconds():
    rng = np.random.default_rng(3)
    x = rng.normal(-1.5, 0.8, 60_000)
    y = 0.3 + 1.1 * x + 0.15 * x**2 + rng.normal(0, 0.2, len(x))
    began = time.time()
    got = hvg.loess(x, y)
    assert time.time() - began < 20
    for i in rng.integers(0, len(x), 10):
        d = np.abs(x - x[i])
        h = np.sort(d)[int(np.ceil(0.3 * len(x))) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        assert got[i] == pytest.approx(np.polyval(np.polyfit(x - x[i], y, 2, w=np.sqrt(w)), 0), abs=1e-9)


@pytest.mark.parametrize("x", [np.round(np.linspace(-2, 2, 90), 1), np.full(30, 2.0), np.r_[np.linspace(0, 1e-3, 60), 5.0, 6.0], np.arange(4.0), np.r_[np.full(40, 1.0), np.linspace(0, 3, 20)]])
def test_fits_of_ties_and_outliers_are_those_of_the_points(x):
    y = np.sin(np.arange(len(x)) * 1.7) + x
    k = max(4, int(np.ceil(0.3 * len(x))))
    for i, e in enumerate(hvg.loess(x, y)):
        d = np.abs(x - x[i])
        h = max(np.sort(d)[k - 1], 1e-12)
        w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, None) ** 3)
        near = w > 0
        u = (x - x[i])[near]
        a = np.stack([np.ones(len(u)), u, u**2], axis=1) * w[near, None]
        assert e == pytest.approx(np.linalg.lstsq(a, y[near] * w[near], rcond=None)[0][0], abs=1e-7)
