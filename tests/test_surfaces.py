"""Sums over genes as functions of the latent."""

import numpy as np
import pytest

from rowloom.operators import networks, surfaces
from rowloom.plans import catalogue, wider  # noqa: F401 (wider registers its queries)
from tests.oracle import differences


@pytest.mark.parametrize("genes", [1, 10, 3000])
def test_sums_at_nodes_are_those_of_all_genes(monkeypatch, genes):
    monkeypatch.setattr(surfaces, "CHUNK", 700)
    rng = np.random.default_rng(genes)
    for dims, wide in ((1, 0.3), (2, 0.15), (2, 0.0), (3, 0.1)):
        w, bias, theta = rng.normal(0, 1, (dims, genes)) * wide, rng.normal(0, 1, genes), np.exp(rng.normal(0, 1, genes))
        low, high = -rng.random(dims), 1 + 2 * rng.random(dims)
        s = surfaces.Surface(w, bias, low, high)
        assert s.even and not surfaces.Surface(w + np.arange(genes), bias, low, high).even or genes == 1
        z = np.vstack([low, high, low + (high - low) * rng.random((200, dims))])
        e = np.exp(z @ s.weight + s.bias)
        near, total = s.at(z), np.exp(rng.uniform(0, 9, len(z)))
        assert np.allclose(near @ s.totals(), e.sum(1), rtol=1e-12)
        assert np.allclose(s.by_gene((1 / e.sum(1)) @ near), (e / e.sum(1, keepdims=True)).sum(0), rtol=1e-12)
        if dims < 3:
            tau = np.log(total) - np.log(e.sum(1))
            pieces = s.sizes(total.min(), total.max())
            tables = [[s.log_sums(theta, p.nodes, 1e-10) for p in pieces]]
            got = networks._zeros(s, pieces, tables, near, tau, np.zeros(len(z), int))
            assert np.allclose(got, (theta * np.log1p((e * np.exp(tau)[:, None] + 1e-10) / theta)).sum(1), rtol=1e-11, atol=1e-9)


@pytest.mark.parametrize("name", ["vae_losses", "vae_reconstruct"])
def test_cells_do_not_meet_genes(spark, folder, monkeypatch, name):
    monkeypatch.setattr(networks, "DENSE_NUMBERS", 0)
    monkeypatch.setattr(networks, "_SIZES", 0)
    monkeypatch.setattr(networks.Network, "shares", None)  # the product of cells x genes
    assert differences(catalogue.QUERIES[name](spark, folder), folder, catalogue.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("likelihood", ["nb", "poisson"])
def test_losses_by_surfaces_equal_the_product(spark, monkeypatch, likelihood):
    rng = np.random.default_rng(2)
    rows = [(k, int(k % 3) - 1, sorted(int(v) for v in rng.choice(40, k % 6, replace=False)), [float(v) for v in rng.integers(1, 90, k % 6)]) for k in range(300)]  # some cells are empty, some of an unknown batch
    df = spark.createDataFrame(rows, "cell_id long, code int, at array<int>, x array<double>")
    net = networks.Network(list(range(40)), mean=networks.Layer(rng.normal(0, 0.3, (40, 2))), log_var=networks.Layer(rng.normal(0, 0.1, (40, 2))), scale=networks.Layer(rng.normal(0, 0.3, (2, 40)), bias=rng.normal(0, 1, 40), activation="softmax"), theta=np.exp(rng.normal(0, 1, (2, 40))))
    for samples in (None, 5):
        want = sorted(map(tuple, networks.losses(df, net, likelihood, samples).collect()))
        with monkeypatch.context() as m:
            m.setattr(networks, "DENSE_NUMBERS", 0)
            m.setattr(networks, "_SIZES", 0)
            got = sorted(map(tuple, networks.losses(df, net, likelihood, samples).collect()))
        assert np.allclose(got, want, rtol=1e-10, atol=1e-8)
    with monkeypatch.context() as m:
        want = sorted(map(tuple, networks.expected_by_gene(df, net).collect()))
        m.setattr(networks, "DENSE_NUMBERS", 0)
        assert np.allclose(sorted(map(tuple, networks.expected_by_gene(df, net).collect())), want, rtol=1e-10)
