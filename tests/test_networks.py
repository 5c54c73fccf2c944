"""Network scoring against plain numpy, with every kind of layer; sizes, unknown batches, chunks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import lowrank, networks
from rowloom.operators.networks import Layer, Network

N, G = 40, 12


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(1.2, (N, G)).astype(float)
    x[7] = 0
    batch = np.array([["a", "b", "zz"][i % 3] for i in range(N)])
    m = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "cell_id long, gene_id long, x double")
    cells = spark.createDataFrame([(i, str(b)) for i, b in enumerate(batch)], "cell_id long, batch string")
    return networks.coded(lowrank.sparse_rows(m, list(range(G)), cells), cells, ["a", "b"], "batch"), x, np.array([{"a": 0, "b": 1}.get(b, -1) for b in batch])


def _net(**more):
    rng = np.random.default_rng(9)
    w = lambda *s: rng.normal(size=s) / 3
    first = Layer(w(G, 6), bias=w(6), shift=w(2, 6), norm="batch", stored=(w(6), np.exp(w(6))), activation="relu")
    second = Layer(w(6, 5), norm="layer", activation="softplus")
    return Network(list(range(G)), encoder=[first, second], mean=Layer(w(5, 3), bias=w(3)), log_var=Layer(w(5, 3)), decoder=[Layer(w(3, 7), shift=w(2, 7), activation="relu")], scale=Layer(w(7, G), activation="softmax"), theta=np.exp(w(2, G)), **more)


def _latent(net, x, codes):
    h = np.log1p(x)
    f, s = net.encoder
    shift = lambda layer: np.array([layer.shift[c] if c >= 0 else np.zeros(layer.shift.shape[1]) for c in codes])
    h = h @ f.weight + f.bias + shift(f)
    h = np.maximum((h - f.stored[0]) / np.sqrt(f.stored[1] + 1e-5), 0)
    h = h @ s.weight
    h = np.log1p(np.exp((h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)))
    return h @ net.mean.weight + net.mean.bias, np.exp(h @ net.log_var.weight) + 1e-4, shift


def _shares(net, z, shift):
    d = net.decoder[0]
    e = np.exp(np.maximum(z @ d.weight + shift(d), 0) @ net.scale.weight)
    return e / e.sum(1, keepdims=True)


def test_latent_mean_and_variance(data, monkeypatch):
    rows, x, codes = data
    net = _net()
    mean, var, _ = _latent(net, x, codes)
    for chunk in (1 << 20, 30):
        monkeypatch.setattr(networks, "CHUNK", chunk)
        got = networks.encode(rows, net).collect()
        assert len(got) == N
        for r in got:
            assert np.allclose(r["mean"], mean[r["cell_id"]]) and np.allclose(r["var"], var[r["cell_id"]])


@pytest.mark.parametrize("likelihood", ["nb", "poisson"])
def test_losses_are_the_log_probabilities_of_all_counts(data, likelihood):
    rows, x, codes = data
    net = _net()
    mean, var, shift = _latent(net, x, codes)
    mu = x.sum(1, keepdims=True) * _shares(net, mean, shift) + 1e-10
    lg = np.vectorize(math.lgamma)
    theta = net.theta[codes] + 1e-10
    log = x * np.log(mu) - mu - lg(x + 1) if likelihood == "poisson" else lg(x + theta) - lg(theta) - lg(x + 1) + theta * np.log(theta / (theta + mu)) + x * np.log(mu / (theta + mu))
    kl = 0.5 * (var + mean**2 - 1 - np.log(var)).sum(1)
    for r in networks.losses(rows, net, likelihood).collect():
        assert r["reconstruction"] == pytest.approx(-log[r["cell_id"]].sum(), rel=1e-9, abs=1e-6) and r["kl"] == pytest.approx(kl[r["cell_id"]])


def test_expected_counts_in_another_batch(data):
    rows, x, codes = data
    net = _net()
    mean, _, _ = _latent(net, x, codes)
    one = lambda layer: np.tile(layer.shift[1], (N, 1))
    want = 500.0 * _shares(net, mean, one)
    got = networks.expected(rows, net, places=[2, 0], code=1, library=500.0).collect()
    assert all(np.allclose(r["expected"], want[r["cell_id"]][[2, 0]]) for r in got)
    by = {r["at"]: (r["n"], r["s"]) for r in networks.expected_by_gene(rows, net, code=1, library=500.0).collect()}
    assert all(by[j] == (N, pytest.approx(want[:, j].sum())) for j in range(G))


def test_samples_have_the_latents_moments(spark):
    net = Network([0], mean=Layer(np.array([[1.5, -2.0]])), log_var=Layer(np.array([[0.3, -1.0]])), log_input=False)
    rows = spark.range(20_000).select(F.col("id").alias("cell_id"), F.lit(0).alias("code"), F.array(F.lit(0)).alias("at"), F.array(F.lit(1.0)).alias("x"))
    s = np.array([r["sample"] for r in networks.encode(rows, net, samples=4).collect()])
    sd = np.sqrt(np.exp([0.3, -1.0]) + 1e-4)
    assert np.allclose(s.mean(0), [1.5, -2.0], atol=0.03) and np.allclose(s.std(0), sd, rtol=0.03) and abs(np.corrcoef(s.T)[0, 1]) < 0.03
    again = {r["cell_id"]: r["sample"] for r in networks.encode(rows.repartition(3), net, samples=4).limit(5).collect()}
    assert all(v == s[k].tolist() or np.allclose(v, s[k]) for k, v in again.items())


def test_wrong_networks_are_refused(data, monkeypatch):
    rows, _, _ = data
    for bad in ({"norm": "group"}, {"activation": "tanh"}, {"norm": "batch"}, {"stored": (np.zeros(2), np.ones(2))}):
        with pytest.raises(ValueError, match="norm"):
            Layer(np.ones((2, 2)), **bad)
    with pytest.raises(NotImplementedError):
        networks.losses(rows, _net(), "zinb")
    net = _net()
    net.log_var = None
    with pytest.raises(ValueError, match="variance"):
        networks.losses(rows, net)
    monkeypatch.setattr(networks, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="weights"):
        networks.encode(rows, _net())


def test_no_row_is_shuffled_by_gene(data):
    plan = networks.encode(data[0], _net())._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan
