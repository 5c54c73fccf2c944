"""Draws by inversion against sums of exact probabilities, at counts from 1 to a million."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions import draws
from rowloom.operators import prompts
from rowloom.operators import transforms as tr


def _binomial_cdf(n, p):
    k = np.arange(n + 1)
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in k]
    return np.cumsum(np.exp(log))


def _nb_cdf(mu, theta, most):
    k = np.arange(most)
    log = [math.lgamma(i + theta) - math.lgamma(theta) - math.lgamma(i + 1) + theta * math.log(theta / (theta + mu)) + i * math.log(mu / (theta + mu)) for i in k]
    return np.cumsum(np.exp(log))


U = np.concatenate([np.linspace(0, 1, 801)[:-1], [2.0**-32, 1 - 2.0**-32, 1e-7, 1 - 1e-7]])


@pytest.mark.parametrize("n", [1, 2, 7, 30, 324, 400, 2000, 20_000])
@pytest.mark.parametrize("p", [1e-4, 0.03, 0.3, 0.5, 0.9, 0.999])
def test_binomial_is_the_least_that_reaches_u(n, p):
    cdf = _binomial_cdf(n, p)
    got = draws.binomial_draws(np.full(len(U), n), np.full(len(U), p), U).astype(int)
    off = got != np.minimum(np.searchsorted(cdf, U), n)
    assert not (off & (np.abs(cdf[got] - U) > 1e-9) & (np.abs(cdf[np.maximum(got - 1, 0)] - U) > 1e-9)).any()
    assert off.mean() < 0.01


@pytest.mark.parametrize("mu", [0.01, 0.7, 26.0, 500.0, 9000.0])
@pytest.mark.parametrize("theta", [0.05, 0.5, 4.0, 200.0])
def test_negative_binomial_is_the_least_that_reaches_u(mu, theta):
    most = int(mu * (1 + 40 / min(theta, 4)) + 200)
    cdf = _nb_cdf(mu, theta, most)
    u = U[U < cdf[-1] - 1e-9]
    got = draws.negative_binomial_draws(np.full(len(u), mu), np.full(len(u), theta), u).astype(int)
    off = got != np.searchsorted(cdf, u)
    assert not (off & (np.abs(cdf[got] - u) > 1e-9) & (np.abs(cdf[np.maximum(got - 1, 0)] - u) > 1e-9)).any()
    assert off.mean() < 0.01


@pytest.mark.parametrize(("n", "p"), [(2_000, 0.5), (10**6, 0.5), (10**6, 0.9), (10**6, 3e-6), (10**9, 0.2)])
def test_medians_moments_and_tails_of_large_counts(n, p):
    u = (np.arange(40_000) + 0.5) / 40_000
    x = draws.binomial_draws(np.full(len(u), n), np.full(len(u), p), u)
    sd = math.sqrt(n * p * (1 - p))
    assert abs(x[20_000] - n * p) <= 1 and (np.diff(x) >= 0).all()
    assert x.mean() == pytest.approx(n * p, abs=0.01 * sd) and x.std() == pytest.approx(sd, rel=0.01)
    tails = draws.binomial_draws(np.full(2, n), np.full(2, p), np.array([2.0**-32, 1 - 2.0**-32]))
    assert n * p - 7 * sd < tails[0] < n * p - 3 * sd + 4 and n * p + 5 * sd < tails[1] < n * p + 14 * sd
    mu = n * p
    y = draws.negative_binomial_draws(np.full(len(u), mu), np.full(len(u), 4.0), u)
    assert y.mean() == pytest.approx(mu, rel=0.01) and y.var() == pytest.approx(mu + mu * mu / 4, rel=0.03)


def test_edges():
    n, p = np.array([0, 5, 5, 5, -1, 5]), np.array([0.5, 0, 1, 1.5, 0.5, 0.5])
    assert draws.binomial_draws(n, p, np.full(6, 0.0)).tolist() == [0, 0, 5, 5, 0, 0]
    assert draws.negative_binomial_draws(np.array([0, -1, 3.0]), np.array([1, 1, 0.0]), np.full(3, 0.9)).tolist() == [0, 0, 0]


def test_columns_keep_nulls_and_have_no_cap(spark):
    rows = [(2000.0, 0.5, 0.5), (324.0, 0.9, 0.5), (400.0, 0.9, 0.5), (None, 0.5, 0.5), (5.0, None, 0.5), (1e6, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "n double, p double, u double")
    got = [r[0] for r in df.select(draws.binomial(F.col("n"), F.col("p"), F.col("u"))).collect()]
    assert got == [1000, 292, 360, None, None, 500_000]
    mean = spark.range(20_000).select(draws.negative_binomial(F.lit(500.0), F.lit(4.0), (F.col("id") + 0.5) / 20_000).alias("x"))
    r = mean.agg(F.avg("x").alias("m"), F.median("x").alias("med"), F.max("x").alias("top")).first()
    assert r["m"] == pytest.approx(500, rel=0.01) and 440 < r["med"] < 480 and r["top"] > 2000


def test_downsampling_large_counts(spark):
    m = spark.range(4_000).select("id", F.lit(7).alias("gene_id"), F.lit(2000.0).alias("x")).withColumnRenamed("id", "cell_id")
    x = tr.binomial_resample(m, 0.5, 0.5 + 1e-12, 1.0, 3)
    r = x.agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert r["m"] == pytest.approx(1000, abs=2) and r["s"] == pytest.approx(math.sqrt(500), rel=0.05)
    t = prompts.library_target(m, 100.0, 500.0, 0.5, 1)
    d = prompts.downsample(m, t, 2).join(t, "cell_id")
    z = d.agg(F.avg((F.col("x") - F.col("target")) / F.sqrt(F.col("target") * (1 - F.col("p")))).alias("z")).first()["z"]
    assert abs(z) < 0.1


def test_log_gamma(spark):
    xs = [1e-6, 0.05, 0.5, 1.0, 2.5, 40.0, 1234.5, 1e8]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(draws.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-11)
