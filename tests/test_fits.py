"""What SQL cannot hold against: fits, sketches, checks that raise, restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import estimators, fits, hvg, ontology, sampling, stats
from rowloom.plans import catalogue, wider
from rowloom.sources import fields, paths, shards, sinks, virtual
from rowloom.streaming import running


@pytest.fixture(scope="module")
def vectors(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    return e, np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], float)


def test_pca_error_is_near_the_least(vectors):
    e, x = vectors
    fit = stats.pca(e, 5)
    z = x - x.mean(0)
    _, s, _ = np.linalg.svd(z, full_matrices=False)
    left = np.linalg.norm(z - z @ fit["components"].T @ fit["components"])
    assert left <= 1.0001 * np.sqrt((s[5:] ** 2).sum())
    assert fit["explained"] == pytest.approx(s[:5] ** 2 / len(x), rel=1e-6)
    got = {(r["vec_id"], r["pc"]): r["value"] for r in stats.embed(e, fit, "vec_id").collect()}
    assert got[0, 1] == pytest.approx(float(z[0] @ fit["components"][0]), abs=1e-6)


@pytest.mark.parametrize("k", [30, 50])
def test_merged_fits_are_within_six_percent_of_the_least_error(vectors, k):
    e, x = vectors
    row = fits.merged_svd(e.repartition(11, "vec_id"), k, rows=70).first()
    parts = np.array([list(p) for p in row["parts"]])
    v = parts / np.linalg.norm(parts, axis=1, keepdims=True)
    z = x - x.mean(0)
    s = np.linalg.svd(z, compute_uv=False)
    assert row["n"] == len(x) and np.allclose(row["mean"], x.mean(0))
    assert np.linalg.norm(z - z @ v.T @ v) < 1.06 * np.sqrt((s[k:] ** 2).sum())


def test_probabilistic_pca_is_the_closed_form(vectors):
    e, x = vectors
    fit = stats.ppca(e, 5)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert fit["sigma2"] == pytest.approx(values[5:].mean(), rel=1e-6)
    assert (fit["W"] ** 2).sum(1) == pytest.approx(values[:5] - values[5:].mean(), rel=1e-6)


def test_sketch_is_within_one_percent(spark):
    df = spark.range(200_000).selectExpr("id % 5 as gene_id", "cast((id * 7919) % 1000 as double) as x")
    got = {r["gene_id"]: r["quantile"] for r in stats.nonzero_quantile_sketch(df).collect()}
    want = {r["gene_id"]: r["median"] for r in stats.nonzero_median(df).collect()}
    assert all(abs(got[g] - want[g]) <= 0.01 * 1000 for g in want)


def test_v3_on_loess_equals_the_definition(spark, folder):
    m, c = virtual.matrix(spark, folder), virtual.cells(spark, folder)
    rows = m.join(c.select("cell_id", "batch"), "cell_id").collect()
    sizes = {r["batch"]: r["n"] for r in c.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {(r["batch"], r["gene_id"]): r["norm_var"] for r in hvg.v3_norm_var(m, c, hvg.v3_clip(hvg.loess_trend(hvg.v3_moments(m, c)))).collect()}
    values: dict = {}
    for r in rows:
        values.setdefault(r["batch"], {}).setdefault(r["gene_id"], []).append(float(r["x"]))
    for batch, genes in values.items():
        n, names = sizes[batch], sorted(genes)
        dense = np.array([np.pad(genes[g], (0, n - len(genes[g]))) for g in names])
        mean, var = dense.mean(1), dense.var(1, ddof=1)
        x, y, est = np.log10(mean), np.log10(var), np.empty(len(names))
        for i in range(len(names)):  # local quadratic, tricube weights over the nearest 30 %
            d = np.abs(x - x[i])
            h = np.sort(d)[int(np.ceil(0.3 * len(x))) - 1]
            w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
            est[i] = np.polyval(np.polyfit(x - x[i], y, 2, w=np.sqrt(w)), 0)
        std = np.sqrt(10**est)
        clipped = np.minimum(dense, (std * np.sqrt(n) + mean)[:, None])
        want = (n * mean**2 + (clipped**2).sum(1) - 2 * mean * clipped.sum(1)) / ((n - 1) * std**2)
        assert [got[batch, g] for g in names] == pytest.approx(want.tolist(), rel=1e-6)


def test_curves_find_their_parameters():
    x = np.linspace(1, 50, 40)
    p, rss = fits.curve_fit(x, 3 + 20 * x**-0.7, lambda x, a, b, c: a + b * np.power(x, -c), [[0.0, 1.0, 0.2], [10.0, -5.0, 2.0]])
    assert p == pytest.approx([3, 20, 0.7], rel=1e-4) and rss < 1e-8


def test_regressions_reach_a_stationary_point(vectors):
    e, x = vectors
    y = np.array([r["label"] for r in e.orderBy("vec_id").select("label").collect()])
    model = estimators.logistic_regression(e, len(x), 1.0, rounds=200)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def objective(w):
        z = x @ w.T + b
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean() + np.abs(w).sum() / len(x))

    best, rng = objective(w), np.random.default_rng(0)
    assert all(objective(w + 0.02 * rng.normal(size=w.shape)) > best for _ in range(10))


def test_validation_classifier_learns(spark, folder):
    x = np.random.default_rng(4).normal(size=(400, 6))
    rows = spark.createDataFrame([(k, v.tolist(), int(v[:3].argmax())) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    r = fits.validation_accuracy(rows.where("vec_id % 5 != 0"), rows.where("vec_id % 5 = 0")).first()
    assert r["n"] == 80 and r["accuracy"] >= 0.85
    assert wider.validation_classifier(spark, folder).first()["n"] > 50


def test_checks_raise(spark, folder):
    c = virtual.cells(spark, folder)
    with pytest.raises(shards.SchemaMismatch, match="missing column assay"):
        shards.check_schema(c, c.drop("assay"))
    shards.check_schema(c, c, categorical=["assay"])
    with pytest.raises(ValueError, match="differs"):
        fields.collate([c.withColumn("v", F.lit(1)), c.withColumn("v", F.lit(2))], ["v"])
    with pytest.raises(ValueError, match="columns"):
        fields.collate([c, c.drop("assay")])
    with pytest.raises(Exception, match="must be positive"):
        c.select(fields.required(F.lit(-1.0), F.lit(-1.0) > 0, "must be positive")).collect()
    with pytest.raises(OSError):
        sinks.check_disk_space(1000, 100, 10)
    assert sinks.check_disk_space(1000, 100, 5) == 500
    with pytest.raises(ValueError):
        shards.read_shards(spark, "a_{0..2}.parquet", keys=["one"])
    with pytest.raises(ValueError, match="without distances"):
        ontology.distance_slice(ontology.distances(virtual.edges(spark, folder)), ["ALL", "no such term"])
    with pytest.raises(ValueError, match="cycle"):
        ontology.closure(spark.createDataFrame([(str(k), str((k + 1) % 80)) for k in range(80)], "parent string, child string"))
    with pytest.raises(TypeError):
        fits.when_capable(object(), "predict")
    with pytest.raises(ValueError):
        sinks.check_resume({"seed": 1}, {"seed": 2})
    assert sampling.rank_and_replicas(4) == (0, 1)


def test_paths():
    assert paths.resolve("file:///a/b") == ("local", "file:///a/b") and paths.resolve("/a/b") == ("local", "/a/b")
    assert paths.resolve("gs://bucket/a/b") == ("connector", "gs://bucket/a/b") and paths.resolve("https://h/x")[0] == "web"
    for bad in ("gs://bucket", "gs:/x", "odd://a/b"):
        with pytest.raises(ValueError):
            paths.resolve(bad)
    assert shards.expand_braces("a_{08..10}_{x,y}") == [f"a_{n}_{s}" for n in ("08", "09", "10") for s in "xy"]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    spark.range(10).selectExpr("id % 2 as k", "cast(id as double) as v").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: {r["k"]: (r["n"], r["s"]) for r in running.running_stats(spark, str(tmp_path / "in"), "k long, v double", "k", "v", checkpoint=str(tmp_path / "state")).collect()}
    assert read() == {0: (5, 20.0), 1: (5, 25.0)}
    spark.range(2).selectExpr("id as k", "100.0D as v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert read() == {0: (6, 120.0), 1: (6, 125.0)}


@pytest.mark.parametrize("name", ["category_symmetric_difference", "mutual_exclusivity", "ancestors_of_subset", "glob_matches", "restricted_ontology"])
def test_results_are_not_empty(spark, folder, name):
    assert catalogue.QUERIES[name](spark, folder).count() > 1


def test_draws_do_not_depend_on_the_partitioning(spark, folder):
    from rowloom.operators import transforms as tr

    m = virtual.matrix(spark, folder)
    for f in (lambda x: tr.dropout(x, 0.1, 0.3, 0.5, 7), lambda x: tr.binomial_resample(x, 0.5, 0.9, 1.0, 7), lambda x: tr.gaussian_noise(x, 0.1, 0.2, 1.0, 7)):
        assert f(m.repartition(3)).exceptAll(f(m.repartition(17, "gene_id"))).count() == 0
