"""One-pass statistics by gene and batch. Means divide by the number of cells, zeros included."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def onepass(m: DataFrame, cells: DataFrame, shift: DataFrame | None = None) -> DataFrame:
    """gene_id, n, mean, var, std (population); `shift` (gene_id, shift) takes the sums around a value, zeros corrected for."""
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    if shift is None:
        sums = m.groupBy("gene_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).crossJoin(F.broadcast(n)).withColumn("k", F.lit(0.0))
    else:
        d = F.col("x") - F.col("k")
        sums = m.join(F.broadcast(shift.select("gene_id", F.col("shift").alias("k"))), "gene_id").groupBy("gene_id", "k").agg(F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.count(F.lit(1)).alias("nnz")).crossJoin(F.broadcast(n))
        absent = F.col("n") - F.col("nnz")
        sums = sums.withColumns({"s": F.col("s") - absent * F.col("k"), "q": F.col("q") + absent * F.col("k") * F.col("k")})
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    return sums.select("gene_id", "n", (F.col("k") + mean).alias("mean"), var.alias("var"), F.sqrt(var).alias("std"))


def onepass_by_batch(m: DataFrame, cells: DataFrame) -> DataFrame:
    """batch, gene_id, n, mean, var (population) for the pairs that have values."""
    n = cells.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    sums = m.join(cells.select("cell_id", "batch"), "cell_id").groupBy("batch", "gene_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.join(F.broadcast(n), "batch").select("batch", "gene_id", "n", mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("var"))


def nonzero_median(m: DataFrame) -> DataFrame:
    """gene_id, median: equal values are counted before they move, so a task holds a gene's distinct values, not its cells."""
    counts = m.where("x != 0").groupBy("gene_id", "x").agg(F.count(F.lit(1)).alias("c"))
    gene = Window.partitionBy("gene_id")
    total, upto = F.sum("c").over(gene), F.sum("c").over(gene.orderBy("x"))
    placed = counts.select("gene_id", F.col("x").cast("double").alias("x"), total.alias("n"), upto.alias("upto"), (upto - F.col("c")).alias("below"))
    holds = lambda place: ((F.col("below") < place) & (place <= F.col("upto"))).cast("int")
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    return placed.groupBy("gene_id").agg((F.sum(F.col("x") * (holds(low) + holds(high))) / 2).alias("median"))


def nonzero_quantile_sketch(m: DataFrame, q: float = 0.5, accuracy: int = 10_000) -> DataFrame:
    """The mergeable variant for columns too large for exact order statistics."""
    return m.where("x != 0").groupBy("gene_id").agg(F.percentile_approx("x", q, accuracy).alias("quantile"))


def gram(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """i, j, n, sum_i, sum_ij of a dense array column: each task sums outer products, so only d x d numbers move."""
    import pandas as pd

    d = vectors.select(F.size(column)).first()[0]

    def part(frames):
        s, g, n = np.zeros(d), np.zeros((d, d)), 0
        for f in frames:
            if len(f):
                a = np.asarray(f[column].tolist(), float)
                s, g, n = s + a.sum(0), g + a.T @ a, n + len(a)
        i, j = np.divmod(np.arange(d * d), d)
        yield pd.DataFrame({"i": i, "j": j, "n": n, "sum_i": s[i], "sum_ij": g.ravel()})

    parts = vectors.select(column).mapInPandas(part, "i int, j int, n long, sum_i double, sum_ij double")
    return parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("sum_i").alias("sum_i"), F.sum("sum_ij").alias("sum_ij"))


def pca(vectors: DataFrame, k: int, column: str = "embedding", mean_correction: bool = True) -> dict:
    """Exact principal components from the Gram matrix: components (k x d), mean, explained variance (over n). The largest loading of each is positive."""
    rows = gram(vectors, column).collect()  # d x d numbers
    d = max(r["i"] for r in rows) + 1
    g, s = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        g[r["i"], r["j"]] = r["sum_ij"]
        s[r["i"]] = r["sum_i"]
    n = rows[0]["n"]
    mean = s / n if mean_correction else np.zeros(d)
    values, vecs = np.linalg.eigh(g / n - np.outer(mean, mean))
    values, vecs = values[::-1], vecs[:, ::-1].T
    vecs = vecs * np.sign(vecs[np.arange(d), np.abs(vecs).argmax(1)])[:, None]
    return {"components": vecs[:k], "mean": mean, "explained": values[:k], "rest": values[k:], "n": n}


def ppca(vectors: DataFrame, k: int, column: str = "embedding") -> dict:
    """Probabilistic PCA in closed form: W, sigma^2 = mean of the discarded eigenvalues."""
    fit = pca(vectors, k, column)
    sigma2 = float(fit["rest"].mean()) if len(fit["rest"]) else 0.0
    return fit | {"sigma2": sigma2, "W": fit["components"] * np.sqrt(np.maximum(fit["explained"] - sigma2, 0))[:, None]}


def embed(vectors: DataFrame, fit: dict, key: str, column: str = "embedding") -> DataFrame:
    """key, pc (1-based), value: (x - mean) times each component, without leaving the JVM."""
    spark = vectors.sparkSession
    loads = spark.createDataFrame([(k + 1, [float(v) for v in c], float(c @ fit["mean"])) for k, c in enumerate(fit["components"])], "pc int, load array<double>, offset double")
    dot = F.aggregate(F.zip_with(column, "load", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.crossJoin(F.broadcast(loads)).select(key, "pc", (dot - F.col("offset")).alias("value"))
