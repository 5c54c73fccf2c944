"""Scores of classes and embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank


#: Weights that go out to values which then stay with their cells (some 100 MB); more meet them by a shuffle.
MOST_WEIGHTS = 2_000_000


def matmul(m: DataFrame, weights: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """cell_id, k, logit = sum of x w over weights(gene_id, k, w), plus bias(k, b)."""
    weights = F.broadcast(weights) if weights.count() <= MOST_WEIGHTS else weights
    out = m.join(weights, "gene_id").groupBy("cell_id", "k").agg(F.sum(F.col("x") * F.col("w")).alias("logit"))
    return out if bias is None else out.join(F.broadcast(bias), "k").withColumn("logit", F.col("logit") + F.col("b")).drop("b")


def argmax(logits: DataFrame) -> DataFrame:
    """The class of the largest logit, ties to the least class."""
    return logits.groupBy("cell_id").agg(F.max_by("k", F.struct("logit", -F.col("k"))).alias("k"))


def weighted_ce(losses: DataFrame, key: str) -> DataFrame:
    return losses.groupBy(key).agg((F.sum(F.col("loss") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("loss"))


def predictive_moments(probs: DataFrame) -> DataFrame:
    """cell_id, mean, var of the class number under probs(cell_id, k, p)."""
    mean = F.sum(F.col("k") * F.col("p"))
    return probs.groupBy("cell_id").agg(mean.alias("mean"), (F.sum(F.col("k") * F.col("k") * F.col("p")) - mean * mean).alias("var"))


def centroids(vectors: DataFrame, label: str, column: str = "embedding") -> DataFrame:
    """label, dim, n, c, q: mean per dimension, and mean square."""
    e = vectors.select(label, F.posexplode(column).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return e.groupBy(label, "dim").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("c"), F.avg(F.col("v") * F.col("v")).alias("q"))


def centroid_distances(cent: DataFrame, label: str) -> DataFrame:
    """a, b, dist between different classes' centroids."""
    x, y = cent.select(F.col(label).alias("a"), "dim", F.col("c").alias("ca")), cent.select(F.col(label).alias("b"), "dim", F.col("c").alias("cb"))
    return x.join(y, "dim").where("a != b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("ca") - F.col("cb")) * (F.col("ca") - F.col("cb")))).alias("dist"))


def silhouette(cent: DataFrame, label: str) -> DataFrame:
    """One row: the count-weighted silhouette of centroids."""
    intra = cent.groupBy(label).agg(F.max("n").alias("n"), F.sqrt(F.greatest(F.sum("q") - F.sum(F.col("c") * F.col("c")), F.lit(0.0))).alias("intra"))
    near = centroid_distances(cent, label).groupBy(F.col("a").alias(label)).agg(F.min("dist").alias("b"))
    s = (F.col("b") - F.col("intra")) / F.greatest("b", "intra", F.lit(1e-12))
    return intra.join(near, label).agg((F.sum(s * F.col("n")) / F.sum("n")).alias("silhouette"))


def weighted_spearman(pairs: DataFrame) -> DataFrame:
    """One row from pairs(x, y, w): the weighted correlation of average ranks; null below three pairs, 0 without variance."""
    r = pairs.withColumns({"rx": average_rank("x"), "ry": average_rank("y")})
    s = r.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.sum(F.expr(e) * F.col("w")).alias(n) for n, e in (("sx", "rx"), ("sy", "ry"), ("sxx", "rx*rx"), ("syy", "ry*ry"), ("sxy", "rx*ry"))])
    cov = F.col("sxy") / F.col("w") - F.col("sx") * F.col("sy") / F.col("w") / F.col("w")
    vx = F.col("sxx") / F.col("w") - F.pow(F.col("sx") / F.col("w"), 2)
    vy = F.col("syy") / F.col("w") - F.pow(F.col("sy") / F.col("w"), 2)
    return s.select(F.when(F.col("n") >= 3, F.coalesce(cov / F.nullif(F.sqrt(F.greatest(vx * vy, F.lit(0.0))), F.lit(0.0)), F.lit(0.0))).alias("rho"))


def nt_xent(pairs: DataFrame, tau: float, column: str = "embedding", batch: str = "batch") -> DataFrame:
    """One row: the mean contrastive loss over all batches of rows (batch, id, copy, vector): a row's positive is the other copy of its id, its negatives are its batch."""
    norm = F.sqrt(F.aggregate(F.transform(column, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, v: acc + v))
    unit = pairs.select(batch, "id", "copy", F.transform(column, lambda v: v.cast("double") / norm).alias("u"))
    a, b = unit.toDF("batch", "ia", "ca", "ua"), unit.toDF("batch", "ib", "cb", "ub")
    sim = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v) / tau
    s = a.join(b, "batch").where("ia != ib or ca != cb").withColumn("s", sim)  # a batch has a fixed number of vectors
    per = s.groupBy("batch", "ia", "ca").agg(F.log(F.sum(F.exp("s"))).alias("lse"), F.max(F.when(F.col("ia") == F.col("ib"), F.col("s"))).alias("pos"))
    return per.agg(F.avg(F.col("lse") - F.col("pos")).alias("loss"))


def nt_xent_batches(views: DataFrame, temperature: float = 1.0) -> DataFrame:
    """batch, n, loss of views(batch, id, copy, z): the mean of - log softmax of the other view's similarity among all others of the mini-batch.

    z are unit vectors; a mini-batch is one product of its rows, so it must be as small as those that models train on. Ids with one view are left out.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["copy", "id"])
        f = f[f.groupby("id")["id"].transform("size") == 2]
        n = len(f) // 2
        if not n:
            return pd.DataFrame({"batch": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"), "loss": pd.Series([], dtype="float64")})
        z = np.array(f["z"].tolist())
        s = z @ z.T / temperature
        np.fill_diagonal(s, -np.inf)
        top = s.max(1)
        log = np.log(np.exp(s - top[:, None]).sum(1)) + top
        own = s[np.arange(2 * n), np.r_[np.arange(n, 2 * n), np.arange(n)]]
        return pd.DataFrame({"batch": [f["batch"].iat[0]], "n": [2 * n], "loss": [float((log - own).mean())]})

    return views.select("batch", "id", "copy", "z").groupBy("batch").applyInPandas(run, "batch long, n long, loss double")
