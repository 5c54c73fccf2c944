"""Fits beyond linear ones: merged singular values, multi-start curves, a validation classifier, network scoring by joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fit = tuple[int, np.ndarray, np.ndarray]  # rows, mean, singular values times directions (k x d)


def svd_of(x: np.ndarray, k: int, correct: bool = True) -> Fit:
    mean = x.mean(0) if correct else np.zeros(x.shape[1])
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    return len(x), mean, s[:k, None] * v[:k]


def svd_merge(a: Fit, b: Fit, k: int, correct: bool = True) -> Fit:
    """Of two truncated fits; the difference of their means is a row of its own."""
    (n, m, s), (o, p, t) = a, b
    if not n or not o:
        return b if not n else a
    rows = [s, t] + ([np.sqrt(n * o / (n + o)) * (m - p)[None, :]] if correct else [])
    _, sv, v = np.linalg.svd(np.concatenate(rows), full_matrices=False)
    return n + o, (n * m + o * p) / (n + o), sv[:k, None] * v[:k]


def merged_svd(vectors: DataFrame, k: int, column: str = "embedding", fan_in: int = 8, rows: int = 4096) -> DataFrame:
    """n, mean, parts (k arrays): batches are fitted and merged in their tasks, then level by level, `fan_in` fits to a task, so no task or driver holds more than fan_in k x d numbers."""
    schema = "task long, n long, mean array<double>, parts array<array<double>>"

    def packed(task: int, f: Fit) -> pd.DataFrame:
        return pd.DataFrame({"task": [task], "n": [f[0]], "mean": [f[1].tolist()], "parts": [f[2].tolist()]})

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        have, fit = [], None
        for f in frames:
            have += f[column].tolist()
            while len(have) >= rows:
                one, have = svd_of(np.array(have[:rows], float), k), have[rows:]
                fit = one if fit is None else svd_merge(fit, one, k)
        if have:
            one = svd_of(np.array(have, float), k)
            fit = one if fit is None else svd_merge(fit, one, k)
        if fit:
            yield packed(TaskContext.get().partitionId(), fit)

    def level(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("task")
        fits = [(int(n), np.array(m), np.array([list(x) for x in q])) for n, m, q in zip(f["n"], f["mean"], f["parts"], strict=True)]
        out = fits[0]
        for x in fits[1:]:
            out = svd_merge(out, x, k)
        return packed(int(f["task"].iat[0]) // fan_in, out)

    df, tasks = vectors.select(column).mapInPandas(local, schema), vectors.rdd.getNumPartitions()
    while tasks > 1:
        df = df.groupBy(F.floor(F.col("task") / fan_in).alias("up")).applyInPandas(level, schema)
        tasks = -(-tasks // fan_in)
    return df.drop("task")


def curve_fit(x: np.ndarray, y: np.ndarray, curve: Callable, guesses: list[list[float]], rounds: int = 200) -> tuple[np.ndarray, float]:
    """Parameters with the least sum of squares over all starts, by damped Gauss-Newton steps with numeric slopes."""
    best = (np.array(guesses[0], float), np.inf)
    for g in guesses:
        p, damp = np.array(g, float), 1e-2
        rss = float(((curve(x, *p) - y) ** 2).sum())
        for _ in range(rounds):
            base = curve(x, *p)
            steps = np.maximum(np.abs(p), 1e-6) * 1e-6
            jac = np.stack([(curve(x, *(p + steps[i] * (np.arange(len(p)) == i))) - base) / steps[i] for i in range(len(p))], axis=1)
            a = jac.T @ jac
            move = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), jac.T @ (y - base), rcond=None)[0]
            with np.errstate(all="ignore"):
                new = float(((curve(x, *(p + move)) - y) ** 2).sum())
            if np.isfinite(new) and new < rss:
                done = rss - new <= 1e-14 * max(rss, 1e-300)
                p, rss, damp = p + move, new, max(damp / 5, 1e-12)
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e12:
                    break
        if rss < best[1]:
            best = (p, rss)
    return best


def fitted_curves(points: DataFrame, key: str, curve: Callable, guesses: list[list[float]]) -> DataFrame:
    """key, param, value, rss of points(key, x, y); a key's points are few."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        p, rss = curve_fit(f["x"].to_numpy(float), f["y"].to_numpy(float), curve, guesses)
        return pd.DataFrame({key: f[key].iat[0], "param": np.arange(len(p)), "value": p, "rss": rss})

    return points.groupBy(key).applyInPandas(run, f"{key} {points.schema[key].dataType.simpleString()}, param int, value double, rss double")


def validation_accuracy(train: DataFrame, test: DataFrame, features: str = "embedding", label: str = "label") -> DataFrame:
    """One row: accuracy on test of a softmax regression on vectors standardised by train."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    ready = lambda d: d.withColumn("__v", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    model = Pipeline(stages=[StandardScaler(inputCol="__v", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol=label, maxIter=50)]).fit(ready(train))
    return model.transform(ready(test)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def linear(rows: DataFrame, weights: DataFrame, bias: DataFrame | None = None, shift: DataFrame | None = None, row: str = "cell_id") -> DataFrame:
    """row, k, v of rows(row, i, v): sum of v w over weights(i, k, w), plus bias(k, b), plus each row's own shift(row, k, s) of its batch or covariates."""
    out = rows.join(weights, "i").groupBy(row, "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    if bias is not None:
        out = out.join(bias, "k").withColumn("v", F.col("v") + F.col("b")).drop("b")
    if shift is not None:
        out = out.join(shift, [row, "k"], "left").withColumn("v", F.col("v") + F.coalesce("s", F.lit(0.0))).drop("s")
    return out


def norms(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key, l2, l1: the root of all squares and the mean size of all numbers of each key."""
    e = vectors.select(key, F.explode(column).alias("v")).withColumn("v", F.col("v").cast("double"))
    return e.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2"), F.avg(F.abs("v")).alias("l1"))


def when_capable(model: object, method: str) -> Callable:
    """A model's predict, validate or test; TypeError if it has none."""
    f = getattr(model, method, None)
    if not callable(f):
        raise TypeError(f"{type(model).__name__} cannot {method}")
    return f

