"""Trained classifiers: L1-penalised softmax regression, plain and over an ontology."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from .lowrank import _chunks, _times


def logistic_regression(rows: DataFrame, n: int, prior_scale: float = 1.0, features: str = "embedding", label: str = "label", rounds: int = 50):
    """Multinomial with a Laplace prior of the given scale: the mean loss gets |W| / (scale n)."""
    lr = LogisticRegression(featuresCol="__v", labelCol=label, family="multinomial", elasticNetParam=1.0, regParam=1.0 / (prior_scale * n), standardization=False, maxIter=rounds)
    return lr.fit(rows.withColumn("__v", array_to_vector(F.transform(features, lambda v: v.cast("double")))))


def coefficients(model) -> DataFrame:
    from pyspark.sql import SparkSession

    w = model.coefficientMatrix.toArray()
    return SparkSession.getActiveSession().createDataFrame([(k, j, float(v)) for k, r in enumerate(w) for j, v in enumerate(r)], "k int, j int, w double")


def _soft(v: np.ndarray, cut: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - cut, 0)


def hierarchy(closure: DataFrame, subset: list[str] | None = None, with_ancestors: bool = True) -> tuple[list[str], np.ndarray]:
    """(names in order, descendants) of closure(ancestor, descendant): of all terms, or of a subset and, if wanted, its ancestors.

    `descendants[k, c]` is true if c is k or below it. Names without a term raise ValueError.
    """
    pairs = [(r["ancestor"], r["descendant"]) for r in closure.select("ancestor", "descendant").collect()]  # an ontology's
    terms = {a for a, _ in pairs} | {b for _, b in pairs}
    if subset is not None:
        if unknown := sorted(set(subset) - terms):
            raise ValueError(f"no such terms: {unknown}")
        terms = set(subset) | ({a for a, b in pairs if b in set(subset)} if with_ancestors else set())
    names = sorted(terms)
    place = {n: k for k, n in enumerate(names)}
    out = np.eye(len(names), dtype=bool)
    for a, b in pairs:
        if a in place and b in place:
            out[place[a], place[b]] = True
    return names, out


@dataclass
class OntologyFit:
    """W (classes x features), b, the objective, the size of the proximal gradient at the end, passes over the data, and whether it is within tolerance."""

    w: np.ndarray
    b: np.ndarray
    objective: float
    residual: float
    passes: int
    converged: bool


def dense_rows(rows: DataFrame, label: Column, features: str = "embedding", key: str = "vec_id") -> DataFrame:
    """cell_id, at, x, y of an array column, written, in the form of `lowrank.sparse_rows`."""
    x = F.transform(features, lambda v: v.cast("double"))
    out = rows.select(F.col(key).alias("cell_id"), F.sequence(F.lit(0), F.size(features) - 1).alias("at"), x.alias("x"), label.cast("int").alias("y"))
    path = new_folder(rows.sparkSession, "features")
    out.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def labelled(rows: DataFrame, labels: DataFrame, names: list[str], key: str = "cell_id") -> DataFrame:
    """rows with y, the place of each row's name in labels(key, name); names that are not among `names` raise ValueError."""
    spark = rows.sparkSession
    places = spark.createDataFrame(list(enumerate(names)), "y int, name string")
    coded = labels.select(key, "name").join(F.broadcast(places), "name", "left")
    odd = [r["name"] for r in coded.where("y is null").select("name").distinct().limit(5).collect()]
    if odd:
        raise ValueError(f"labels that are not active: {odd}")
    return rows.join(coded.select(key, "y"), key)


def _probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _loss_and_gradient(rows: DataFrame, w: np.ndarray, b: np.ndarray, descendants: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Mean cross entropy of the propagated probability of each row's class, its gradients, rows: one pass, in which tasks return sums."""
    k, d = w.shape
    load = w.T.copy()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, gb, loss, n = np.zeros((d, k)), np.zeros(k), 0.0, 0
        for whole in batches:
            y = np.asarray(whole.column(2))
            for first, size, row, places, values in _chunks(whole.select(["at", "x"]), k):
                own = y[first : first + size]
                p = _probabilities(_times(size, row, places, values, load) + b)
                under = descendants[own] * p
                mass = np.maximum(under.sum(1, keepdims=True), 1e-300)
                loss -= float(np.log(mass).sum())
                dz = p - under / mass
                gb += dz.sum(0)
                for c in range(k):
                    g[:, c] += np.bincount(places, values * dz[row, c], d)
                n += size
        if n:
            at = np.arange(d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(np.concatenate([g, gb[None, :]])), pa.list_(pa.float64())), pa.array(np.where(at == d, loss, 0.0)), pa.array(np.where(at == d, n, 0))], ["at", "g", "loss", "n"])

    parts = rows.select("at", "x", "y").mapInArrow(part, "at int, g array<double>, loss double, n long")
    sums = parts.groupBy("at").agg(F.array(*[F.sum(F.col("g")[c]) for c in range(k)]).alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()
    out, loss, n = np.zeros((d + 1, k)), 0.0, 0
    for r in sums:
        out[r["at"]] = r["g"]
        loss, n = loss + r["loss"], n + r["n"]
    n = max(n, 1)
    return loss / n, out[:d].T / n, out[d] / n, n


def ontology_regression(rows: DataFrame, features: int, descendants: np.ndarray, prior_scale: float = 1.0, tolerance: float = 1e-4, most_passes: int = 400) -> OntologyFit:
    """Softmax regression whose class probability is that of the class and all below it, with a Laplace prior on W.

    rows(at, x, y), written. Accelerated proximal steps; a step is halved until the loss lies under its quadratic bound, and speed is
    lost whenever the objective would rise. It stops when no coordinate of the proximal gradient exceeds `tolerance`: there the fit is
    stationary. A pass moves classes x features numbers a task. Starts at zero, so it repeats.
    """
    if descendants.ndim != 2 or descendants.shape[0] != descendants.shape[1] or not descendants.diagonal().all():
        raise ValueError("descendants must be square with a true diagonal")
    k = len(descendants)
    w, b, vw, vb = np.zeros((k, features)), np.zeros(k), np.zeros((k, features)), np.zeros(k)
    speed, step, passes = 1.0, 1.0, 1
    loss, gw, gb, n = _loss_and_gradient(rows, w, b, descendants)
    cost = 1.0 / (prior_scale * n)
    best, residual = loss, np.inf
    while passes < most_passes:
        while True:
            nw, nb = _soft(vw - step * gw, step * cost), vb - step * gb
            dw, db = nw - vw, nb - vb
            new, ngw, ngb, _ = _loss_and_gradient(rows, nw, nb, descendants)
            passes += 1
            bound = loss + float((gw * dw).sum() + (gb * db).sum()) + (float((dw * dw).sum()) + float((db * db).sum())) / (2 * step)
            if new <= bound + 1e-12 or passes >= most_passes:
                break
            step /= 2
        objective = new + cost * float(np.abs(nw).sum())
        # stationarity of the new point, by the step it would take from there
        residual = max(float(np.abs(nw - _soft(nw - step * ngw, step * cost)).max()), float(np.abs(step * ngb).max())) / step
        if residual <= tolerance:
            return OntologyFit(nw, nb, objective, residual, passes, True)
        if objective > best + 1e-12:  # lose speed: on from the last good point's own gradient
            vw, vb, speed = w, b, 1.0
            loss, gw, gb, _ = _loss_and_gradient(rows, vw, vb, descendants)
            passes += 1
            continue
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        pull = (speed - 1) / faster
        vw, vb = nw + pull * (nw - w), nb + pull * (nb - b)
        w, b, best, speed = nw, nb, objective, faster
        if pull:
            loss, gw, gb, _ = _loss_and_gradient(rows, vw, vb, descendants)
            passes += 1
        else:
            loss, gw, gb = new, ngw, ngb
        step *= 1.1
    return OntologyFit(w, b, best, residual, passes, False)


def ontology_predict(rows: DataFrame, w: np.ndarray, b: np.ndarray, descendants: np.ndarray, propagate: bool = True) -> DataFrame:
    """cell_id, p: each row's probability of every class, that of the classes below it included."""
    load, up = w.T.copy(), descendants.T.astype(float)
    kind = rows.schema["cell_id"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = whole.column(0)
            for first, size, row, places, values in _chunks(whole.select(["at", "x"]), load.shape[1]):
                p = _probabilities(_times(size, row, places, values, load) + b)
                p = np.minimum(p @ up, 1.0) if propagate else p
                yield pa.RecordBatch.from_arrays([ids.slice(first, size), pa.array(list(p), pa.list_(pa.float64()))], ["cell_id", "p"])

    return rows.select("cell_id", "at", "x").mapInArrow(part, f"cell_id {kind}, p array<double>")
