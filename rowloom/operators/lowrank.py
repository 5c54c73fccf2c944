"""Truncated singular value decomposition of a sparse matrix, in passes over its rows.

A random start of n_genes x (k + OVERSAMPLE) numbers is multiplied by the matrix' Gram matrix once a
pass, without forming it: each task adds up its rows' share, Spark sums those by gene, and the driver makes
the columns orthonormal. The last pass' small matrix gives the values and directions. Means are taken out
afterwards, so rows stay sparse. Driver and tasks hold n_genes x (k + OVERSAMPLE) numbers, never
n_genes x n_genes; work grows with the values that are not zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from . import fits

OVERSAMPLE, PASSES = 10, 4
#: Products of a chunk of values with the start's columns that are held at once.
CHUNK = 1 << 21


@dataclass
class Fit:
    """components (k x genes), their explained variance over n, the mean, the genes in order, rows, and the variance of all directions."""

    components: np.ndarray
    explained: np.ndarray
    mean: np.ndarray
    genes: list
    n: int
    total: float

    @property
    def noise(self) -> float:
        """Mean variance of the directions left out: the closed form's sigma^2."""
        left = len(self.genes) - len(self.explained)
        return max(0.0, self.total - float(self.explained.sum())) / left if left else 0.0


def vocabulary(m: DataFrame, gene: str = "gene_id") -> list:
    return [r[0] for r in m.select(gene).distinct().orderBy(gene).collect()]  # the matrix' columns


def sparse_rows(m: DataFrame, genes: list, cells: DataFrame | None = None, cell: str = "cell_id", gene: str = "gene_id") -> DataFrame:
    """cell_id, at (positions in genes), x: one row a cell, written. Cells without values are there if `cells` names them."""
    spark = m.sparkSession
    kind = m.schema[gene].dataType.simpleString()
    places = spark.createDataFrame(list(enumerate(genes)), f"at int, `{gene}` {kind}")
    put = m.where("x != 0").join(F.broadcast(places), gene)
    rows = put.groupBy(F.col(cell).alias("cell_id")).agg(F.collect_list("at").alias("at"), F.collect_list(F.col("x").cast("double")).alias("x"))
    if cells is not None:
        rows = cells.select(F.col(cell).alias("cell_id")).join(rows, "cell_id", "left")
    rows = rows.select("cell_id", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("x", F.array().cast("array<double>")).alias("x"))
    path = new_folder(spark, "rows")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _chunks(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each value, position, value) for runs of rows whose products fit CHUNK."""
    at, x = b.column(b.schema.get_field_index("at")), b.column(b.schema.get_field_index("x"))
    sizes = np.asarray(at.value_lengths())
    places, values = at.flatten().to_numpy(), x.flatten().to_numpy()
    stops = np.cumsum(sizes)
    first, begin = 0, 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(stops, begin + CHUNK // width, side="right")))
        stop = int(stops[last - 1])
        yield first, last - first, np.repeat(np.arange(last - first), sizes[first:last]), places[begin:stop], values[begin:stop]
        first, begin = last, stop


def _times(rows: int, row: np.ndarray, places: np.ndarray, values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sparse rows times q."""
    out = np.zeros((rows, q.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(q[places] * values[:, None], starts, axis=0)
    return out


def _gram_times(rows: DataFrame, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(A'A q, column sums, sum of squares): one pass."""
    size, width = q.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, s, sq = np.zeros((size, width)), np.zeros(size), 0.0
        for b in batches:
            for _, n, row, places, values in _chunks(b, width):
                p = _times(n, row, places, values, q)
                s += np.bincount(places, values, size)
                sq += float(values @ values)
                for j in range(width):
                    z[:, j] += np.bincount(places, values * p[row, j], size)
        met = np.flatnonzero(s)
        if len(met):
            share = np.zeros(len(met))
            share[0] = sq
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(s[met]), pa.array(share), pa.array(list(z[met]), pa.list_(pa.float64()))], ["at", "s", "sq", "z"])

    parts = rows.select("at", "x").mapInArrow(part, "at int, s double, sq double, z array<double>")
    found = parts.groupBy("at").agg(F.sum("s").alias("s"), F.sum("sq").alias("sq"), F.array(*[F.sum(F.col("z")[j]) for j in range(width)]).alias("z")).collect()
    z, s = np.zeros((size, width)), np.zeros(size)
    for r in found:
        z[r["at"]], s[r["at"]] = r["z"], r["s"]
    return z, s, float(sum(r["sq"] for r in found))


def signed(v: np.ndarray) -> np.ndarray:
    """Rows with their largest loading positive."""
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None] if len(v) else v


def fit(rows: DataFrame, genes: list, n: int, k: int, correct: bool = True, passes: int = PASSES, seed: int = 0) -> Fit:
    """rows from sparse_rows, n the number of cells, those without values included."""
    size = len(genes)
    width = min(k + OVERSAMPLE, size)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for step in range(max(2, passes)):
        if step:
            q = np.linalg.qr(z)[0]
        z, s, sq = _gram_times(rows, q)
        mean = s / n if correct else np.zeros(size)
        z = z - n * np.outer(mean, mean @ q)
    small = q.T @ z
    values, u = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(values)[::-1][:k]
    return Fit(signed((q @ u[:, keep]).T), np.maximum(values[keep], 0) / n, mean, genes, n, sq / n - float(mean @ mean))


def project(rows: DataFrame, f: Fit) -> DataFrame:
    """cell_id, pc (from 1), value: (row - mean) times each component; the components go out with the tasks."""
    load, offset = f.components.T.copy(), f.components @ f.mean
    kind = rows.schema["cell_id"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(b.schema.get_field_index("cell_id"))
            for first, n, row, places, values in _chunks(b, load.shape[1]):
                p = _times(n, row, places, values, load) - offset
                yield pa.RecordBatch.from_arrays([names.slice(first, n), pa.array(list(p), pa.list_(pa.float64()))], ["cell_id", "p"])

    out = rows.mapInArrow(part, f"cell_id {kind}, p array<double>")
    return out.select("cell_id", F.posexplode("p").alias("pc", "value")).select("cell_id", (F.col("pc") + 1).alias("pc"), "value")


def merge(a: Fit, b: Fit, k: int, correct: bool = True) -> Fit:
    """Of fits to different rows of the same genes: the SVD of both and of the difference of their means."""
    if not a.n or not b.n:
        return b if not a.n else a
    scaled = lambda f: (f.n, f.mean, np.sqrt(f.explained * f.n)[:, None] * f.components)
    n, mean, parts = fits.svd_merge(scaled(a), scaled(b), k, correct)
    values = np.linalg.norm(parts, axis=1)
    square = lambda f: f.n * (f.total + float(f.mean @ f.mean))
    return Fit(signed(parts / np.maximum(values, 1e-300)[:, None]), values**2 / n, mean, a.genes, n, (square(a) + square(b)) / n - float(mean @ mean))


def save(spark: SparkSession, f: Fit, folder: str) -> None:
    """A row a gene: its mean and loadings; and one row of the rest."""
    kind = "string" if f.genes and isinstance(f.genes[0], str) else "long"
    loads = [(i, g, float(mu), [float(v) for v in c]) for i, (g, mu, c) in enumerate(zip(f.genes, f.mean, f.components.T, strict=True))]
    spark.createDataFrame(loads, f"at int, gene_id {kind}, mean double, load array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/genes")
    spark.createDataFrame([(f.n, f.total, [float(v) for v in f.explained])], "n long, total double, explained array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/fit")


def load(spark: SparkSession, folder: str) -> Fit:
    rows = spark.read.parquet(f"{folder}/genes").orderBy("at").collect()
    r = spark.read.parquet(f"{folder}/fit").first()
    return Fit(np.array([x["load"] for x in rows]).reshape(len(rows), -1).T, np.array(r["explained"]), np.array([x["mean"] for x in rows]), [x["gene_id"] for x in rows], r["n"], r["total"])
