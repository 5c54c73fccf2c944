"""Row and column transforms of the sparse matrix (cell_id, gene_id, x); absent entries are zeros."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import binomial
from ..functions.hashes import GridDraws

#: Rows of the grid of cells and genes that are held at once, and that one task makes, about.
GRID_ROWS, TASK_GRID_ROWS = 1 << 17, 20_000_000


def normalize_total(m: DataFrame, target: float = 10_000.0, eps: float = 1e-6, totals: DataFrame | None = None) -> DataFrame:
    """x * target / (total + eps), the total given as (cell_id, total) or summed over the row."""
    if target <= 0 or eps < 0:
        raise ValueError("target must be positive and eps not negative")
    if totals is None:
        return m.withColumn("x", F.col("x") * target / (F.sum("x").over(Window.partitionBy("cell_id")) + eps))
    return m.join(totals, "cell_id").withColumn("x", F.col("x") * target / (F.col("total") + eps)).drop("total")


def log1p(m: DataFrame) -> DataFrame:
    return m.withColumn("x", F.log1p("x"))


def densify(m: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Every cell with every gene: cells x genes rows, made where a cell's values are; only those and the cells move. Cells and genes are distinct."""
    return _grid(m, cells, genes, lambda names: lambda rows, x: x)


def _grid(m: DataFrame, cells: DataFrame, genes: DataFrame, changed: Callable[[list[bytes]], Callable[[list[bytes], np.ndarray], np.ndarray]]) -> DataFrame:
    """The dense rows, with changed(the genes as keys)(chunk's cells as keys, chunk's cells x genes values) as their x; keys are what `uniform` hashes after the seed."""
    spark, kinds = m.sparkSession, {c: m.schema[c].dataType.simpleString() for c in ("cell_id", "gene_id")}
    key = lambda c: F.coalesce(F.concat(F.lit("|"), F.col(c).cast("string")), F.lit(""))
    ids = genes.select(F.col("gene_id").cast(kinds["gene_id"])).distinct().orderBy("gene_id")
    names = ids.select("gene_id", key("gene_id").alias("key")).toArrow()  # the matrix' columns
    shared = spark.sparkContext.broadcast((names["gene_id"].combine_chunks(), [k.encode() for k in names["key"].to_pylist()]))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, keys = shared.value
        change = changed(keys)
        step = max(1, GRID_ROWS // max(1, len(every)))
        for whole in batches:
            whole = whole.take(pc.sort_indices(pc.binary_length(whole.column(3))))  # keys of one length are hashed together
            for begin in range(0, whole.num_rows, step):
                b = whole.slice(begin, step)
                sizes = np.asarray(b.column(1).value_lengths().fill_null(0))
                at = pc.index_in(b.column(1).flatten(), value_set=every)
                row, known = np.repeat(np.arange(len(sizes)), sizes), np.asarray(at.is_valid())
                x = np.zeros((len(sizes), len(every)))
                x[row[known], np.asarray(at.drop_null())] = np.asarray(b.column(2).flatten())[known]
                x = change([k.encode() for k in b.column(3).to_pylist()], x)
                cell = b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), len(every))))
                yield pa.RecordBatch.from_arrays([cell, every.take(pa.array(np.tile(np.arange(len(every)), len(sizes)))), pa.array(x.ravel())], ["cell_id", "gene_id", "x"])

    values = m.where("x is not null and gene_id is not null").groupBy("cell_id").agg(F.collect_list("gene_id").alias("genes"), F.collect_list(F.col("x").cast("double")).alias("xs"))
    rows = cells.select("cell_id").join(values, "cell_id", "left").withColumn("key", key("cell_id"))
    parts = -(-cells.count() * len(names) // TASK_GRID_ROWS)
    rows = rows.repartition(max(parts, spark.sparkContext.defaultParallelism), "cell_id") if parts > 1 else rows
    return rows.mapInArrow(part, f"cell_id {kinds['cell_id']}, gene_id {kinds['gene_id']}, x double")


def noisy_grid(m: DataFrame, cells: DataFrame, genes: DataFrame, lo: float, hi: float, p_apply: float = 1.0, seed: int = 0, digits: int | None = None) -> DataFrame:
    """gaussian_noise(densify(...)), rounded half away from zero if `digits` are given, made where the grid is: no row of it is hashed as text."""

    def changed(genes_: list[bytes]) -> Callable[[list[bytes], np.ndarray], np.ndarray]:
        draws, alone = GridDraws(genes_), GridDraws([b""])
        uniform_ = lambda k, rows: draws([b"%d%s" % (k, r) for r in rows])

        def change(rows: list[bytes], x: np.ndarray) -> np.ndarray:
            noise, b = uniform_(seed + 2, rows), uniform_(seed + 3, rows)
            np.subtract(1, noise, out=noise)
            np.log(noise, out=noise)
            noise *= -2
            np.sqrt(noise, out=noise)
            b *= 2 * math.pi
            noise *= np.cos(b, out=b)
            sd = uniform_(seed + 1, rows)
            sd *= hi - lo
            sd += lo
            noise *= sd
            if p_apply < 1:
                noise[~(alone([b"%d%s" % (seed, r) for r in rows])[:, 0] < p_apply)] = 0
            x += noise
            return x if digits is None else _rounded(x, digits)

        return change

    return _grid(m, cells, genes, changed)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    y = x * 10.0**digits
    whole = np.trunc(y)
    y -= whole
    y *= 2
    whole += np.trunc(y, out=y)
    whole /= 10.0**digits
    return whole


def z_score(m: DataFrame, stats: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(x - mean) / (std + eps) with stats(gene_id, mean, std): a row for each value, and with a null cell_id what each gene's zeros become."""
    z = lambda x: (x - F.col("mean")) / (F.col("std") + eps)
    s = stats.select("gene_id", "mean", "std")
    own = m.join(s, "gene_id").select("cell_id", "gene_id", z(F.col("x")).alias("x"))
    return own.unionByName(s.select(F.lit(None).cast("long").alias("cell_id"), "gene_id", z(F.lit(0.0)).alias("x")))


def divide_by_scale(m: DataFrame, scales: DataFrame, eps: float = 1e-6) -> DataFrame:
    """x / (scale + eps); an undefined scale divides by 1 / eps + eps."""
    s = F.coalesce(F.nanvl("scale", F.lit(None).cast("double")), F.lit(1 / eps)) + eps
    return m.join(F.broadcast(scales.select("gene_id", s.alias("s"))), "gene_id").withColumn("x", F.col("x") / F.col("s")).drop("s")


def center_per_cell(m: DataFrame, n_genes: int) -> DataFrame:
    """x less the cell's mean over all genes: a row for each value, and with a null gene_id what each cell's zeros become."""
    mean = F.sum("x").over(Window.partitionBy("cell_id")) / n_genes
    own = m.select("cell_id", "gene_id", (F.col("x") - mean).alias("x"))
    zeros = m.groupBy("cell_id").agg((-F.sum("x") / n_genes).alias("x"))
    return own.unionByName(zeros.select("cell_id", F.lit(None).cast(m.schema["gene_id"].dataType).alias("gene_id"), "x"))


def pflogpf(m: DataFrame, n_genes: int, target: float = 1.0, eps: float = 1e-6) -> DataFrame:
    return center_per_cell(log1p(normalize_total(m, target, eps)), n_genes)


def filter_vocabulary(genes: DataFrame, wanted: list[str], ordering: bool = True, allow_missing: bool = False) -> tuple[DataFrame, list[str]]:
    """(gene_id, var_name, pos) of the genes that a filter lets through, and the wanted names that there are none of; no value is read."""
    if not wanted:
        raise ValueError("the list of genes is empty")
    if allow_missing and not ordering:
        raise ValueError("missing genes can only be filled in list order")
    names = genes.sparkSession.createDataFrame(list(enumerate(wanted)), "list_pos int, var_name string")
    found = names.join(genes.select("gene_id", "var_name"), "var_name")
    missing = sorted(r[0] for r in names.join(genes, "var_name", "left_anti").select("var_name").collect())
    if len(missing) == len(set(wanted)):
        raise ValueError("none of the genes is known")
    if missing and ordering and not allow_missing:
        raise AssertionError(f"unknown genes: {missing}")
    pos = F.col("list_pos") if ordering else F.row_number().over(Window.orderBy("gene_id")) - 1
    return found.select("gene_id", "var_name", pos.alias("pos")), missing


def filter_genes(m: DataFrame, genes: DataFrame, wanted: list[str], ordering: bool = True, allow_missing: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """Values of the wanted genes with `pos`: their place in the list (ordering) or among the input's genes."""
    placed, missing = filter_vocabulary(genes, wanted, ordering, allow_missing)
    out = m.join(F.broadcast(placed), "gene_id").select("cell_id", "pos", "var_name", "x")
    if not (missing and allow_missing):
        return out
    names = m.sparkSession.createDataFrame(list(enumerate(wanted)), "list_pos int, var_name string")
    base = cells if cells is not None else m
    zeros = base.select("cell_id").distinct().crossJoin(F.broadcast(names.where(F.col("var_name").isin(missing)))).select("cell_id", F.col("list_pos").alias("pos"), "var_name", F.lit(0.0).alias("x"))
    return out.unionByName(zeros)


def uniform(seed: int, *key: str) -> Column:
    """A number in [0, 1) for each key: the same on any partitioning and any engine, from 32 bits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def randomize(original: DataFrame, changed: Column, p_apply: float, seed: int) -> DataFrame:
    """One draw per cell decides between the changed and the original value; at 1 there is none to make."""
    if p_apply >= 1:
        return original.withColumn("x", changed)
    return original.withColumn("x", F.when(uniform(seed, "cell_id") < p_apply, changed).otherwise(F.col("x")))


def dropout(m: DataFrame, lo: float, hi: float, p_apply: float = 1.0, seed: int = 0) -> DataFrame:
    """0 with a probability drawn for each entry."""
    p = lo + (hi - lo) * uniform(seed + 1, "cell_id", "gene_id")
    return randomize(m, F.when(uniform(seed + 2, "cell_id", "gene_id") < p, 0.0).otherwise(F.col("x")), p_apply, seed)


def gaussian_noise(dense: DataFrame, lo: float, hi: float, p_apply: float = 1.0, seed: int = 0) -> DataFrame:
    """Noise of a deviation drawn for each entry, by two draws' polar form."""
    a, b = uniform(seed + 2, "cell_id", "gene_id"), uniform(seed + 3, "cell_id", "gene_id")
    normal = F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)
    return randomize(dense, F.col("x") + normal * (lo + (hi - lo) * uniform(seed + 1, "cell_id", "gene_id")), p_apply, seed)


def binomial_resample(m: DataFrame, lo: float, hi: float, p_apply: float = 1.0, seed: int = 0) -> DataFrame:
    """Binomial(x, p) with p drawn per entry."""
    p = lo + (hi - lo) * uniform(seed + 1, "cell_id", "gene_id")
    drawn = binomial(F.round("x"), p, uniform(seed + 2, "cell_id", "gene_id")).cast("double")
    return randomize(m, drawn, p_apply, seed)


def duplicate(m: DataFrame, enabled: bool = True) -> DataFrame:
    """All rows twice, `copy` 0 and 1."""
    return m.crossJoin(m.sparkSession.range(2 if enabled else 1).select(F.col("id").cast("int").alias("copy")))
