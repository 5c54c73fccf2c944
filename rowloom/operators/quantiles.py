"""Quantiles as model state: one mergeable sketch a gene, made, merged, stored and asked in the JVM.

A sketch of size k answers a quantile with a rank that is off by `rank_error(k)` of the values at most
(with 99 % probability for one question), however many batches, files or streams were merged. Up to k values are kept as they are,
so small columns are exact. State is a table (gene_id, sketch), so it is saved, loaded and merged like any
other; merging is a grouped aggregate with partial sums on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: some 20 KB a gene when full.
SIZE = 1_600


def rank_error(k: int = SIZE) -> float:
    """How far a quantile's rank may be off, as a share of the values: the published fit for sketches of this kind."""
    return 2.296 / k**0.9723


def sketches(m: DataFrame, key: str = "gene_id", value: str = "x", k: int = SIZE) -> DataFrame:
    """key, sketch over the values other than 0, null and NaN; keys without any are left out."""
    x = F.col(value).cast("double")
    return m.where((x != 0) & ~F.isnan(x)).groupBy(key).agg(F.expr(f"kll_sketch_agg_double(CAST(`{value}` AS DOUBLE), {k})").alias("sketch"))


def merged(state: DataFrame, key: str = "gene_id", k: int = SIZE) -> DataFrame:
    """One sketch a key from any number of them."""
    return state.groupBy(key).agg(F.expr(f"kll_merge_agg_double(sketch, {k})").alias("sketch"))


def count(sketch: Column) -> Column:
    return F.call_function("kll_sketch_get_n_double", sketch)


def quantile(sketch: Column, q: float) -> Column:
    """The value whose rank is q; a value that was met."""
    return F.call_function("kll_sketch_get_quantile_double", sketch, F.lit(float(q)))


def rank(sketch: Column, value: Column) -> Column:
    """The share of values up to `value`."""
    return F.call_function("kll_sketch_get_rank_double", sketch, value)


def quantiles(state: DataFrame, qs: list[float], key: str = "gene_id", k: int = SIZE) -> DataFrame:
    """key, n, q, value, and low and high: what the quantile lies between with the sketch's error."""
    e = rank_error(k)
    at = [F.struct(F.lit(float(q)).alias("q"), quantile(F.col("sketch"), q).alias("value"), quantile(F.col("sketch"), max(0.0, q - e)).alias("low"), quantile(F.col("sketch"), min(1.0, q + e)).alias("high")) for q in qs]
    return state.select(key, count(F.col("sketch")).alias("n"), F.explode(F.array(*at)).alias("at")).select(key, "n", "at.*")


def held_rank(m: DataFrame, found: DataFrame, key: str = "gene_id", value: str = "x") -> DataFrame:
    """found(key, q, value, ...) with `least` and `most`: the shares of the key's values below and up to the found one, counted exactly."""
    f = found.select(key, "q", F.col("value").alias("__at"))
    beside = m.where(F.col(value) != 0).select(key, F.col(value).cast("double").alias("__x")).join(f, key)
    share = lambda c: F.avg(c.cast("double"))
    exact = beside.groupBy(key, "q").agg(share(F.col("__x") < F.col("__at")).alias("least"), share(F.col("__x") <= F.col("__at")).alias("most"))
    return found.join(exact, [key, "q"])
