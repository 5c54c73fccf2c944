"""Projections by field, nested batches, and rows checked on the way."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column, or a key of a struct or map column, and what is done to it."""

    attr: str
    key: str | None = None
    convert: Callable[[Column], Column] | None = None

    def column(self) -> Column:
        c = F.col(self.attr) if self.key is None else F.col(self.attr)[self.key]
        return self.convert(c) if self.convert else c


def compose(*steps: Callable) -> Callable:
    """x -> steps[-1](... steps[0](x)): for converters of columns and for transforms of tables alike."""

    def run(x):
        for s in steps:
            x = s(x)
        return x

    return run


def batch(df: DataFrame, keys: dict, *keep: str) -> DataFrame:
    """keep and one column a key; a dict of fields becomes a struct."""

    def column(name: str, f) -> Column:
        return (F.struct(*[column(n, g) for n, g in f.items()]) if isinstance(f, dict) else f.column()).alias(name)

    return df.select(*keep, *[column(n, f) for n, f in keys.items()])


def nest(tree: dict, key: str = "row") -> DataFrame:
    """key and one column a branch of a nested dict whose leaves are tables (key, value): inner dicts become structs.

    All leaves must have the same number of rows, one a key; a leaf that lacks another's key is an error as well.
    """
    leaves: list[DataFrame] = []

    def column(node) -> Column:
        if isinstance(node, dict):
            return F.struct(*[column(v).alias(k) for k, v in node.items()])
        leaves.append(node)
        return F.col(f"__v{len(leaves) - 1}")

    columns = {k: column(v) for k, v in tree.items()}
    sizes = [d.agg(F.count(F.lit(1)), F.count_distinct(key)).first() for d in leaves]
    if len({n for n, _ in sizes}) > 1 or any(n != own for n, own in sizes):
        raise ValueError(f"leaves have other numbers of rows or repeated keys: {[tuple(s) for s in sizes]}")
    out = leaves[0].select(key, F.col("value").alias("__v0"))
    for k, leaf in enumerate(leaves[1:], 1):
        out = out.join(leaf.select(key, F.col("value").alias(f"__v{k}")), key)
    if len(leaves) > 1 and out.count() != sizes[0][0]:
        raise ValueError("leaves have other keys")
    return out.select(key, *[c.alias(n) for n, c in columns.items()])


def collate(parts: list[DataFrame], constant: list[str] = ()) -> DataFrame:
    """Parts under each other; they must have the same columns, and one value in each constant one."""
    if not parts:
        raise ValueError("there is nothing to collate")
    for p in parts[1:]:
        if p.columns != parts[0].columns:
            raise ValueError(f"columns {p.columns} are not {parts[0].columns}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    for c in constant:
        if out.select(c).distinct().limit(2).count() > 1:
            raise ValueError(f"{c} differs between the parts")
    return out


def numeric(df: DataFrame) -> DataFrame:
    """Numbers and booleans become double; text and nested columns stay."""
    plain = {"tinyint", "smallint", "int", "bigint", "float", "boolean"}
    return df.select(*[F.col(n).cast("double").alias(n) if t in plain or t.startswith("decimal") else F.col(n) for n, t in df.dtypes])


def required(value: Column, ok: Column, message: str) -> Column:
    """value where ok holds; the job fails where it does not."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def lint(transforms: Column) -> Column:
    """What is wrong with an order of transforms (an array of names) on a sparse matrix, in that order."""
    dense, early = ["z_score", "center_per_cell", "pflogpf", "gaussian_noise"], ["filter_genes", "duplicate"]

    def message(t: Column, k: Column) -> Column:
        before = F.array_contains(F.slice(transforms, F.lit(1), k), "densify")
        at = F.concat(t, F.lit(" at "), k.cast("string"))
        return (
            F.when((t == "densify") & before, F.concat(F.lit("warning: "), at, F.lit(" does nothing, the matrix is dense")))
            .when(t.isin(dense) & ~before, F.concat(F.lit("error: "), at, F.lit(" needs densify before it")))
            .when(t.isin(early) & before, F.concat(F.lit("warning: "), at, F.lit(" is cheaper before densify")))
        )

    return F.filter(F.transform(transforms, message), lambda m: m.isNotNull())
