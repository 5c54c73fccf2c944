"""Categorical columns as codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def categories(df: DataFrame, *columns: str) -> DataFrame:
    """column, category, code: 0-based in lexical order."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")).where(F.col(c).isNotNull()).distinct() for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("category")) - 1)


def add_codes(df: DataFrame, cats: DataFrame, column: str) -> DataFrame:
    """df with <column>_code; -1 for missing or unlisted values."""
    side = F.broadcast(cats.where(F.col("column") == column).select(F.col("category").alias(column), F.col("code").alias(f"{column}_code")))
    return df.join(side, column, "left").withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1)))


def product_code(df: DataFrame, cats: DataFrame, columns: list[str], name: str = "code") -> DataFrame:
    """Mixed-radix code of columns' codes, the first fastest; radices are the listed category counts, not the seen ones. Null if any code is missing."""
    sizes = {r["column"]: r["n"] for r in cats.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in columns:
        df = add_codes(df, cats, c)
    radix, total = 1, F.lit(0)
    for c in columns:
        total = total + F.when(F.col(f"{c}_code") >= 0, F.col(f"{c}_code")) * radix
        radix *= sizes[c]
    return df.withColumn(name, total)


def combinations(cats: DataFrame, columns: list[str]) -> DataFrame:
    """All combinations with their product codes: small category tables only."""
    out = None
    for c in columns:
        side = cats.where(F.col("column") == c).select(F.col("category").alias(c))
        out = side if out is None else out.crossJoin(side)
    return product_code(out, cats, columns).select(*columns, "code")


def one_hot(df: DataFrame, cats: DataFrame, column: str) -> DataFrame:
    """One row a category: `category`, `hot` 0 or 1."""
    side = F.broadcast(cats.where(F.col("column") == column).select("category", "code"))
    return df.crossJoin(side).withColumn("hot", F.coalesce((F.col(column) == F.col("category")).cast("int"), F.lit(0)))
