"""Rank and prompt tokens of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import position

FIRST_TOKEN = 2


def rank_tokens(m: DataFrame, most: int, genes: DataFrame | None = None) -> DataFrame:
    """cell_id, place (1-based), token, mask: genes by value descending, token = ordinal + 2, zeros become padding 0. `genes` maps gene_id to `ordinal`; absent entries are padding anyway."""
    if genes is not None:
        m = m.join(F.broadcast(genes.select("gene_id", "ordinal")), "gene_id")
    else:
        m = m.withColumn("ordinal", F.col("gene_id"))
    w = Window.partitionBy("cell_id").orderBy(F.desc("x"), "ordinal")
    out = m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return out.select("cell_id", "place", F.when(F.col("x") > 0, F.col("ordinal") + FIRST_TOKEN).otherwise(0).alias("token"), (F.col("x") > 0).cast("int").alias("mask"))


def perturb(m: DataFrame, deletion: list[int] = (), activation: list[int] = ()) -> DataFrame:
    """Deleted genes go to 0; activated ones rise above the dataset's maximum, the first listed highest."""
    out = m
    if deletion:
        out = out.withColumn("x", F.when(F.col("gene_id").isin(list(deletion)), 0.0).otherwise(F.col("x")))
    if activation:
        top = F.broadcast(out.agg(F.max("x").alias("top")))
        ups = out.sparkSession.createDataFrame([(g, float(len(activation) - k)) for k, g in enumerate(activation)], "gene_id long, up double")
        raised = out.select("cell_id").distinct().crossJoin(F.broadcast(ups)).crossJoin(top).select("cell_id", "gene_id", (F.col("top") + F.col("up")).alias("x"))
        out = out.where(~F.col("gene_id").isin(list(activation))).select("cell_id", "gene_id", "x").unionByName(raised.select("cell_id", F.col("gene_id").cast(out.schema["gene_id"].dataType), "x"))
    return out


def replace_tokens(tokens: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """token := mapping's value, after the sort."""
    side = tokens.sparkSession.createDataFrame(list(mapping.items()), "token long, new long")
    return tokens.withColumn("token", F.col("token").cast("long")).join(F.broadcast(side), "token", "left").withColumn("token", F.coalesce("new", "token")).drop("new")


def shuffled_context(m: DataFrame, most: int, seed: int) -> DataFrame:
    """A cell's genes in a seeded order, cut to `most`; `place` from 1."""
    w = Window.partitionBy("cell_id").orderBy(position(F.lit(seed), "cell_id", "gene_id"))
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def prompt_query(ctx: DataFrame, prefix: int) -> DataFrame:
    """is_prompt for the first `prefix` places, is_query for the rest; weights share one over a cell's queries."""
    q = (F.col("place") > prefix).cast("int")
    n = F.sum("is_query").over(Window.partitionBy("cell_id"))
    return ctx.withColumns({"is_prompt": 1 - q, "is_query": q}).withColumn("weight", F.col("is_query") / F.greatest(n, F.lit(1)))


def values_labels(ctx: DataFrame, vocabulary: int) -> DataFrame:
    """value = log1p(x) for prompts else 0, label = x clamped to the vocabulary."""
    return ctx.withColumns({"value": F.log1p("x") * F.col("is_prompt"), "label": F.least(F.greatest(F.col("x"), F.lit(0.0)), F.lit(float(vocabulary - 1))).cast("long")})


def metadata_codes(cells: DataFrame, column: str, names: list[str], masked=None) -> DataFrame:
    """code by the list of names (-1: not measured), token: the code clamped to 0, or the list's size where masked."""
    side = cells.sparkSession.createDataFrame(list(enumerate(names)), f"code int, {column} string")
    out = cells.join(F.broadcast(side), column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))
    token = F.greatest(F.col("code"), F.lit(0))
    return out.withColumn("token", token if masked is None else F.when(masked, len(names)).otherwise(token))


def downsample_predict(m: DataFrame, most_total: float) -> DataFrame:
    """x * p rounded half to even, p = min(total, most) / total."""
    total = F.sum("x").over(Window.partitionBy("cell_id"))
    return m.withColumn("x", F.bround(F.col("x") * F.least(total, F.lit(most_total)) / total))


def attention_mask(ctx: DataFrame) -> DataFrame:
    """Pairs of places that may attend: to prompts, and to oneself."""
    a, b = ctx.select("cell_id", F.col("place").alias("i")), ctx.select("cell_id", F.col("place").alias("j"), "is_prompt")
    return a.join(b, "cell_id").withColumn("attends", ((F.col("is_prompt") == 1) | (F.col("i") == F.col("j"))).cast("int")).drop("is_prompt")
