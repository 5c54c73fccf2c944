"""Prompts, masks and labels for models over genes and metadata. All draws are hashes of the cell, so they repeat anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import binomial, log_gamma, negative_binomial
from .transforms import uniform

MASK_TOKEN, FIRST_GENE_TOKEN, NO_LABEL = 1, 2, -100


def mlm_mask(tokens: DataFrame, vocabulary: int, share: float = 0.15, seed: int = 0) -> DataFrame:
    """tokens(cell_id, place, token, mask): a share of the real tokens is selected; of these 80 % become the mask, half of the rest random tokens. `label` is the token where selected."""
    pick, how, what = (uniform(seed + k, "cell_id", "place") for k in range(3))
    chosen = (F.col("mask") == 1) & (pick < share)
    random = (F.lit(FIRST_GENE_TOKEN) + F.floor(what * (vocabulary - FIRST_GENE_TOKEN))).cast("long")
    token = F.when(chosen & (how < 0.8), F.lit(MASK_TOKEN).cast("long")).when(chosen & (how < 0.9), random).otherwise(F.col("token"))
    return tokens.withColumns({"label": F.when(chosen, F.col("token")).otherwise(F.lit(NO_LABEL)).cast("long"), "masked": token})


def library_target(m: DataFrame, least: float, most: float, fraction: float, seed: int = 0) -> DataFrame:
    """cell_id, total, target, p: target lies between least and min(total, most) at min(draw / fraction, 1), p = target / total."""
    t = m.groupBy("cell_id").agg(F.sum("x").alias("total"))
    at = F.least(uniform(seed, "cell_id") / fraction, F.lit(1.0))
    top = F.least("total", F.lit(most))
    low = F.least(F.lit(least), top)
    return t.withColumn("target", F.bround(low + (top - low) * at)).withColumn("p", F.col("target") / F.col("total"))


def downsample(m: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Binomial counts at each cell's p."""
    return m.join(targets.select("cell_id", "p"), "cell_id").withColumn("x", binomial(F.round("x"), F.col("p"), uniform(seed, "cell_id", "gene_id")).cast("double")).drop("p")


def prefix_lengths(most: int, zero: float = 0.1) -> list[tuple[int, float]]:
    """(length, cumulative share) with weights 1 / length, and `zero` for none."""
    w = [zero] + [1.0 / k for k in range(1, most + 1)]
    out, total = [], 0.0
    for k, x in enumerate(w):
        total += x
        out.append((k, total / sum(w)))
    return out


def sampled_prefix(cells: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """cell_id, prefix: the least length whose cumulative share exceeds the cell's draw."""
    table = prefix_lengths(most)
    u = uniform(seed, "cell_id")
    n = sum((F.when(u >= F.lit(c), 1).otherwise(0) for _, c in table), F.lit(0))
    return cells.select("cell_id", F.least(n, F.lit(most)).cast("int").alias("prefix"))


def split_by_prefix(ctx: DataFrame, prefixes: DataFrame) -> DataFrame:
    """is_prompt, is_query and label weight 1 / (queries of the cell) by each cell's own prefix."""
    out = ctx.join(prefixes, "cell_id").withColumn("is_query", (F.col("place") > F.col("prefix")).cast("int"))
    n = F.sum("is_query").over(Window.partitionBy("cell_id"))
    return out.withColumns({"is_prompt": 1 - F.col("is_query"), "weight": F.col("is_query") / F.greatest(n, F.lit(1))})


def metadata_prompt(cells: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """cell_id, field, is_prompt: of each cell's fields in an order of its own as many as it drew are prompts, from none to all."""
    long = cells.select("cell_id", F.explode(F.array(*map(F.lit, columns))).alias("field"))
    place = F.row_number().over(Window.partitionBy("cell_id").orderBy(uniform(seed, "cell_id", "field"), "field"))
    drawn = F.floor(uniform(seed + 1, "cell_id") * (len(columns) + 1))
    return long.withColumn("is_prompt", (place <= drawn).cast("int"))


def ontology_resample(cells: DataFrame, clo: DataFrame, term: str, p: float, seed: int = 0) -> DataFrame:
    """cell_id, term: an ancestor or the term itself with weight p (1 - p)^dist, by the largest of log weight and a Gumbel draw."""
    up = cells.select("cell_id", F.col(term).alias("descendant")).join(clo, "descendant")
    u = F.greatest(uniform(seed, "cell_id", "ancestor"), F.lit(1e-10))
    score = F.log(F.lit(p)) + F.col("dist") * F.log(F.lit(1 - p)) - F.log(-F.log(u))
    return up.groupBy("cell_id").agg(F.max_by("ancestor", F.struct(score.alias("s"), "ancestor")).alias("term"))


def test_tokens(ctx: DataFrame, prefix: int, p: float) -> DataFrame:
    """Queries first, then prompts; prompts alone are downsampled (x p rounded half to even). Each row has both sizes."""
    w = Window.partitionBy("cell_id")
    out = ctx.withColumn("is_prompt", (F.col("place") <= prefix).cast("int"))
    out = out.withColumn("value", F.when(F.col("is_prompt") == 1, F.bround(F.col("x") * p)).otherwise(0.0))
    out = out.withColumns({"prompt_size": F.sum("is_prompt").over(w), "query_size": F.sum(1 - F.col("is_prompt")).over(w)})
    return out.withColumn("at", F.row_number().over(w.orderBy("is_prompt", "place")))


def generate_tokens(ctx: DataFrame) -> DataFrame:
    """Every gene twice: as a query, then as a prompt with its value."""
    roles = F.explode(F.array(F.struct(F.lit(0).alias("is_prompt"), F.lit(0.0).alias("value")), F.struct(F.lit(1).alias("is_prompt"), F.log1p("x").alias("value"))))
    out = ctx.select("cell_id", "gene_id", "place", roles.alias("r")).select("cell_id", "gene_id", "place", "r.*")
    return out.withColumn("at", F.row_number().over(Window.partitionBy("cell_id").orderBy("is_prompt", "place")))


def nb_sample(mu: Column, theta: Column, u: Column) -> Column:
    """The least k whose cumulative negative binomial probability reaches u, whatever its size."""
    return negative_binomial(mu, theta, u)


def nb_log_prob(x: Column, mu: Column, theta: Column) -> Column:
    """lgamma(x + theta) - lgamma(theta) - lgamma(x + 1) + theta log(theta / (theta + mu)) + x log(mu / (theta + mu))."""
    rising = log_gamma(x + theta) - log_gamma(theta) - log_gamma(x + 1)
    return rising + theta * F.log(theta / (theta + mu)) + F.when(x > 0, x * F.log(mu / (theta + mu))).otherwise(0.0)


def metadata_tokens(cells: DataFrame, vocabularies: dict[str, list[str]], prompts: DataFrame | list[str] | None = None, resampled: DataFrame | None = None, predict: bool = False) -> DataFrame:
    """cell_id, field, is_prompt, is_query, token, label, weight: a token for each field of each cell, in the fields' order as `slot`.

    A name that its vocabulary lacks is not measured: neither prompt nor query. `prompts` says which measured fields are prompts, by name or
    as rows (cell_id, field, is_prompt); the other measured ones are queries, whose token is the mask, the vocabulary's size. `resampled`
    (cell_id, field, name) gives prompts a coarser name; labels keep their own. To predict, measured fields are prompts and the rest queries.
    """
    spark = cells.sparkSession
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(f).alias("field"), F.lit(len(v)).alias("size"), F.col(f).cast("string").alias("name")) for k, (f, v) in enumerate(vocabularies.items())]))
    long = cells.select("cell_id", named.alias("m")).select("cell_id", "m.*")
    codes = F.broadcast(spark.createDataFrame([(f, n, k) for f, v in vocabularies.items() for k, n in enumerate(v)], "field string, name string, code int"))
    long = long.join(codes, ["field", "name"], "left")
    if isinstance(prompts, DataFrame):
        long = long.join(prompts.select("cell_id", "field", (F.col("is_prompt") == 1).alias("asked")), ["cell_id", "field"], "left")
    else:
        long = long.withColumn("asked", F.col("field").isin(list(prompts)) if prompts else F.lit(False))
    measured, asked = F.col("code").isNotNull(), F.coalesce("asked", F.lit(False))
    is_prompt, is_query = (measured, ~measured) if predict else (measured & asked, measured & ~asked)
    own = F.col("code")
    if resampled is not None:
        coarser = resampled.join(codes, ["field", "name"]).select("cell_id", "field", F.col("code").alias("coarser"))
        long = long.join(coarser, ["cell_id", "field"], "left")
        own = F.coalesce("coarser", "code")
    token = F.when(is_query, F.col("size")).otherwise(F.coalesce(own, F.lit(0)))
    return long.select("cell_id", "slot", "field", is_prompt.cast("int").alias("is_prompt"), is_query.cast("int").alias("is_query"), token.cast("int").alias("token"), F.coalesce("code", F.lit(0)).cast("long").alias("label"), is_query.cast("double").alias("weight"))


def measured_only(split: DataFrame, measured: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """Genes that the cell's `by` does not measure, as measured(by, gene_id) says, are neither prompt nor query; weights share one over what is left."""
    hit = split.join(cells.select("cell_id", by), "cell_id").join(F.broadcast(measured.select(by, "gene_id", F.lit(1).alias("known"))), [by, "gene_id"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    out = hit.withColumns({"is_prompt": F.col("is_prompt") * F.col("known"), "is_query": F.col("is_query") * F.col("known")}).drop("known", by)
    n = F.sum("is_query").over(Window.partitionBy("cell_id"))
    return out.withColumn("weight", F.col("is_query") / F.greatest(n, F.lit(1)))


def context(genes: DataFrame, metadata: DataFrame, n_genes: int) -> DataFrame:
    """One row a token: genes(cell_id, at from 0, gene_id, value, is_prompt, is_query, label, weight), then the cell's metadata at n_genes and after.

    A gene has a value and no token, metadata a token and no value; places of genes that a cell lacks stay empty.
    """
    g = genes.select("cell_id", "at", F.lit("gene_value").alias("field"), "gene_id", "value", F.lit(None).cast("int").alias("token"), "is_prompt", "is_query", "label", "weight")
    m = metadata.select("cell_id", (F.col("slot") + n_genes).cast("int").alias("at"), "field", F.lit(None).cast("long").alias("gene_id"), F.lit(0.0).alias("value"), "token", "is_prompt", "is_query", "label", "weight")
    return g.unionByName(m)


def attends(tokens: DataFrame) -> DataFrame:
    """cell_id, at, keys: the places that each token may attend to, its own and the prompts', one row a token; keys are as many as the context at most."""
    prompts = tokens.where("is_prompt = 1").groupBy("cell_id").agg(F.sort_array(F.collect_list("at")).alias("prompts"))
    out = tokens.select("cell_id", "at").join(prompts, "cell_id", "left")
    return out.select("cell_id", "at", F.sort_array(F.array_union(F.coalesce("prompts", F.array().cast("array<int>")), F.array(F.col("at").cast("int")))).alias("keys"))
