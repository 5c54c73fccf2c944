"""Queries by name with the SQL they must equal. Each takes (spark, folder of the driver's tables)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.columns import r6
from ..operators import categories as cat
from ..operators import estimators, evaluate, hvg, lowrank, ontology, quantiles, sampling, stats, tokens
from ..operators import transforms as tr
from ..sources import shards, shared, sinks, virtual
from ..sources.virtual import table
from ..streaming import running

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_CELLS = "cells AS (SELECT o_orderkey AS cell_id, o_orderpriority AS batch, o_orderstatus AS assay, c_mktsegment AS cell_type, n_name AS tissue, o_totalprice AS library FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_GENES = "genes AS (SELECT s_suppkey AS gene_id, s_name AS var_name, s_acctbal AS scale FROM supplier)"
_MATRIX = "matrix AS (SELECT l_orderkey AS cell_id, l_suppkey AS gene_id, SUM(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"
_NORM = "norm AS (SELECT cell_id, gene_id, ln(1 + x * 10000.0 / (SUM(x) OVER (PARTITION BY cell_id) + 1e-6)) AS x FROM matrix)"
_EDGES = "edges AS (SELECT 'ALL' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
_CLO = "walk AS (SELECT DISTINCT t AS ancestor, t AS descendant, 0 AS dist FROM (SELECT parent AS t FROM edges UNION ALL SELECT child FROM edges) UNION ALL SELECT ancestor, child, dist + 1 FROM walk JOIN edges ON descendant = parent), clo AS (SELECT ancestor, descendant, MIN(dist) AS dist FROM walk GROUP BY 1, 2)"
_ONEPASS = "n AS (SELECT COUNT(*) AS n FROM cells), onepass AS (SELECT gene_id, n, SUM(x) / n AS mean, SUM(x * x) / n - (SUM(x) / n) * (SUM(x) / n) AS var FROM {m}, n GROUP BY gene_id, n)"


def query(sql: str | None = None, **parts):
    """Register a query; `sql` gets the common table expressions that it names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}"


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return tr.log1p(tr.normalize_total(virtual.matrix(spark, d)))


def _moments(spark: SparkSession, d: str) -> DataFrame:
    return stats.onepass(_norm(spark, d), virtual.cells(spark, d)).select("gene_id", "mean", "var")


# statistics ---------------------------------------------------------------------------------------


@query(_with(_CELLS, _MATRIX, _NORM, _ONEPASS.format(m="norm"), select="SELECT gene_id, n, round(mean, 6) AS mean, round(var, 6) AS var, round(sqrt(greatest(var, 0)), 6) AS std FROM onepass"))
def onepass_mean_var_std(spark, d):
    o = stats.onepass(_norm(spark, d), virtual.cells(spark, d))
    return o.select("gene_id", "n", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"), r6(F.col("std")).alias("std"))


@query(_with(_CELLS, _MATRIX, _ONEPASS.format(m="matrix"), select="SELECT gene_id, n, round(mean, 6) AS mean, round(var, 6) AS var FROM onepass"))
def onepass_shifted(spark, d):
    m, c = virtual.matrix(spark, d), virtual.cells(spark, d)
    shift = m.groupBy("gene_id").agg(F.avg("x").alias("shift"))
    o = stats.onepass(m, c, shift)
    return o.select("gene_id", "n", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))


@query(_with(_CELLS, _MATRIX, "b AS (SELECT batch, COUNT(*) AS n FROM cells GROUP BY 1)", select="SELECT batch, gene_id, n, round(SUM(x) / n, 6) AS mean, round(SUM(x * x) / n - (SUM(x) / n) * (SUM(x) / n), 6) AS var FROM matrix JOIN cells USING (cell_id) JOIN b USING (batch) GROUP BY batch, gene_id, n"))
def onepass_by_batch(spark, d):
    o = stats.onepass_by_batch(virtual.matrix(spark, d), virtual.cells(spark, d))
    return o.select("batch", "gene_id", "n", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))


@query(_with(_MATRIX, select="SELECT gene_id, round(median(x), 6) AS median FROM matrix WHERE x <> 0 GROUP BY 1"))
def nonzero_median(spark, d):
    return stats.nonzero_median(virtual.matrix(spark, d)).select("gene_id", r6(F.col("median")).alias("median"))


@query()
def nonzero_quantile_sketch(spark, d):
    return stats.nonzero_quantile_sketch(virtual.matrix(spark, d))


_QS = [0.25, 0.5, 0.9]


def _within(m: DataFrame, state: DataFrame) -> DataFrame:
    """gene_id, n, q, within: whether the sketch's quantile has its rank in the column but for the error that it states."""
    e = quantiles.rank_error()
    held = quantiles.held_rank(m, quantiles.quantiles(state, _QS))
    return held.select("gene_id", "n", "q", ((F.col("least") <= F.col("q") + e) & (F.col("most") >= F.col("q") - e) & (F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high"))).alias("within"))


@query(_with(_MATRIX, _NORM, select="SELECT gene_id, COUNT(*) AS n, CAST(q AS DOUBLE) AS q, TRUE AS within FROM norm CROSS JOIN (VALUES (0.25), (0.5), (0.9)) v(q) WHERE x <> 0 GROUP BY gene_id, q"))
def quantile_states_merged(spark, d):
    """Sketches of four shards, each saved apart and loaded again, give the quantiles of all cells."""
    folder = shared.new_folder(spark, "sketches")
    _norm(spark, d).write.parquet(f"{folder}/values")
    m = spark.read.parquet(f"{folder}/values")
    for k in range(4):
        sinks.save_state(quantiles.sketches(m.where(F.pmod("cell_id", F.lit(4)) == k)), f"{folder}/shard={k}", size=quantiles.SIZE)
    parts = [sinks.load_state(spark, f"{folder}/shard={k}")[0] for k in range(4)]
    return _within(m, quantiles.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])))


@query("SELECT l_suppkey AS gene_id, COUNT(*) AS n, CAST(q AS DOUBLE) AS q, TRUE AS within FROM lineitem CROSS JOIN (VALUES (0.25), (0.5), (0.9)) v(q) WHERE l_extendedprice <> 0 GROUP BY l_suppkey, q")
def stream_quantile_states(spark, d):
    """Sketches as the state of a stream over the table's files."""
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    state = running.running_quantiles(spark, f"{d}/lineitem.parquet*", schema, "l_suppkey", "l_extendedprice")
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gene_id"), F.col("l_extendedprice").alias("x"))
    return _within(m, state.withColumnRenamed("l_suppkey", "gene_id"))


@query("WITH e AS (SELECT vec_id, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(SUM(a.v * b.v), 5) AS sum_ij FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2")
def covariance_gram(spark, d):
    g = stats.gram(table(spark, d, "embeddings"))
    return g.select("i", "j", F.round("sum_ij", 5).alias("sum_ij"))


def _fitted(spark: SparkSession, d: str, k: int = 5) -> tuple[DataFrame, lowrank.Fit]:
    """The cells as sparse rows, and their truncated decomposition."""
    m, cells = _norm(spark, d), virtual.cells(spark, d)
    genes = lowrank.vocabulary(m)
    rows = lowrank.sparse_rows(m, genes, cells)
    return rows, lowrank.fit(rows, genes, cells.count(), k)


@query()
def incremental_pca(spark, d):
    """Loadings of the cell x gene matrix' components, without its Gram matrix."""
    f = _fitted(spark, d)[1]
    return spark.createDataFrame([(k + 1, g, float(v)) for k, c in enumerate(f.components) for g, v in zip(f.genes, c, strict=True)], "pc int, gene_id long, loading double")


@query()
def pca_explained_variance(spark, d):
    f = _fitted(spark, d)[1]
    return spark.createDataFrame([(k + 1, float(v), float(v / f.total)) for k, v in enumerate(f.explained)], "pc int, variance double, ratio double")


@query()
def pca_embed(spark, d):
    rows, f = _fitted(spark, d)
    return lowrank.project(rows, f)


@query()
def ppca_closed_form(spark, d):
    """sigma^2 is the mean of the variances left out, from the total."""
    f = _fitted(spark, d)[1]
    return spark.createDataFrame([(k + 1, float(v), f.noise, float((v - f.noise) / f.total)) for k, v in enumerate(f.explained)], "pc int, eigenvalue double, sigma2 double, share double")


@query(_with(_CELLS, _MATRIX, _NORM, "n AS (SELECT COUNT(*) AS n FROM cells)", "v AS (SELECT SUM(s2 - s * s / n) / any_value(n) AS total FROM (SELECT gene_id, SUM(x) AS s, SUM(x * x) AS s2 FROM norm GROUP BY 1), n)", select="SELECT CAST(pc AS INTEGER) AS pc, n AS cells, round(total, 6) AS total, TRUE AS centred, TRUE AS orthogonal, TRUE AS variance_is_eigenvalue FROM n, v, range(1, 6) r(pc)"))
def pca_properties(spark, d):
    """What makes a decomposition one, measured on every cell's coordinates: mean 0, no covariance with the others, variance equal to the eigenvalue."""
    rows, f = _fitted(spark, d)
    p = lowrank.project(rows, f).groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("pc", "value"))).alias("p")).select(F.transform("p", lambda x: x["value"]).alias("p"))
    ks = range(len(f.explained))
    sums = p.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("p")[i]).alias(f"s{i}") for i in ks], *[F.sum(F.col("p")[i] * F.col("p")[j]).alias(f"s{i}_{j}") for i in ks for j in ks if i <= j]).first()
    out = []
    for i in ks:
        v = float(f.explained[i])
        others = max(abs(sums[f"s{min(i, j)}_{max(i, j)}"]) / f.n for j in ks if j != i)
        out.append((i + 1, f.n, round(f.total, 6), abs(sums[f"s{i}"]) / f.n < 1e-6, others < 1e-6 * float(f.explained[0]), abs(sums[f"s{i}_{i}"] / f.n - v) < 1e-6 * v))
    return spark.createDataFrame(out, "pc int, cells long, total double, centred boolean, orthogonal boolean, variance_is_eigenvalue boolean")


# transforms ---------------------------------------------------------------------------------------


@query(_with(_MATRIX, select="SELECT cell_id, gene_id, round(x * 10000.0 / (SUM(x) OVER (PARTITION BY cell_id) + 1e-6), 6) AS x FROM matrix"))
def normalize_total(spark, d):
    return tr.normalize_total(virtual.matrix(spark, d)).select("cell_id", "gene_id", r6(F.col("x")).alias("x"))


@query(_with(_MATRIX, select="SELECT cell_id, gene_id, round(ln(1 + x), 6) AS x FROM matrix"))
def log1p(spark, d):
    return tr.log1p(virtual.matrix(spark, d)).select("cell_id", "gene_id", r6(F.col("x")).alias("x"))


@query(_with(_CELLS, _MATRIX, _ONEPASS.format(m="matrix"), select="SELECT cell_id, gene_id, round((x - mean) / (sqrt(greatest(var, 0)) + 1e-6), 6) AS x FROM matrix JOIN onepass USING (gene_id) UNION ALL SELECT NULL, gene_id, round(-mean / (sqrt(greatest(var, 0)) + 1e-6), 6) FROM onepass"))
def zscore(spark, d):
    m = virtual.matrix(spark, d)
    return tr.z_score(m, stats.onepass(m, virtual.cells(spark, d))).select("cell_id", "gene_id", r6(F.col("x")).alias("x"))


@query(_with(_MATRIX, "s AS (SELECT gene_id, CASE WHEN gene_id % 7 = 0 THEN 1e6 ELSE median(x) END AS scale FROM matrix GROUP BY 1)", select="SELECT cell_id, gene_id, round(x / (scale + 1e-6), 9) AS x FROM matrix JOIN s USING (gene_id)"))
def divide_by_scale(spark, d):
    m = virtual.matrix(spark, d)
    scale = stats.nonzero_median(m).select("gene_id", F.when(F.col("gene_id") % 7 != 0, F.col("median")).alias("scale"))
    return tr.divide_by_scale(m, scale).select("cell_id", "gene_id", F.round("x", 9).alias("x"))


_CENTER = "c AS (SELECT *, SUM(x) OVER (PARTITION BY cell_id) / (SELECT COUNT(*) FROM genes) AS mean FROM {m}) SELECT cell_id, gene_id, round(x - mean, 6) AS x FROM c UNION ALL SELECT DISTINCT cell_id, NULL, round(-mean, 6) FROM c"


@query(_with(_GENES, _MATRIX, select="").rstrip() + ", " + _CENTER.format(m="matrix"))
def center_per_cell(spark, d):
    return tr.center_per_cell(virtual.matrix(spark, d), virtual.genes(spark, d).count()).select("cell_id", "gene_id", r6(F.col("x")).alias("x"))


@query(_with(_GENES, _MATRIX, "p AS (SELECT cell_id, gene_id, ln(1 + x / (SUM(x) OVER (PARTITION BY cell_id) + 1e-6)) AS x FROM matrix)", select="").rstrip() + ", " + _CENTER.format(m="p"))
def pflogpf(spark, d):
    return tr.pflogpf(virtual.matrix(spark, d), virtual.genes(spark, d).count()).select("cell_id", "gene_id", r6(F.col("x")).alias("x"))


_WANTED = ["Supplier#000000005", "Supplier#000000002", "Supplier#000000009"]


def _wanted(spark, d):
    names = [r[0] for r in virtual.genes(spark, d).where("gene_id in (9, 2, 5)").orderBy(F.desc("gene_id")).select("var_name").collect()]
    return names


@query(_with(_MATRIX, _GENES, select="SELECT cell_id, CASE gene_id WHEN 9 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS pos, var_name, x FROM matrix JOIN genes USING (gene_id) WHERE gene_id IN (9, 2, 5)"))
def filter_ordered(spark, d):
    return tr.filter_genes(virtual.matrix(spark, d), virtual.genes(spark, d), _wanted(spark, d))


@query(_with(_MATRIX, _GENES, select="SELECT cell_id, CASE gene_id WHEN 2 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS pos, var_name, x FROM matrix JOIN genes USING (gene_id) WHERE gene_id IN (9, 2, 5)"))
def filter_unordered(spark, d):
    return tr.filter_genes(virtual.matrix(spark, d), virtual.genes(spark, d), [*_wanted(spark, d), "no such gene"], ordering=False)


@query(_with(_CELLS, _MATRIX, _GENES, select="SELECT cell_id, CASE gene_id WHEN 9 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS pos, var_name, x FROM matrix JOIN genes USING (gene_id) WHERE gene_id IN (9, 2, 5) UNION ALL SELECT cell_id, 3, 'no such gene', 0.0 FROM cells"))
def filter_allow_missing(spark, d):
    return tr.filter_genes(virtual.matrix(spark, d), virtual.genes(spark, d), [*_wanted(spark, d), "no such gene"], allow_missing=True, cells=virtual.cells(spark, d))


@query("SELECT v.name FROM (VALUES ('no such gene'), ('nor this')) v(name) WHERE v.name NOT IN (SELECT s_name FROM supplier)")
def filter_missing_check(spark, d):
    names = spark.createDataFrame([("no such gene",), ("nor this",)], "name string").unionByName(virtual.genes(spark, d).select(F.col("var_name").alias("name")))
    return names.join(virtual.genes(spark, d), F.col("name") == F.col("var_name"), "left_anti")


@query(_with(_MATRIX, select="SELECT cell_id, gene_id, x, CAST(copy AS INTEGER) AS copy FROM matrix CROSS JOIN range(2) r(copy)"))
def duplicate_rows(spark, d):
    return tr.duplicate(virtual.matrix(spark, d))


_U = "(CAST('0x' || left(md5('{s}|' || cell_id || '|' || gene_id), 8) AS UBIGINT) / 4294967296.0)"
_UC = "(CAST('0x' || left(md5('{s}|' || cell_id), 8) AS UBIGINT) / 4294967296.0)"


@query(_with(_MATRIX, select=f"SELECT cell_id, gene_id, CASE WHEN {_UC.format(s=7)} < 0.5 AND {_U.format(s=9)} < 0.1 + 0.2 * {_U.format(s=8)} THEN 0 ELSE x END AS x FROM matrix"))
def dropout_augmented(spark, d):
    return tr.dropout(virtual.matrix(spark, d), 0.1, 0.3, 0.5, 7)


@query(_with(_MATRIX, f"u AS (SELECT cell_id, gene_id, x, 0.5 + 0.4 * {_U.format(s=8)} AS p, {_U.format(s=9)} AS u FROM matrix)", "k AS (SELECT cell_id, gene_id, u, k, SUM(exp(lgamma(x + 1) - lgamma(k + 1) - lgamma(x - k + 1) + k * ln(p) + (x - k) * ln(1 - p))) OVER (PARTITION BY cell_id, gene_id ORDER BY k) AS cdf FROM (SELECT *, unnest(range(0, CAST(x AS BIGINT) + 1)) AS k FROM u))", select="SELECT cell_id, gene_id, CAST(coalesce(MIN(k) FILTER (cdf >= u), MAX(k)) AS DOUBLE) AS x FROM k GROUP BY 1, 2"))
def binomial_resampled(spark, d):
    return tr.binomial_resample(virtual.matrix(spark, d), 0.5, 0.9, 1.0, 7)


@query(_with(_CELLS, _GENES, _MATRIX, "g AS (SELECT cell_id, gene_id, coalesce(x, 0) AS x FROM (SELECT cell_id FROM cells) CROSS JOIN (SELECT gene_id FROM genes) LEFT JOIN matrix USING (cell_id, gene_id))", select=f"SELECT cell_id, gene_id, round(x + sqrt(-2 * ln(1 - {_U.format(s=9)})) * cos(2 * pi() * {_U.format(s=10)}) * (0.1 + 0.1 * {_U.format(s=8)}), 6) AS x FROM g"))
def gaussian_noise_augmented(spark, d):
    return tr.noisy_grid(virtual.matrix(spark, d), virtual.cells(spark, d), virtual.genes(spark, d), 0.1, 0.2, 1.0, 7, digits=6)


# categories ---------------------------------------------------------------------------------------

_COLS = ("batch", "assay", "cell_type")
_CATS = "cats AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY category) - 1 AS code FROM (SELECT DISTINCT 'batch' AS \"column\", batch AS category FROM cells UNION SELECT DISTINCT 'assay', assay FROM cells UNION SELECT DISTINCT 'cell_type', cell_type FROM cells))"
_CODED = "coded AS (SELECT cells.*, b.code AS cb, a.code AS ca FROM cells JOIN cats b ON b.\"column\" = 'batch' AND b.category = batch JOIN cats a ON a.\"column\" = 'assay' AND a.category = assay)"


@query(_with(_CELLS, _CATS, select='SELECT "column", category, CAST(code AS INTEGER) AS code FROM cats'))
def category_table(spark, d):
    return cat.categories(virtual.cells(spark, d), *_COLS)


@query(_with(_CELLS, _CATS, _CODED, select="SELECT cell_id, CAST(cb AS INTEGER) AS batch_code FROM coded"))
def category_codes(spark, d):
    c = virtual.cells(spark, d)
    return cat.add_codes(c, cat.categories(c, *_COLS), "batch").select("cell_id", "batch_code")


@query(_with(_CELLS, _CATS, _CODED, select="SELECT cell_id, CAST(cb + ca * (SELECT COUNT(*) FROM cats WHERE \"column\" = 'batch') AS BIGINT) AS code FROM coded"))
def product_codes(spark, d):
    c = virtual.cells(spark, d)
    return cat.product_code(c, cat.categories(c, *_COLS), ["batch", "assay"]).select("cell_id", F.col("code").cast("long").alias("code"))


@query(_with(_CELLS, _CATS, select="SELECT b.category AS batch, a.category AS assay, CAST(b.code + a.code * (SELECT COUNT(*) FROM cats WHERE \"column\" = 'batch') AS BIGINT) AS code FROM cats b CROSS JOIN cats a WHERE b.\"column\" = 'batch' AND a.\"column\" = 'assay'"))
def all_combinations(spark, d):
    out = cat.combinations(cat.categories(virtual.cells(spark, d), *_COLS), ["batch", "assay"])
    return out.select("batch", "assay", F.col("code").cast("long").alias("code"))


@query(_with(_CELLS, select="SELECT batch, assay, COUNT(*) AS cell_count FROM cells GROUP BY 1, 2"))
def observed_combinations(spark, d):
    return virtual.cells(spark, d).groupBy("batch", "assay").agg(F.count(F.lit(1)).alias("cell_count")).orderBy(F.desc("cell_count"))


@query(_with(_CELLS, _CATS, select="SELECT cell_id, category, CASE WHEN assay = category THEN 1 ELSE 0 END AS hot FROM cells CROSS JOIN cats WHERE \"column\" = 'assay'"))
def one_hot(spark, d):
    c = virtual.cells(spark, d)
    return cat.one_hot(c, cat.categories(c, *_COLS), "assay").select("cell_id", "category", "hot")


@query(_with(_CELLS, _CATS, select='SELECT "column", COUNT(*) AS n FROM cats GROUP BY 1'))
def metadata_counts(spark, d):
    return cat.categories(virtual.cells(spark, d), *_COLS).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'cells' AS what, COUNT(*) AS n FROM orders UNION ALL SELECT 'genes', COUNT(*) FROM supplier")
def shape(spark, d):
    n = [("cells", virtual.cells(spark, d)), ("genes", virtual.genes(spark, d))]
    parts = [x.agg(F.lit(w).alias("what"), F.count(F.lit(1)).alias("n")) for w, x in n]
    return parts[0].unionByName(parts[1])


# sources ------------------------------------------------------------------------------------------


@query(_with(_CELLS, select="SELECT DISTINCT tissue AS category, 'reference' AS side FROM cells WHERE tissue NOT IN (SELECT tissue FROM cells WHERE cell_id % 2 = 0 AND tissue <> 'NATION_3' AND tissue NOT LIKE 'NATION_1%')"))
def category_symmetric_difference(spark, d):
    c = virtual.cells(spark, d)
    return shards.category_difference(c, c.where("cell_id % 2 = 0 and tissue != 'NATION_3' and tissue not like 'NATION_1%'"), "tissue")


@query("SELECT k AS pos, l_orderkey AS cell_id, SUM(l_quantity) AS total FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 1)) w(k, id) JOIN lineitem ON l_orderkey = id GROUP BY 1, 2")
def row_gather_with_duplicates(spark, d):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 1)], "pos int, cell_id long")
    return shards.gather_rows(virtual.matrix(spark, d), "cell_id", wanted).groupBy("pos", "cell_id").agg(F.sum("x").alias("total"))


@query(_with(_MATRIX, select="SELECT out_pos, cell_id, gene_id, x FROM (VALUES (0, 4), (1, 2), (2, 1)) w(out_pos, g) JOIN matrix ON gene_id = g"))
def column_gather(spark, d):
    wanted = spark.createDataFrame([(0, 4), (1, 2), (2, 1)], "out_pos int, gene_id long")
    return virtual.matrix(spark, d).join(F.broadcast(wanted), "gene_id").select("out_pos", "cell_id", "gene_id", "x")


@query("WITH n AS (SELECT COUNT(*) AS n FROM orders) SELECT CAST(k AS INTEGER) AS shard_id, CAST(k * 400 AS BIGINT) AS start, CAST(least((k + 1) * 400, n) AS BIGINT) AS stop FROM n, range(CAST(ceil(n / 400.0) AS BIGINT)) r(k)")
def limits_from_shard_size(spark, d):
    """Limits of the orders in shards of 400, the last one shorter."""
    n = table(spark, d, "orders").count()
    k = -(-n // 400)
    return shards.shard_table(spark, shards.limits(k, 400, n - 400 * (k - 1)))


@query("SELECT o_orderkey AS cell_id, CAST(CASE WHEN o_orderkey >= 1200 THEN 3 ELSE o_orderkey // 400 END AS INTEGER) AS shard_id FROM orders WHERE o_orderkey < 1300")
def shard_lookup(spark, d):
    t = shards.shard_table(spark, shards.limits(4, 400, 100))
    return shards.lookup_shards(table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")), "cell_id", t).select("cell_id", "shard_id")


# splits and assignment ----------------------------------------------------------------------------


@query("SELECT o_orderkey AS cell_id, CASE WHEN p < ceil(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN p < ceil(n * CAST(0.7 AS DOUBLE)) + 100 THEN 'val' ELSE 'rest' END AS part, p >= n - 50 AS is_predict FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, COUNT(*) OVER () AS n FROM orders)")
def train_val_split(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"))
    return sampling.split(o, "cell_id", o.count(), 0.7, 100, 50).select("cell_id", "part", "is_predict")


@query(_with(_CELLS, "b AS (SELECT batch, COUNT(*) AS n FROM cells GROUP BY 1)", select="SELECT batch, CAST(k AS INTEGER) AS k, CAST(CASE k WHEN 0 THEN ceil(n * CAST(0.8 AS DOUBLE)) WHEN 1 THEN ceil(n * CAST(0.8 AS DOUBLE)) WHEN 2 THEN n - ceil(n * CAST(0.2 AS DOUBLE)) WHEN 3 THEN 80 WHEN 4 THEN 80 WHEN 5 THEN n - 20 ELSE n END AS BIGINT) AS n_train, CAST(CASE k WHEN 0 THEN ceil(n * CAST(0.1 AS DOUBLE)) WHEN 1 THEN n - ceil(n * CAST(0.8 AS DOUBLE)) WHEN 2 THEN ceil(n * CAST(0.2 AS DOUBLE)) WHEN 3 THEN 20 WHEN 4 THEN n - 80 WHEN 5 THEN 20 ELSE 0 END AS BIGINT) AS n_val FROM b CROSS JOIN range(7) r(k)"))
def split_sizes_table(spark, d):
    """Sizes of the parts of each batch for shares, numbers and missing parts."""
    given = [(0.8, 0.1), (0.8, None), (None, 0.2), (80, 20), (80, None), (None, 20), (None, None)]
    sizes = virtual.cells(spark, d).groupBy("batch").count().collect()  # batches
    return spark.createDataFrame([(r["batch"], k, *sampling.split_sizes(r["count"], *g)) for r in sizes for k, g in enumerate(given)], "batch string, k int, n_train long, n_val long")


_SHUF = "o AS (SELECT o_orderkey AS cell_id, o_orderkey // 1000 AS shard FROM orders), shuffled AS (SELECT cell_id, row_number() OVER (ORDER BY md5('5|shard|' || CAST(shard AS VARCHAR)), md5('5|row|' || CAST(cell_id AS VARCHAR))) - 1 AS pos FROM o)"


def _shuffled(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.floor(F.col("o_orderkey") / 1000).alias("shard"))
    return sampling.shard_shuffle(o, "shard", "cell_id", 3, 2)


@query(_with(_SHUF, select="SELECT cell_id, pos FROM shuffled"))
def shard_shuffle(spark, d):
    return _shuffled(spark, d).select("cell_id", F.col("pos").cast("long").alias("pos"))


@query(_with(_SHUF, "c AS (SELECT COUNT(*) AS n FROM orders)", "s AS (SELECT cell_id, pos AS slot FROM shuffled UNION ALL SELECT cell_id, pos + n FROM shuffled, c WHERE pos + n < ceil(n / 7.0) * 7)", select="SELECT cell_id, CAST(slot AS BIGINT) AS slot, CAST(slot % 7 AS BIGINT) AS replica, CAST((slot // 7) // 64 AS BIGINT) AS batch, CAST(((slot // 7) // 64) % 3 AS BIGINT) AS worker FROM s"))
def same_order_assignment(spark, d):
    s = _shuffled(spark, d)
    n = s.count()
    out = sampling.same_order(sampling.even_positions(s, n, 7, False), n, 7, 64, 3)
    return out.select("cell_id", *[F.col(c).cast("long").alias(c) for c in ("slot", "replica", "batch", "worker")])


@query(_with(_SHUF, "c AS (SELECT COUNT(*) // 7 AS per FROM orders)", "s AS (SELECT cell_id, pos AS slot, per, (per + 63) // 64 AS batches, (pos % per) // 64 AS batch FROM shuffled, c WHERE pos < per * 7)", "w AS (SELECT *, (batches + 2) // 3 AS each FROM s)", select="SELECT cell_id, CAST(slot // per AS BIGINT) AS replica, CAST(batch AS BIGINT) AS batch, CAST(batch // each AS BIGINT) AS worker, CAST((batch % each) * 3 + batch // each AS BIGINT) AS turn FROM w"))
def cache_efficient_assignment(spark, d):
    s = _shuffled(spark, d)
    n = s.count()
    out = sampling.cache_efficient(sampling.even_positions(s, n, 7, True), n, 7, 64, 3, True)
    return out.select("cell_id", *[F.col(c).cast("long").alias(c) for c in ("replica", "batch", "worker", "turn")])


@query(_with(_SHUF, select="SELECT cell_id, CAST(pos // 64 AS BIGINT) AS batch FROM shuffled, (SELECT COUNT(*) AS n FROM orders) WHERE pos < (n // 64) * 64"))
def drop_incomplete_batches(spark, d):
    s = _shuffled(spark, d)
    n = s.count()
    return sampling.drop_incomplete(sampling.same_order(sampling.even_positions(s, n, 1, False), n, 1, 64, 1), 64).select("cell_id", F.col("batch").cast("long").alias("batch"))


@query("SELECT o_orderkey AS cell_id FROM orders ORDER BY md5('11|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def reservoir_sample(spark, d):
    return sampling.reservoir(table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")), "cell_id", 100, 11)


# highly variable genes ----------------------------------------------------------------------------

_MOM = (_CELLS, _MATRIX, _NORM, _ONEPASS.format(m="norm"))
_DISP = "d0 AS (SELECT gene_id, ln(1 + CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) AS mean, CASE WHEN var > 0 THEN ln(var / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) END AS disp FROM onepass), d1 AS (SELECT *, greatest(1, least(20, CAST(ceil((mean - MIN(mean) OVER ()) / (MAX(mean) OVER () - MIN(mean) OVER ()) * 20) AS INTEGER))) AS bin FROM d0), d2 AS (SELECT *, AVG(disp) OVER (PARTITION BY bin) AS a, stddev_samp(disp) OVER (PARTITION BY bin) AS s FROM d1), disp AS (SELECT gene_id, mean, disp, bin, CASE WHEN s IS NULL THEN disp / nullif(a, 0) ELSE (disp - a) / nullif(s, 0) END AS z FROM d2)"


@query(_with(*_MOM, _DISP, select="SELECT gene_id, round(z, 6) AS dispersion_norm, coalesce(z, 0) >= (SELECT MIN(z) FROM (SELECT z, rank() OVER (ORDER BY z DESC NULLS LAST) AS r FROM disp) WHERE r <= 15 AND z IS NOT NULL) AS highly_variable FROM disp"))
def hvg_seurat_v1_topn(spark, d):
    return hvg.seurat_top(hvg.seurat_dispersion(_moments(spark, d)), 15).select("gene_id", r6(F.col("dispersion_norm")).alias("dispersion_norm"), "highly_variable")


@query(_with(*_MOM, _DISP, select="SELECT gene_id, mean > 0.01 AND mean < 5 AND coalesce(z, 0) > 0.2 AND coalesce(z, 0) < 10 AS highly_variable FROM disp"))
def hvg_seurat_v1_cutoff(spark, d):
    return hvg.seurat_cutoff(hvg.seurat_dispersion(_moments(spark, d)), 0.2, 10, 0.01, 5).select("gene_id", "highly_variable")


_BATCH = "mo AS (SELECT batch, gene_id, SUM(x) / n AS mean, SUM(x * x) / n - (SUM(x) / n) * (SUM(x) / n) AS var FROM matrix JOIN cells USING (cell_id) JOIN (SELECT batch, COUNT(*) AS n FROM cells GROUP BY 1) USING (batch) GROUP BY batch, gene_id, n)"
_BDISP = _DISP.replace("SELECT gene_id, ln", "SELECT batch, gene_id, ln").replace("FROM onepass", "FROM mo").replace("OVER ()", "OVER (PARTITION BY batch)").replace("PARTITION BY bin", "PARTITION BY batch, bin").replace("SELECT gene_id, mean, disp, bin", "SELECT batch, gene_id, mean, disp, bin")


@query(_with(_CELLS, _MATRIX, _BATCH, _BDISP, "t AS (SELECT *, CASE WHEN z IS NOT NULL AND rank() OVER (PARTITION BY batch ORDER BY z DESC NULLS LAST) <= 12 THEN 1 ELSE 0 END AS top FROM disp)", "g AS (SELECT gene_id, SUM(top) AS nb, AVG(coalesce(z, 0)) AS z FROM t GROUP BY 1)", select="SELECT gene_id, CAST(nb AS BIGINT) AS nbatches, round(z, 6) AS dispersion_norm, row_number() OVER (ORDER BY nb DESC, z DESC NULLS LAST, gene_id) <= 12 AS highly_variable FROM g"))
def hvg_seurat_v1_batched(spark, d):
    mo = stats.onepass_by_batch(virtual.matrix(spark, d), virtual.cells(spark, d))
    return hvg.seurat_batched(mo, 12).select("gene_id", "nbatches", r6(F.col("dispersion_norm")).alias("dispersion_norm"), "highly_variable")


_KOT = "f AS (SELECT gene_id, mean, var, var / nullif(mean, 0) AS fano FROM onepass), a AS (SELECT MIN(sqrt(var) / mean) AS a FROM (SELECT * FROM f ORDER BY mean DESC, gene_id LIMIT 20)), q AS (SELECT quantile_cont(mean, 0.1) AS ml, quantile_cont(mean, 0.9) AS mh, quantile_cont(fano, 0.1) AS fl, quantile_cont(fano, 0.9) AS fh FROM f), b AS (SELECT sqrt(median(fano)) AS b, stddev_samp(fano) AS s FROM f, q WHERE mean > ml AND mean < mh AND fano > fl AND fano < fh), r AS (SELECT gene_id, mean, fano / (a * a * mean + b * b) AS ratio, s FROM f, a, b)"


@query(_with(*_MOM, _KOT, select="SELECT gene_id, round(ratio, 6) AS ratio, row_number() OVER (ORDER BY ratio DESC NULLS LAST, gene_id) <= 10 AS highly_variable FROM r"))
def hvg_kotliar_topn(spark, d):
    return hvg.kotliar(_moments(spark, d), 10).select("gene_id", r6(F.col("ratio")).alias("ratio"), "highly_variable")


@query(_with(*_MOM, _KOT, select="SELECT gene_id, coalesce(ratio > 1 + s AND mean > 0.01, false) AS highly_variable FROM r"))
def hvg_kotliar_threshold(spark, d):
    return hvg.kotliar(_moments(spark, d), None, None, 0.01).select("gene_id", "highly_variable")


_V1 = "bn AS (SELECT batch, COUNT(*) AS n FROM cells GROUP BY 1), mo AS (SELECT batch, gene_id, n, SUM(x) / n AS mean, (SUM(x * x) - SUM(x) * SUM(x) / n) / (n - 1) AS var FROM matrix JOIN cells USING (cell_id) JOIN bn USING (batch) GROUP BY batch, gene_id, n)"
_LOESS = """pt AS (SELECT batch, gene_id, log10(mean) AS lx, log10(var) AS ly FROM mo WHERE var > 0 AND mean > 0),
pr AS (SELECT a.batch, a.gene_id, b.lx - a.lx AS u, b.ly AS v FROM pt a JOIN pt b USING (batch)),
near AS (SELECT *, row_number() OVER (PARTITION BY batch, gene_id ORDER BY abs(u)) AS place, COUNT(*) OVER (PARTITION BY batch, gene_id) AS k FROM pr),
band AS (SELECT batch, gene_id, k, greatest(abs(u), 1e-12) AS h FROM near WHERE place = least(k, greatest(4, ceil(0.3 * k)))),
wt AS (SELECT batch, gene_id, k, u / h AS u, v, CASE WHEN abs(u) < h THEN power(1 - power(abs(u) / h, 3), 3) ELSE 0 END AS w FROM pr JOIN band USING (batch, gene_id)),
ls AS (SELECT batch, gene_id, k, SUM(w) AS s0, SUM(w * u) AS s1, SUM(w * u * u) AS s2, SUM(w * u * u * u) AS s3, SUM(w * u * u * u * u) AS s4, SUM(w * v) AS t0, SUM(w * v * u) AS t1, SUM(w * v * u * u) AS t2 FROM wt GROUP BY batch, gene_id, k),
fit AS (SELECT batch, gene_id, CASE WHEN k < 4 THEN 0 ELSE (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) END AS est FROM ls)"""
_V2 = _LOESS + ", cl AS (SELECT batch, gene_id, n, mean, coalesce(est, 0) AS est, sqrt(power(10.0, coalesce(est, 0))) AS rs FROM mo LEFT JOIN fit USING (batch, gene_id)), clip AS (SELECT *, rs * sqrt(n) + mean AS clip FROM cl)"
_V3 = "nv AS (SELECT batch, gene_id, n, coalesce((n * mean * mean + SUM(least(x, clip) * least(x, clip)) - 2 * mean * SUM(least(x, clip))) / nullif((n - 1) * rs * rs, 0), 0) AS nv FROM matrix JOIN cells USING (cell_id) JOIN clip USING (batch, gene_id) GROUP BY batch, gene_id, n, mean, rs)"


def _rank_sql(order: str) -> str:
    return _with(_CELLS, _MATRIX, _V1, _V2, _V3, "rk AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY round(nv, 9) DESC, gene_id) - 1 AS r FROM nv)", "g AS (SELECT gene_id, COUNT(*) FILTER (r < 20) AS nbatches, quantile_cont(CASE WHEN r < 20 THEN r END, 0.5) AS mr, AVG(nv) AS nv FROM rk GROUP BY 1)", select=f"SELECT gene_id, nbatches, CAST(mr AS DOUBLE) AS median_rank, round(nv, 6) AS norm_var, row_number() OVER (ORDER BY {order}, gene_id) <= 20 AS highly_variable FROM g")


def _clip(spark, d):
    return hvg.v3_clip(hvg.loess_trend(hvg.v3_moments(virtual.matrix(spark, d), virtual.cells(spark, d))))


def _norm_var(spark, d):
    """Both passes over one written table of values by batch."""
    c = virtual.cells(spark, d)
    x = hvg.by_batch(virtual.matrix(spark, d), c)
    return hvg.v3_norm_var(x, c, hvg.v3_clip(hvg.loess_trend(hvg.v3_moments(x, c))))


@query(_with(_CELLS, _MATRIX, _V1, select="SELECT batch, gene_id, n, round(mean, 6) AS mean, round(var, 6) AS var FROM mo"))
def hvg_v3_pass1(spark, d):
    return hvg.v3_moments(virtual.matrix(spark, d), virtual.cells(spark, d)).select("batch", "gene_id", "n", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))


@query(_with(_CELLS, _MATRIX, _V1, _V2, select="SELECT batch, gene_id, round(clip, 4) AS clip FROM clip"))
def hvg_v3_clip(spark, d):
    return _clip(spark, d).select("batch", "gene_id", F.round("clip", 4).alias("clip"))


@query(_with(_CELLS, _MATRIX, _V1, _V2, _V3, select="SELECT batch, gene_id, round(nv, 6) AS norm_var FROM nv"))
def hvg_v3_pass2(spark, d):
    return _norm_var(spark, d).select("batch", "gene_id", r6(F.col("norm_var")).alias("norm_var"))


def _ranked(spark, d, flavor):
    nv = _norm_var(spark, d)
    return hvg.v3_rank(nv, 20, flavor).select("gene_id", "nbatches", "median_rank", r6(F.col("norm_var")).alias("norm_var"), "highly_variable")


@query(_rank_sql("mr ASC NULLS LAST, nbatches DESC"))
def hvg_v3_rank(spark, d):
    return _ranked(spark, d, "seurat_v3")


@query(_rank_sql("nbatches DESC, mr ASC NULLS LAST"))
def hvg_v3_rank_paper(spark, d):
    return _ranked(spark, d, "seurat_v3_paper")


@query(_with(_CELLS, _MATRIX, _V1, _V2, select="SELECT batch, gene_id, round(est, 5) AS est FROM clip"))
def hvg_v3_loess(spark, d):
    return _clip(spark, d).select("batch", "gene_id", F.round("est", 5).alias("est"))


# ontology -----------------------------------------------------------------------------------------


def _closure(spark, d):
    return ontology.closure(virtual.edges(spark, d))


def _probs(spark, d):
    """Per segment, the share of each nation."""
    c = virtual.cells(spark, d).groupBy(F.col("cell_type").alias("row"), F.col("tissue").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("row")))


_PROBS = "probs AS (SELECT cell_type AS \"row\", tissue AS term, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY cell_type) AS p FROM cells GROUP BY 1, 2)"


@query(_with(_EDGES, _CLO, select="SELECT ancestor, descendant, dist FROM clo", recursive=True))
def ontology_closure(spark, d):
    return _closure(spark, d)


@query(_with(_EDGES, _CLO, select="SELECT DISTINCT ancestor AS term FROM clo WHERE descendant IN ('NATION_3', 'NATION_8', 'ASIA')", recursive=True))
def ancestors_of_subset(spark, d):
    return ontology.with_ancestors(spark.createDataFrame([("NATION_3",), ("NATION_8",), ("ASIA",)], "term string"), _closure(spark, d))


@query(_with(_EDGES, _CLO, select="SELECT x.descendant AS a, y.descendant AS b, CAST(MIN(x.dist + y.dist) AS INTEGER) AS dist FROM clo x JOIN clo y ON x.ancestor = y.ancestor GROUP BY 1, 2", recursive=True))
def shortest_distance(spark, d):
    return ontology.distances(virtual.edges(spark, d))


@query(_with(_EDGES, _CLO, select="SELECT ancestor AS term FROM clo GROUP BY 1 HAVING COUNT(*) = 1", recursive=True))
def leaf_terms(spark, d):
    return ontology.leaves(_closure(spark, d))


@query(_with(_EDGES, _CLO, "c(label, term) AS (VALUES ('east', 'ASIA'), ('west', 'AMERICA'))", "h AS (SELECT DISTINCT descendant AS term, label FROM clo JOIN c ON ancestor = term)", select="SELECT * FROM h UNION ALL SELECT DISTINCT descendant, 'other' FROM clo WHERE descendant NOT IN (SELECT term FROM h)", recursive=True))
def coarse_map(spark, d):
    return ontology.coarse_map(_closure(spark, d), spark.createDataFrame([("east", "ASIA"), ("west", "AMERICA")], "label string, term string"))


@query(_with(_EDGES, _CLO, _CELLS, _PROBS, select='SELECT "row", ancestor AS term, round(least(1.0, SUM(p)), 6) AS p FROM probs JOIN clo ON descendant = term GROUP BY 1, 2', recursive=True))
def propagate_probs(spark, d):
    return ontology.propagate_probs(_probs(spark, d), _closure(spark, d)).select("row", "term", r6(F.col("p")).alias("p"))


@query(_with(_EDGES, _CLO, _CELLS, _PROBS, "z AS (SELECT \"row\", term, ln(p) * 2 AS logit FROM probs)", "t AS (SELECT \"row\", ln(SUM(exp(logit))) AS every FROM z GROUP BY 1)", select='SELECT "row", ancestor AS term, round(ln(SUM(exp(logit))) - every, 6) AS logit FROM z JOIN clo ON descendant = term JOIN t USING ("row") GROUP BY "row", ancestor, every', recursive=True))
def propagate_logits(spark, d):
    z = _probs(spark, d).select("row", "term", (F.log("p") * 2).alias("logit"))
    return ontology.propagate_logits(z, _closure(spark, d)).select("row", "term", r6(F.col("logit")).alias("logit"))


@query(_with(_EDGES, _CLO, _CELLS, "n AS (SELECT tissue AS term, COUNT(*) AS n FROM cells GROUP BY 1)", "w AS (SELECT ancestor, descendant, power(0.7, dist) / SUM(power(0.7, dist)) OVER (PARTITION BY descendant) AS w FROM clo)", select="SELECT ancestor AS term, CAST(floor(SUM(n * w) + 1e-9) AS BIGINT) AS n FROM n JOIN w ON descendant = term GROUP BY 1", recursive=True))
def smoothed_counts(spark, d):
    n = virtual.cells(spark, d).groupBy(F.col("tissue").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return ontology.smoothed_counts(n, _closure(spark, d), 0.3)


# tokens -------------------------------------------------------------------------------------------

_RANKED = "SELECT cell_id, CAST(place AS INTEGER) AS place, CASE WHEN x > 0 THEN CAST(gene_id AS BIGINT) + 2 ELSE 0 END AS token, CASE WHEN x > 0 THEN 1 ELSE 0 END AS mask FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY x DESC, gene_id) AS place FROM {m}) WHERE place <= 4"


def _tokens(df):
    return df.select("cell_id", "place", F.col("token").cast("long").alias("token"), "mask")


@query(_with(_MATRIX, select=_RANKED.format(m="matrix")))
def rank_tokens(spark, d):
    return _tokens(tokens.rank_tokens(virtual.matrix(spark, d), 4))


@query(_with(_MATRIX, "p AS (SELECT cell_id, gene_id, CASE WHEN gene_id IN (1, 3) THEN 0 ELSE x END AS x FROM matrix)", select=_RANKED.format(m="p")))
def perturb_deletion(spark, d):
    return _tokens(tokens.rank_tokens(tokens.perturb(virtual.matrix(spark, d), deletion=[1, 3]), 4))


@query(_with(_MATRIX, "p AS (SELECT cell_id, gene_id, x FROM matrix WHERE gene_id NOT IN (4, 2) UNION ALL SELECT cell_id, g, (SELECT MAX(x) FROM matrix) + up FROM (SELECT DISTINCT cell_id FROM matrix) CROSS JOIN (VALUES (4, 2), (2, 1)) a(g, up))", select=_RANKED.format(m="p")))
def perturb_activation(spark, d):
    return _tokens(tokens.rank_tokens(tokens.perturb(virtual.matrix(spark, d), activation=[4, 2]), 4))


@query(_with(_MATRIX, f"t AS ({_RANKED.format(m='matrix')})", select="SELECT cell_id, place, CASE token WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE token END AS token, mask FROM t"))
def perturb_map(spark, d):
    return _tokens(tokens.replace_tokens(tokens.rank_tokens(virtual.matrix(spark, d), 4), {3: 1, 4: 1}))


_CTX = "ctx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY md5('5|' || CAST(cell_id AS VARCHAR) || '|' || CAST(gene_id AS VARCHAR))) AS place FROM matrix) WHERE place <= 5), pq AS (SELECT *, CASE WHEN place > 2 THEN 1 ELSE 0 END AS is_query FROM ctx)"


def _ctx(spark, d):
    return tokens.shuffled_context(virtual.matrix(spark, d), 5, 5)


@query(_with(_MATRIX, _CTX, select="SELECT cell_id, gene_id, CAST(place AS INTEGER) AS place FROM ctx"))
def gene_shuffle_context(spark, d):
    return _ctx(spark, d).select("cell_id", "gene_id", "place")


@query(_with(_MATRIX, _CTX, select="SELECT cell_id, gene_id, 1 - is_query AS is_prompt, is_query, round(CAST(is_query AS DOUBLE) / greatest(SUM(is_query) OVER (PARTITION BY cell_id), 1), 6) AS weight FROM pq"))
def prompt_query_split(spark, d):
    return tokens.prompt_query(_ctx(spark, d), 2).select("cell_id", "gene_id", "is_prompt", "is_query", r6(F.col("weight")).alias("weight"))


@query(_with(_MATRIX, _CTX, select="SELECT cell_id, gene_id, round(ln(1 + x) * (1 - is_query), 6) AS value, CAST(least(greatest(x, 0), 29) AS BIGINT) AS label FROM pq"))
def value_labels(spark, d):
    return tokens.values_labels(tokens.prompt_query(_ctx(spark, d), 2), 30).select("cell_id", "gene_id", r6(F.col("value")).alias("value"), "label")


@query(_with(_CELLS, select="SELECT cell_id, CASE assay WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -1 END AS code, CASE WHEN cell_id % 3 = 0 THEN 2 WHEN assay = 'F' THEN 1 ELSE 0 END AS token FROM cells"))
def metadata_codes(spark, d):
    return tokens.metadata_codes(virtual.cells(spark, d), "assay", ["O", "F"], F.col("cell_id") % 3 == 0).select("cell_id", "code", "token")


@query(_with(_MATRIX, select="SELECT cell_id, gene_id, round_even(x * least(SUM(x) OVER (PARTITION BY cell_id), 50.0) / SUM(x) OVER (PARTITION BY cell_id), 0) AS x FROM matrix"))
def predict_downsample(spark, d):
    return tokens.downsample_predict(virtual.matrix(spark, d), 50.0)


@query(_with(_MATRIX, _CTX, select="SELECT a.cell_id, CAST(a.place AS INTEGER) AS i, CAST(b.place AS INTEGER) AS j, CASE WHEN b.is_query = 0 OR a.place = b.place THEN 1 ELSE 0 END AS attends FROM pq a JOIN pq b USING (cell_id)"))
def attention_mask(spark, d):
    return tokens.attention_mask(tokens.prompt_query(_ctx(spark, d), 2))


# scores -------------------------------------------------------------------------------------------

_LOGITS = "w AS (SELECT gene_id, k, sin(gene_id * 1.0 + k) AS w FROM (SELECT s_suppkey AS gene_id FROM supplier) CROSS JOIN range(4) r(k)), logits AS (SELECT cell_id, k, SUM(x * w) / 10 AS logit FROM matrix JOIN w USING (gene_id) GROUP BY 1, 2)"
_SOFT = "soft AS (SELECT cell_id, k, exp(logit - m) / SUM(exp(logit - m)) OVER (PARTITION BY cell_id) AS p FROM (SELECT *, MAX(logit) OVER (PARTITION BY cell_id) AS m FROM logits))"


def _logits(spark, d):
    w = virtual.genes(spark, d).select("gene_id").crossJoin(spark.range(4).withColumnRenamed("id", "k")).withColumn("w", F.sin(F.col("gene_id") + F.col("k").cast("double")))
    return evaluate.matmul(virtual.matrix(spark, d), w).withColumn("logit", F.col("logit") / 10)


def _soft(spark, d):
    return _logits(spark, d).select("cell_id", "k", fx.softmax("logit", "cell_id").alias("p"))


@query(_with(_MATRIX, _LOGITS, select="SELECT cell_id, k, round(logit, 6) AS logit FROM logits"))
def logits_matmul(spark, d):
    return _logits(spark, d).select("cell_id", "k", r6(F.col("logit")).alias("logit"))


@query(_with(_MATRIX, _LOGITS, _SOFT, select="SELECT cell_id, k, round(p, 6) AS p FROM soft"))
def softmax_probs(spark, d):
    return _soft(spark, d).select("cell_id", "k", r6(F.col("p")).alias("p"))


@query(_with(_MATRIX, _LOGITS, select="SELECT cell_id, k FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY logit DESC, k) AS r FROM logits) WHERE r = 1"))
def argmax_class(spark, d):
    return evaluate.argmax(_logits(spark, d))


@query(_with(_MATRIX, _LOGITS, _SOFT, select="SELECT k, round(SUM(-ln(p + 1e-300) * (1 + cell_id % 3)) / SUM(1 + cell_id % 3), 6) AS loss FROM soft GROUP BY 1"))
def weighted_ce(spark, d):
    rows = _soft(spark, d).select("k", (-F.log(F.col("p") + 1e-300)).alias("loss"), (1.0 + F.col("cell_id") % 3).alias("w"))
    return evaluate.weighted_ce(rows, "k").select("k", r6(F.col("loss")).alias("loss"))


@query(_with(_MATRIX, _LOGITS, _SOFT, select="SELECT cell_id, round(SUM(k * p), 6) AS mean, round(SUM(k * k * p) - SUM(k * p) * SUM(k * p), 6) AS var FROM soft GROUP BY 1"))
def predictive_moments(spark, d):
    return evaluate.predictive_moments(_soft(spark, d)).select("cell_id", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))


@query(_with(_MATRIX, _LOGITS, select="SELECT round(AVG(CASE WHEN k = cell_id % 4 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY logit DESC, k) AS r FROM logits) WHERE r = 1"))
def top1_accuracy(spark, d):
    return evaluate.argmax(_logits(spark, d)).agg(r6(F.avg((F.col("k") == F.col("cell_id") % 4).cast("double"))).alias("accuracy"))


_CENT = "e AS (SELECT label, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), cent AS (SELECT label, dim, COUNT(*) AS n, AVG(v) AS c, AVG(v * v) AS q FROM e GROUP BY 1, 2), cd AS (SELECT x.label AS a, y.label AS b, sqrt(SUM((x.c - y.c) * (x.c - y.c))) AS dist FROM cent x JOIN cent y USING (dim) WHERE x.label <> y.label GROUP BY 1, 2)"


def _cent(spark, d):
    return evaluate.centroids(table(spark, d, "embeddings"), "label")


@query(_with(_CENT, select="SELECT label, CAST(dim AS INTEGER) AS dim, n, round(c, 6) AS c FROM cent"))
def class_centroids(spark, d):
    return _cent(spark, d).select("label", "dim", "n", r6(F.col("c")).alias("c"))


@query(_with(_CENT, select="SELECT a, b, round(dist, 6) AS dist FROM cd"))
def centroid_distances(spark, d):
    return evaluate.centroid_distances(_cent(spark, d), "label").select("a", "b", r6(F.col("dist")).alias("dist"))


@query(_with(_CENT, "i AS (SELECT label, MAX(n) AS n, sqrt(greatest(SUM(q) - SUM(c * c), 0)) AS intra FROM cent GROUP BY 1)", "o AS (SELECT a AS label, MIN(dist) AS b FROM cd GROUP BY 1)", select="SELECT round(SUM((b - intra) / greatest(b, intra, 1e-12) * n) / SUM(n), 6) AS silhouette FROM i JOIN o USING (label)"))
def batch_silhouette(spark, d):
    return evaluate.silhouette(_cent(spark, d), "label").select(r6(F.col("silhouette")).alias("silhouette"))


@query(_with(_CENT, "p AS (SELECT dist AS x, CAST(abs(a - b) AS DOUBLE) AS y, CAST(1 + (a + b) % 4 AS DOUBLE) AS w FROM cd WHERE a < b)", "r AS (SELECT w, rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)", "m AS (SELECT SUM(w) AS sw, SUM(w * rx) / SUM(w) AS mx, SUM(w * ry) / SUM(w) AS my FROM r)", select="SELECT round(SUM(w * (rx - mx) * (ry - my)) / sqrt(SUM(w * (rx - mx) * (rx - mx)) * SUM(w * (ry - my) * (ry - my))), 6) AS rho FROM r, m"))
def weighted_spearman(spark, d):
    p = evaluate.centroid_distances(_cent(spark, d), "label").where("a < b").select(F.col("dist").alias("x"), F.abs(F.col("a") - F.col("b")).cast("double").alias("y"), (1 + (F.col("a") + F.col("b")) % 4).cast("double").alias("w"))
    return evaluate.weighted_spearman(p).select(r6(F.col("rho")).alias("rho"))


@query("WITH v AS (SELECT vec_id // 64 AS batch, vec_id // 2 AS id, vec_id % 2 AS copy, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), u AS (SELECT batch, id, copy, k, v / sqrt(SUM(v * v) OVER (PARTITION BY id, copy)) AS v FROM v), s AS (SELECT a.id AS ia, a.copy AS ca, b.id AS ib, SUM(a.v * b.v) / 0.5 AS s FROM u a JOIN u b ON a.batch = b.batch AND a.k = b.k AND (a.id <> b.id OR a.copy <> b.copy) GROUP BY a.id, a.copy, b.id, b.copy) SELECT round(AVG(l), 6) AS loss FROM (SELECT ln(SUM(exp(s))) - MAX(CASE WHEN ia = ib THEN s END) AS l FROM s GROUP BY ia, ca)")
def ntxent_loss(spark, d):
    p = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("batch"), F.floor(F.col("vec_id") / 2).alias("id"), (F.col("vec_id") % 2).alias("copy"), "embedding")
    return evaluate.nt_xent(p, 0.5).select(r6(F.col("loss")).alias("loss"))


# analysts' queries --------------------------------------------------------------------------------


@query(_with(_CELLS, select="SELECT tissue, COUNT(*) AS n FROM cells GROUP BY 1"))
def freq_table(spark, d):
    return virtual.cells(spark, d).groupBy("tissue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query(_with(_CELLS, select="SELECT cell_id, tissue FROM cells WHERE tissue IN (SELECT tissue FROM cells GROUP BY 1 HAVING COUNT(*) > (SELECT COUNT(*) / 25.0 FROM cells))"))
def having_freq(spark, d):
    c = virtual.cells(spark, d)
    common = c.groupBy("tissue").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy())).where(F.col("n") > F.col("all") / 25.0)
    return c.join(F.broadcast(common), "tissue", "left_semi").select("cell_id", "tissue")


@query(_with(_CELLS, select="SELECT cell_type, COUNT(DISTINCT tissue) AS n FROM cells GROUP BY 1"))
def nunique_by_group(spark, d):
    return virtual.cells(spark, d).groupBy("cell_type").agg(F.count_distinct("tissue").alias("n"))


@query(_with(_CELLS, select="SELECT (SELECT COUNT(tissue) FROM cells) AS count, (SELECT COUNT(DISTINCT tissue) FROM cells) AS uniq, tissue AS top, COUNT(*) AS freq FROM cells GROUP BY tissue ORDER BY freq DESC, tissue LIMIT 1"))
def describe_categorical(spark, d):
    f = virtual.cells(spark, d).groupBy("tissue").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "tissue"))
    return f.agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("uniq"), best["tissue"].alias("top"), (-best["n"]).alias("freq"))


@query(_with(_CELLS, select="SELECT cell_type, round(quantile_cont(library, 0.25), 6) AS q1, round(median(library), 6) AS q2, round(quantile_cont(library, 0.75), 6) AS q3 FROM cells GROUP BY 1"))
def box_summary(spark, d):
    return virtual.cells(spark, d).groupBy("cell_type").agg(*[r6(F.percentile("library", p)).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])


@query(_with(_CELLS, select="SELECT batch, assay, cell_type, tissue, COUNT(*) AS size FROM cells GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 10"))
def group_size_having(spark, d):
    return virtual.cells(spark, d).groupBy("batch", "assay", "cell_type", "tissue").agg(F.count(F.lit(1)).alias("size")).where("size >= 10")


@query(_with(_CELLS, "g AS (SELECT batch, assay, tissue, COUNT(*) AS size FROM cells GROUP BY 1, 2, 3)", select="SELECT batch, COUNT(DISTINCT size) AS sizes, COUNT(DISTINCT tissue) AS tissues FROM g GROUP BY 1"))
def nested_nunique(spark, d):
    g = virtual.cells(spark, d).groupBy("batch", "assay", "tissue").agg(F.count(F.lit(1)).alias("size"))
    return g.groupBy("batch").agg(F.count_distinct("size").alias("sizes"), F.count_distinct("tissue").alias("tissues"))


@query(_with(_CELLS, select="SELECT batch, tissue, round(median(library), 6) AS library FROM cells GROUP BY 1, 2 HAVING COUNT(*) >= 20"))
def median_by_combo(spark, d):
    return virtual.cells(spark, d).groupBy("batch", "tissue").agg(r6(F.median("library")).alias("library"), F.count(F.lit(1)).alias("n")).where("n >= 20").drop("n")


@query(_with(_CELLS, select="SELECT batch, COUNT(*) FILTER (assay = 'F') AS f, COUNT(*) FILTER (assay = 'O') AS o, COUNT(*) FILTER (assay = 'P') AS p FROM cells GROUP BY 1"))
def crosstab(spark, d):
    out = virtual.cells(spark, d).groupBy("batch").pivot("assay", ["F", "O", "P"]).count().na.fill(0)
    return out.select("batch", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query(_with(_CELLS, select="SELECT cell_type, cell_id, library FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY library, cell_id) AS r FROM cells) WHERE r = 1"))
def argmin_row(spark, d):
    best = virtual.cells(spark, d).groupBy("cell_type").agg(F.min(F.struct("library", "cell_id")).alias("b"))
    return best.select("cell_type", "b.cell_id", "b.library")


@query("SELECT round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0")
def loglog_regression(spark, d):
    li = table(spark, d, "lineitem").where("l_extendedprice > 0 and l_quantity > 0")
    y, x = F.log("l_extendedprice"), F.log("l_quantity")
    return li.agg(r6(F.regr_slope(y, x)).alias("slope"), r6(F.regr_intercept(y, x)).alias("intercept"), r6(F.regr_r2(F.col("l_extendedprice"), F.col("l_quantity"))).alias("r2"))


@query("WITH f AS (SELECT avg(l_extendedprice) AS m FROM lineitem) SELECT round(1 - SUM((l_extendedprice - l_quantity * 1000) * (l_extendedprice - l_quantity * 1000)) / SUM((l_extendedprice - m) * (l_extendedprice - m)), 6) AS r2 FROM lineitem, f")
def r_squared(spark, d):
    li = table(spark, d, "lineitem")
    mean = F.broadcast(li.agg(F.avg("l_extendedprice").alias("m")))
    res, tot = F.col("l_extendedprice") - F.col("l_quantity") * 1000, F.col("l_extendedprice") - F.col("m")
    return li.crossJoin(mean).agg(r6(1 - F.sum(res * res) / F.sum(tot * tot)).alias("r2"))


@query("SELECT CAST(h AS BIGINT) AS n_heads, CAST(b AS BIGINT) AS batch_size, CAST(h * 64 AS BIGINT) AS d_model, CAST(12 * h * 64 * h * 64 AS BIGINT) AS params FROM (SELECT DISTINCT p_size AS h FROM part) CROSS JOIN (SELECT DISTINCT 64 * (1 + n_regionkey) AS b FROM nation)")
def config_grid(spark, d):
    """Every number of heads with every batch size."""
    m = table(spark, d, "part").select(F.col("p_size").cast("long").alias("n_heads")).distinct()
    g = table(spark, d, "nation").select((64 * (1 + F.col("n_regionkey"))).cast("long").alias("batch_size")).distinct()
    return m.crossJoin(F.broadcast(g)).withColumn("d_model", F.col("n_heads") * 64).withColumn("params", 12 * F.col("d_model") * F.col("d_model"))


@query(_with(_CELLS, select="SELECT DISTINCT cell_type, tissue FROM cells"))
def distinct_pairs(spark, d):
    return virtual.cells(spark, d).select("cell_type", "tissue").distinct()


@query("WITH k AS (SELECT l_quantity AS q, AVG(l_extendedprice) AS l FROM lineitem GROUP BY 1) SELECT round(regr_slope(ln(l), ln(q)), 6) AS slope FROM k")
def mean_by_key_slope(spark, d):
    k = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("q")).agg(F.avg("l_extendedprice").alias("l"))
    return k.agg(r6(F.regr_slope(F.log("l"), F.log("q"))).alias("slope"))


@query("SELECT c_mktsegment AS cell_type, MIN(c_custkey) AS first_key FROM customer GROUP BY 1")
def dedupe_keep_first(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy("c_custkey")
    return table(spark, d, "customer").withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("c_mktsegment").alias("cell_type"), F.col("c_custkey").alias("first_key"))


@query(_with(_CELLS, _MATRIX, _LOGITS, select="SELECT cell_id, k, round(logit, 6) AS logit, tissue, assay FROM logits JOIN cells USING (cell_id) WHERE k = 1"))
def pred_join_obs(spark, d):
    p = _logits(spark, d).where("k = 1")
    return p.join(virtual.cells(spark, d), "cell_id").select("cell_id", "k", r6(F.col("logit")).alias("logit"), "tissue", "assay")


@query(_with(_CELLS, "a AS (SELECT tissue, COUNT(*) AS na FROM cells WHERE assay = 'F' GROUP BY 1)", "b AS (SELECT tissue, COUNT(*) AS nb FROM cells WHERE assay = 'P' GROUP BY 1)", select="SELECT tissue, na, nb FROM a JOIN b USING (tissue)"))
def outer_then_dropna(spark, d):
    c = virtual.cells(spark, d)
    a, b = (c.where(F.col("assay") == x).groupBy("tissue").agg(F.count(F.lit(1)).alias(n)) for x, n in (("F", "na"), ("P", "nb")))
    return a.join(b, "tissue", "full").na.drop().select("tissue", "na", "nb")


@query("SELECT n_name AS term FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_difference(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal > 5000")
    return n.select(F.col("n_name").alias("term")).exceptAll(n.join(s, n.n_nationkey == s.s_nationkey, "left_semi").select("n_name"))


_LABELS = [("asia", "ASIA"), ("west", "AMERICA"), ("west", "EUROPE"), ("old world", "ASIA"), ("old world", "AFRICA"), ("one", "NATION_3")]


@query(_with(_EDGES, _CLO, "l(label, term) AS (VALUES " + ", ".join(map(str, _LABELS)) + ")", "h AS (SELECT DISTINCT label, descendant FROM clo JOIN l ON ancestor = term)", select="SELECT x.label AS a, y.label AS b, COUNT(*) AS shared FROM h x JOIN h y USING (descendant) WHERE x.label < y.label GROUP BY 1, 2", recursive=True))
def mutual_exclusivity(spark, d):
    """Rows are violations: pairs of coarse labels that share terms."""
    labels = spark.createDataFrame(_LABELS, "label string, ancestor string")
    held = _closure(spark, d).join(F.broadcast(labels), "ancestor").select("label", "descendant").distinct()
    x, y = held.select(F.col("label").alias("a"), "descendant"), held.select(F.col("label").alias("b"), "descendant")
    return x.join(y, "descendant").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


# formulas -----------------------------------------------------------------------------------------


@query(_with(_MATRIX, "g AS (SELECT gene_id, AVG(x) AS mu FROM matrix GROUP BY 1)", select="SELECT gene_id, CAST(theta AS DOUBLE) AS theta, round(mu, 6) AS mu, round(CASE WHEN theta = 0 THEN 0 ELSE mu + mu * mu / nullif(theta, 0) END, 4) AS var FROM g CROSS JOIN (VALUES (CAST(0 AS DOUBLE)), (0.5), (2)) t(theta)"))
def nb_moments(spark, d):
    """Variances that a gene's mean has under several dispersions."""
    mu = virtual.matrix(spark, d).groupBy("gene_id").agg(F.avg("x").alias("mu"))
    theta = F.explode(F.array(*[F.lit(t) for t in (0.0, 0.5, 2.0)])).alias("theta")
    return mu.select("gene_id", "mu", theta).select("gene_id", "theta", r6(F.col("mu")).alias("mu"), F.round(fx.nb_variance(F.col("mu"), F.col("theta")), 4).alias("var"))


@query("SELECT o_orderkey AS step, round(CASE WHEN o_orderkey < 400 THEN o_orderkey / 400.0 ELSE 1 END, 6) AS weight FROM orders")
def kl_warmup(spark, d):
    """The weight of each order's step."""
    step = F.col("o_orderkey")
    return table(spark, d, "orders").select(step.alias("step"), r6(fx.kl_weight(step, 400)).alias("weight"))


@query("SELECT o_orderkey AS step, round(CASE WHEN o_orderkey < 100 THEN o_orderkey / 100.0 ELSE greatest(0, (900 - o_orderkey) / 800.0) END, 6) AS factor FROM orders")
def linear_lr(spark, d):
    """The factor of each order's step."""
    step = F.col("o_orderkey")
    return table(spark, d, "orders").select(step.alias("step"), r6(fx.linear_lr(step, 100, 900)).alias("factor"))


@query("SELECT p_partkey, round((1 + 0.5 * p_size) / (1 + 0.1 * p_size + 0.01 * p_size * p_size), 6) AS pade, round(2 + 3 * pow(p_size + 1.0, -0.3), 6) AS law FROM part")
def pade_eval(spark, d):
    """A rational curve and a power law at each part's size."""
    x = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", r6((1 + 0.5 * x) / (1 + 0.1 * x + 0.01 * x * x)).alias("pade"), r6(2 + 3 * F.pow(x + 1.0, F.lit(-0.3))).alias("law"))


@query("SELECT p_partkey, CAST(6.0 * 12 * p_size * (64.0 * p_size) * (64.0 * p_size) * round(p_retailprice) AS DOUBLE) AS flops FROM part")
def flops_estimate(spark, d):
    """Six operations a weight and token, for as many layers and heads of 64 as a part's size, and tokens as its price."""
    width = 64.0 * F.col("p_size")
    return table(spark, d, "part").select("p_partkey", (6.0 * 12 * F.col("p_size") * width * width * F.round("p_retailprice")).alias("flops"))


# fits, streams ------------------------------------------------------------------------------------


@query()
def logistic_regression_fit(spark, d):
    e = table(spark, d, "embeddings")
    return estimators.coefficients(estimators.logistic_regression(e, e.count(), 1.0, rounds=20))


def _two_parents(k: int = 10) -> np.ndarray:
    """Labels 0 to 9 under two parents of five: classes 10 and 11."""
    desc = np.eye(k + 2, dtype=bool)
    desc[k, : k // 2] = desc[k + 1, k // 2 : k] = True
    return desc


def _ontology_rows(spark, d) -> DataFrame:
    """Vectors of which every fifth is known by its parent's class only."""
    y = F.when(F.col("vec_id") % 5 == 0, F.when(F.col("label") < 5, 10).otherwise(11)).otherwise(F.col("label"))
    return estimators.dense_rows(table(spark, d, "embeddings").where("label between 0 and 9"), y)


@query()
def socam_fit(spark, d):
    """Coefficients of a fit that stops where it is stationary; column 64 is the intercept."""
    fit = estimators.ontology_regression(_ontology_rows(spark, d), 64, _two_parents(), prior_scale=0.1, tolerance=1e-3)
    return spark.createDataFrame([(k, j, float(v)) for k, r in enumerate(np.column_stack([fit.w, fit.b])) for j, v in enumerate(r)], "k int, j int, w double")


@query("WITH y AS (SELECT CASE WHEN vec_id % 5 = 0 THEN CASE WHEN label < 5 THEN 10 ELSE 11 END ELSE label END AS k FROM embeddings WHERE label BETWEEN 0 AND 9) SELECT CAST(k AS INTEGER) AS k, COUNT(*) AS n, TRUE AS converged FROM y GROUP BY 1")
def socam_converged(spark, d):
    """Rows of each class, and whether the fit to them came within its tolerance."""
    rows = _ontology_rows(spark, d)
    fit = estimators.ontology_regression(rows, 64, _two_parents(), prior_scale=0.1, tolerance=1e-3)
    return rows.groupBy(F.col("y").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("converged", F.lit(fit.converged))


@query("WITH e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label BETWEEN 0 AND 9), z AS (SELECT vec_id, k, SUM(v * sin(k + 3.0 * j)) + cos(k) AS z FROM e CROSS JOIN range(12) r(k) GROUP BY 1, 2), p AS (SELECT vec_id, k, exp(z - MAX(z) OVER w) / SUM(exp(z)) OVER w * exp(MAX(z) OVER w) AS p FROM z WINDOW w AS (PARTITION BY vec_id)), up AS (SELECT k AS a, k AS c FROM range(12) r(k) UNION ALL SELECT 10, k FROM range(5) r(k) UNION ALL SELECT 11, k FROM range(5, 10) r(k)) SELECT vec_id AS cell_id, CAST(a AS INTEGER) AS k, round(least(SUM(p), 1), 6) AS p FROM p JOIN up ON k = c GROUP BY 1, 2")
def socam_predict(spark, d):
    """Propagated probabilities under fixed coefficients."""
    k, j = np.arange(12.0), np.arange(64.0)
    p = estimators.ontology_predict(_ontology_rows(spark, d), np.sin(k[:, None] + 3 * j), np.cos(k), _two_parents())
    return p.select("cell_id", F.posexplode("p").alias("k", "p")).select("cell_id", "k", r6(F.col("p")).alias("p"))


@query("SELECT l_suppkey AS gene_id, COUNT(*) AS n, round(SUM(l_quantity), 6) AS s, round(SUM(l_quantity * l_quantity), 6) AS q FROM lineitem GROUP BY 1")
def stream_running_stats(spark, d):
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    out = running.running_stats(spark, f"{d}/lineitem.parquet*", schema, "l_suppkey", "l_quantity")
    return out.select(F.col("l_suppkey").alias("gene_id"), "n", r6(F.col("s")).alias("s"), r6(F.col("q")).alias("q"))


@query("SELECT o_orderkey AS cell_id, o_orderkey % 2 AS split FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY md5('11|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) <= 60")
def stream_reservoir(spark, d):
    """Sixty orders of each split, kept as the state of a stream over the table's files."""
    folder = shared.new_folder(spark, "orders")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), (F.col("o_orderkey") % 2).alias("split"))
    rows.repartition(6, "cell_id").write.parquet(folder)
    return running.running_sample(spark, folder, rows.schema, "cell_id", 60, 11, "split", per_trigger=2)


@query("WITH s AS (SELECT l_suppkey AS gene_id, COUNT(*) AS n, AVG(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std FROM lineitem GROUP BY 1) SELECT gene_id, n, round(any_value(mean), 4) AS mean, round(AVG(least(l_extendedprice, mean + std)), 4) AS clipped FROM lineitem JOIN s ON l_suppkey = gene_id GROUP BY gene_id, n")
def stream_two_passes(spark, d):
    """Means and then means of clipped values, in two passes over a stream; the clip comes from the first."""
    x = F.col("l_extendedprice").cast("double")

    def sums(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        return batch.groupBy(F.col("l_suppkey").alias("gene_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))

    def moments(parts: DataFrame) -> DataFrame:
        mean = F.sum("s") / F.sum("n")
        return parts.groupBy("gene_id").agg(F.sum("n").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("std"))

    def clipped(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        return batch.join(before, F.col("l_suppkey") == F.col("gene_id")).groupBy("gene_id", "n", "mean").agg(F.sum(F.least(x, F.col("mean") + F.col("std"))).alias("s"))

    def result(parts: DataFrame) -> DataFrame:
        return parts.groupBy("gene_id", "n", "mean").agg((F.sum("s") / F.col("n")).alias("clipped"))

    out = running.running_passes(spark, f"{d}/lineitem.parquet*", table(spark, d, "lineitem").schema, [(sums, moments), (clipped, result)])
    return out.select("gene_id", "n", F.round("mean", 4).alias("mean"), F.round("clipped", 4).alias("clipped"))
