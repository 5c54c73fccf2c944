"""More queries with their SQL: sources and sinks read back, fields, prompts, fits, text. Registered into the catalogue."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import evaluate, fits, hvg, lowrank, networks, ontology, prompts, sampling, stats, tokens
from ..operators import transforms as tr
from ..operators.ranges import range_join
from ..sources import fields, ontologies, paths, shard_source, shards, shared, sinks, virtual
from ..sources.fields import Field
from ..sources.virtual import table
from ..streaming import running
from .catalogue import _CELLS, _CENT, _CLO, _CTX, _EDGES, _GENES, _MATRIX, _MOM, _NORM, _U, _UC, _closure, _ctx, _moments, _norm, _shuffled, _soft, _SOFT, _LOGITS, _with, query

# paths and shards ---------------------------------------------------------------------------------

_URI = "u AS (SELECT o_orderkey AS cell_id, CASE o_orderkey % 3 WHEN 0 THEN 'gs://cells-' || lower(o_orderstatus) || '/a/b/' || o_orderkey || '.parquet' WHEN 1 THEN 'file:///data/' || o_orderkey || '.parquet' ELSE 'https://host' || (o_orderkey % 7) || '/x/' || o_orderkey END AS uri FROM orders)"


def _uris(spark, d):
    k = F.col("o_orderkey")
    uri = F.when(k % 3 == 0, F.concat(F.lit("gs://cells-"), F.lower("o_orderstatus"), F.lit("/a/b/"), k, F.lit(".parquet"))).when(k % 3 == 1, F.concat(F.lit("file:///data/"), k, F.lit(".parquet"))).otherwise(F.concat(F.lit("https://host"), k % 7, F.lit("/x/"), k))
    return table(spark, d, "orders").select(k.alias("cell_id"), uri.alias("uri"))


@query(_with(_URI, select=r"SELECT cell_id, regexp_extract(uri, '^([a-z]+):', 1) AS scheme, regexp_extract(uri, '^[a-z]+://([^/]*)/', 1) AS bucket, regexp_extract(uri, '^[a-z]+://[^/]*/(.*)$', 1) AS name, regexp_extract(uri, '([^/]*)$', 1) AS last FROM u"))
def uri_parts(spark, d):
    bucket, name = paths.bucket_and_name(F.col("uri"))
    return _uris(spark, d).select("cell_id", paths.scheme(F.col("uri")).alias("scheme"), bucket.alias("bucket"), name.alias("name"), paths.last_element(F.col("uri")).alias("last"))


@query(_with(_URI, select=r"SELECT cell_id, regexp_matches(uri, '^gs://cells-[of]/.*\.parquet$') OR regexp_matches(uri, '^https://host[0-3]/x/.*$') AS hit FROM u"))
def glob_matches(spark, d):
    return _uris(spark, d).select("cell_id", paths.any_glob(F.col("uri"), ["gs://cells-[of]/*.parquet", "https://host[0-3]/x/*"]).alias("hit"))


@query("SELECT s_suppkey, 'gs://b/' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '_' || s || '.parquet' AS path FROM supplier CROSS JOIN (VALUES ('raw'), ('norm')) v(s)")
def brace_expansion(spark, d):
    """Paths of two files a supplier from one pattern, each with its supplier."""
    s = table(spark, d, "supplier")
    last = s.agg(F.max("s_suppkey")).first()[0]
    paths = spark.createDataFrame([(p,) for p in shards.expand_braces(f"gs://b/{{00000..{last:05d}}}_{{raw,norm}}.parquet")], "path string")
    return paths.withColumn("s_suppkey", F.regexp_extract("path", r"/(\d+)_", 1).cast("long")).join(s.select("s_suppkey"), "s_suppkey")


def _written_shards(spark, d, n: int = 4) -> str:
    """Cells as n shards in the shared folder, in order of id; every other shard has ids as text and totals narrower than the reference's."""
    folder = shared.new_folder(spark, "shards")
    c = virtual.cells(spark, d).select("cell_id", "batch", "assay", "library")
    for k in range(n):
        own = c.where(F.pmod("cell_id", F.lit(n)) == k).repartition(1).sortWithinPartitions("cell_id")  # a shard is one file
        if k % 2 == 0:
            own = own.select(F.col("cell_id").cast("string").alias("cell_id"), "batch", "assay", F.col("library").cast("float").alias("library"))
        own.write.parquet(f"{folder}/shard_{k:03d}.parquet")
    return f"{folder}/shard_{{000..{n - 1:03d}}}.parquet"


_SHARDED = "sharded AS (SELECT *, cell_id % 4 AS shard_id, round(CASE WHEN cell_id % 2 = 0 THEN CAST(CAST(library AS FLOAT) AS DOUBLE) ELSE library END, 2) AS total, row_number() OVER (ORDER BY cell_id % 4, cell_id) - 1 AS row_index FROM cells)"
_AS_READ = "cell_id long, batch string, library double, row_index long, shard string"


@query(_with(_CELLS, _SHARDED, select="SELECT cell_id, batch, assay, total AS library, 'shard_00' || shard_id || '.parquet' AS shard FROM sharded"))
def shard_scan(spark, d):
    like = virtual.cells(spark, d).select("cell_id", "batch", "assay", F.col("library").cast("double").alias("library"))
    return shards.read_shards(spark, _written_shards(spark, d), label="shard", like=like).withColumn("library", F.round("library", 2))


@query(_with(_CELLS, _SHARDED, select="SELECT cell_id, batch, total AS library, row_index, 'shard_00' || shard_id || '.parquet' AS shard FROM sharded WHERE row_index >= 100"))
def shard_source_scan(spark, d):
    """The data source over shards of different types, with each row's place over all shards."""
    return shard_source.load(spark, _written_shards(spark, d), _AS_READ).where("row_index >= 100").withColumn("library", F.round("library", 2))


@query(_with(_CELLS, _SHARDED, select="SELECT CAST(shard_id AS INTEGER) AS shard_id, MIN(row_index) AS start, MAX(row_index) + 1 AS stop FROM sharded GROUP BY 1"))
def shard_limits(spark, d):
    return shard_source.limits(spark, _written_shards(spark, d)).drop("shard")


@query(_with(_CELLS, _SHARDED, "w AS (SELECT o_orderkey AS pos, (o_orderkey * 31) % 700 AS row_index FROM orders)", select="SELECT pos, row_index, cell_id, batch FROM w JOIN sharded USING (row_index)"))
def shard_requests(spark, d):
    """Rows by their place, repeats included; places from 0 to 699 touch some of the shards only."""
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 31 % 700).alias("row_index"))
    return shard_source.request(spark, _written_shards(spark, d), wanted, "cell_id long, batch string").select("pos", "row_index", "cell_id", "batch")


@query("SELECT p_partkey, c_custkey FROM part JOIN customer ON c_acctbal >= p_retailprice AND c_acctbal < p_retailprice + p_size")
def range_join_brackets(spark, d):
    """Balances in the parts' price brackets, which overlap and differ in length."""
    brackets = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("start"), (F.col("p_retailprice") + F.col("p_size")).alias("stop"))
    return range_join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), brackets, "c_acctbal").select("p_partkey", "c_custkey")


@query(_with(_CELLS, select="SELECT CAST(cell_id AS VARCHAR) || '-' || substr('wxyz', CAST(cell_id % 4 + 1 AS INTEGER), 1) AS cell_id, lower(batch) AS batch, substr('wxyz', CAST(cell_id % 4 + 1 AS INTEGER), 1) AS key FROM cells"))
def shard_unique_names(spark, d):
    out = shards.read_shards(spark, _written_shards(spark, d), like=virtual.cells(spark, d).select("cell_id", "batch"), label="key", keys=list("wxyz"), index_unique="-", convert={"batch": F.lower})
    return out.select("cell_id", "batch", "key")


@query("SELECT * FROM (VALUES ('same', NULL), ('no assay', 'missing column assay'), ('extra', 'unknown column more'), ('order', 'columns in another order'), ('type', 'library has type float, not double'), ('values', 'assay has other categories')) v(shard, problem)")
def schema_checks(spark, d):
    ref = virtual.cells(spark, d).select("cell_id", "assay", F.col("library").cast("double").alias("library"))
    cases = {"same": ref, "no assay": ref.drop("assay"), "extra": ref.withColumn("more", F.lit(1)), "order": ref.select("assay", "cell_id", "library"), "type": ref.withColumn("library", F.col("library").cast("float")), "values": ref.withColumn("assay", F.lower("assay"))}
    rows = [(n, p) for n, c in cases.items() for p in shards.schema_problems(ref, c, categorical=["assay"]) or [None]]
    return spark.createDataFrame(rows, "shard string, problem string")


@query(_with(_CELLS, select="SELECT cell_id, tissue FROM cells QUALIFY row_number() OVER (ORDER BY cell_id) - 1 >= 100 AND row_number() OVER (ORDER BY cell_id) - 1 < 400"))
def row_range(spark, d):
    c = virtual.cells(spark, d).select("cell_id", "tissue")
    return sampling.ordinal(c, F.floor(F.col("cell_id") / 4096), [F.col("cell_id")]).where("pos >= 100 and pos < 400").drop("pos")


# fields -------------------------------------------------------------------------------------------


@query(_with(_CELLS, select="SELECT cell_id, round(ln(1 + library), 6) AS total, CAST(cell_id AS VARCHAR) AS name, lower(assay) AS assay, length(batch) AS batch_size FROM cells"))
def field_projection(spark, d):
    keys = {"total": Field("library", convert=fields.compose(F.log1p, r6)), "meta": {"name": Field("cell_id", convert=lambda c: c.cast("string")), "obs": {"assay": Field("packed", "assay", F.lower), "batch_size": Field("packed", "batch", lambda c: F.length(c).cast("long"))}}}
    c = virtual.cells(spark, d).withColumn("packed", F.struct("assay", "batch"))
    return fields.batch(c, keys, "cell_id").select("cell_id", "total", "meta.name", "meta.obs.assay", "meta.obs.batch_size")


@query(_with(_CELLS, select="SELECT cell_id, CAST(length(tissue) AS DOUBLE) AS size, CASE WHEN assay = 'F' THEN 1.0 ELSE 0.0 END AS is_f, tissue FROM cells"))
def collated_numeric(spark, d):
    c = virtual.cells(spark, d).select("cell_id", F.length("tissue").alias("size"), (F.col("assay") == "F").alias("is_f"), "tissue", F.lit("v1").alias("var_names"))
    out = fields.collate([c.where(F.col("assay") == x) for x in "FOP"], ["var_names"]).drop("var_names")
    return fields.numeric(out).withColumn("cell_id", F.col("cell_id").cast("long"))


@query(_with(_CELLS, select="SELECT cell_id, round(ln(library), 6) AS log_library FROM cells"))
def asserted_positive(spark, d):
    x = F.col("library").cast("double")
    return virtual.cells(spark, d).select("cell_id", r6(F.log(fields.required(x, x > 0, "library must be positive"))).alias("log_library"))


@query("SELECT v.label FROM (VALUES ('BUILDING'), ('no such type'), ('AUTOMOBILE'), ('nor this')) v(label) WHERE v.label NOT IN (SELECT c_mktsegment FROM customer)")
def unknown_labels(spark, d):
    asked = spark.createDataFrame([("BUILDING",), ("no such type",), ("AUTOMOBILE",), ("nor this",)], "label string")
    return asked.join(virtual.cells(spark, d).select(F.col("cell_type").alias("label")).distinct(), "label", "left_anti")


@query(_with(_CELLS, select="SELECT cell_id, CASE WHEN assay = 'P' AND library < 50000 THEN 'low' WHEN tissue IN ('NATION_1', 'NATION_2') THEN 'pair' ELSE assay END AS assay FROM cells"))
def conditional_update(spark, d):
    c = virtual.cells(spark, d)
    assay = F.when((F.col("assay") == "P") & (F.col("library") < 50000), "low").when(F.col("tissue").isin("NATION_1", "NATION_2"), "pair").otherwise(F.col("assay"))
    return c.select("cell_id", assay.alias("assay"))


@query(_with(*_MOM, select="SELECT gene_id, round(mean, 6) AS mean, round(var, 6) AS var FROM onepass"))
def renamed_columns(spark, d):
    o = _moments(spark, d).withColumnsRenamed({"gene_id": "id_g", "mean": "mean_g", "var": "var_g"})
    short = o.withColumnsRenamed({c: c.rsplit("_g", 1)[0] for c in o.columns if c.endswith("_g")})
    return short.select(F.col("id").alias("gene_id"), r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))


@query("SELECT c_custkey, unnest(CASE c_custkey % 4 WHEN 0 THEN ['error: z_score at 1 needs densify before it'] WHEN 1 THEN ['warning: filter_genes at 1 is cheaper before densify', 'warning: densify at 2 does nothing, the matrix is dense'] WHEN 3 THEN ['error: pflogpf at 0 needs densify before it', 'warning: duplicate at 2 is cheaper before densify'] ELSE [] END) AS message FROM customer")
def pipeline_lint(spark, d):
    """What is wrong with the order of each customer's transforms."""
    lines = [["normalize_total", "z_score"], ["densify", "filter_genes", "densify", "z_score"], ["filter_genes", "normalize_total", "log1p"], ["pflogpf", "densify", "duplicate"]]
    own = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in lines]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.explode(fields.lint(own)).alias("message"))


@query(_with(_GENES, "a AS (SELECT gene_id, var_name, row_number() OVER (ORDER BY gene_id) - 1 AS pos FROM genes WHERE gene_id % 5 = 0)", select="SELECT gene_id, var_name, CAST(row_number() OVER (ORDER BY var_name DESC) - 1 AS INTEGER) AS pos FROM a WHERE gene_id % 2 = 0"))
def pipeline_vocabulary(spark, d):
    """The genes that two filters in a row let through, the second in the order of its list: no value is read."""
    g = virtual.genes(spark, d)
    fifth = [r["var_name"] for r in g.where("gene_id % 5 = 0").collect()]
    first, _ = tr.filter_vocabulary(g, fifth, ordering=False)
    even = [r["var_name"] for r in g.where("gene_id % 2 = 0").orderBy(F.desc("var_name")).collect() if r["var_name"] in set(fifth)]
    return tr.filter_vocabulary(first, even)[0]


@query(_with(_MATRIX, select="SELECT cell_id, gene_id, round(ln(1 + x * 10000.0 / (SUM(x) OVER (PARTITION BY cell_id) + 1e-6)) * 2, 6) AS x FROM matrix"))
def nested_pipeline(spark, d):
    """A frozen pipeline as one step of another."""
    inner = fields.compose(tr.normalize_total, tr.log1p)
    return fields.compose(inner, lambda m: m.withColumn("x", r6(F.col("x") * 2)))(virtual.matrix(spark, d)).select("cell_id", "gene_id", "x")


# sinks read back ----------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(label AS VARCHAR) AS label, round(CAST(embedding[1] AS DOUBLE), 4) AS v0, round(CAST(embedding[2] AS DOUBLE), 4) AS v1, round(CAST(embedding[3] AS DOUBLE), 4) AS v2 FROM embeddings")
def prediction_roundtrip(spark, d):
    """Prediction parts as headerless csv.gz, read back by name and put beside the observations."""
    e, folder = table(spark, d, "embeddings"), shared.new_folder(spark, "predictions")
    for k in range(2):
        sinks.write_predictions(e.where(F.col("vec_id") % 2 == k), f"{folder}/batch_{k}", "embedding", "vec_id", 3, ["label"])
    back = sinks.read_predictions(spark, f"{folder}/batch_*", "vec_id long, label string, v0 double, v1 double, v2 double")
    return e.select("vec_id").join(back, "vec_id").select("vec_id", "label", *[F.round(c, 4).alias(c) for c in ("v0", "v1", "v2")])


@query(_with(*_MOM, _GENES, select="SELECT var_name, round(mean, 5) AS mean, round(var, 5) AS var, round(sqrt(greatest(var, 0)), 5) AS std FROM onepass JOIN genes USING (gene_id)"))
def stats_csv(spark, d):
    o = stats.onepass(_norm(spark, d), virtual.cells(spark, d)).join(virtual.genes(spark, d), "gene_id").select("var_name", "mean", "var", "std")
    folder = shared.new_folder(spark, "stats")
    sinks.write_stats(o, folder)
    back = spark.read.csv(folder, header=True, schema="var_name string, mean double, var double, std double")
    return back.select("var_name", *[F.round(c, 5).alias(c) for c in ("mean", "var", "std")])


@query(_with(_CELLS, _MATRIX, "mo AS (SELECT batch, gene_id, COUNT(*) OVER (PARTITION BY batch) AS genes FROM matrix JOIN cells USING (cell_id) GROUP BY 1, 2)", "nn AS (SELECT batch, COUNT(*) AS n FROM cells GROUP BY 1)", "v AS (SELECT batch, gene_id, (SUM(x * x) - SUM(x) * SUM(x) / any_value(n)) / (any_value(n) - 1) AS var FROM matrix JOIN cells USING (cell_id) JOIN nn USING (batch) GROUP BY 1, 2)", select="SELECT batch, COUNT(*) AS genes, CASE WHEN COUNT(*) >= 50 THEN TRUE END AS close FROM v WHERE var > 0 GROUP BY 1"))
def hvg_v3_interpolated(spark, d):
    """The trend from few fits on an interpolation tree against a fit at each gene: all within 0.1 of the logarithm, the mean within 0.02 (said from 50 genes on)."""
    mo = hvg.v3_moments(virtual.matrix(spark, d), virtual.cells(spark, d))
    few = hvg.loess_trend(mo, surface="interpolate").where("var > 0").select("batch", "gene_id", F.col("est").alias("few"))
    off = F.abs(F.col("few") - F.col("est"))
    return few.join(hvg.loess_trend(mo), ["batch", "gene_id"]).groupBy("batch").agg(F.count(F.lit(1)).alias("genes"), F.when(F.count(F.lit(1)) >= 50, (F.max(off) < 0.1) & (F.avg(off) < 0.02)).alias("close"))


@query(_with(_CELLS, _MATRIX, "mo AS (SELECT assay, gene_id FROM matrix JOIN cells USING (cell_id) WHERE cell_id % 50 < 2 GROUP BY 1, 2)", select="SELECT assay AS batch, 'missing' AS problem, (SELECT COUNT(DISTINCT gene_id) FROM mo) - COUNT(*) AS genes FROM mo GROUP BY 1 HAVING COUNT(*) < (SELECT COUNT(DISTINCT gene_id) FROM mo)"))
def moment_checks(spark, d):
    """Genes that a batch of few cells lacks, by assay."""
    c = virtual.cells(spark, d).where("cell_id % 50 < 2").withColumn("batch", F.col("assay"))
    return hvg.moment_problems(hvg.v3_moments(virtual.matrix(spark, d).join(c.select("cell_id"), "cell_id"), c), "batch")


@query()
def hvg_loess_files(spark, d):
    """Seurat v3 on LOESS for several numbers of genes: one pass pair, one table each, the flagged genes read back with what is known of them."""
    c = virtual.cells(spark, d)
    m = hvg.by_batch(virtual.matrix(spark, d), c)
    nv = hvg.v3_norm_var(m, c, hvg.v3_clip(hvg.loess_trend(hvg.v3_moments(m, c)))).persist()
    folder = shared.new_folder(spark, "hvg")
    sinks.write_top_genes({n: hvg.v3_rank(nv, n) for n in (10, 20)}, folder)
    nv.unpersist()
    back = [spark.read.csv(f"{folder}/top{n}_flagged.csv", header=True, inferSchema=True).withColumn("n_top", F.lit(n)) for n in (10, 20)]
    return back[0].unionByName(back[1]).join(virtual.genes(spark, d), "gene_id", "left").select("n_top", "gene_id", "var_name", "nbatches", "norm_var")


@query(_with(_CELLS, _GENES, *_MOM[1:], select="SELECT gene_id, round(var, 6) AS var, var_name, round(scale, 6) AS scale FROM genes LEFT JOIN onepass USING (gene_id)"))
def var_annotation(spark, d):
    known = _moments(spark, d)
    genes = virtual.genes(spark, d)
    extra = [c for c in genes.columns if c not in known.columns]
    return genes.select("gene_id").join(known, "gene_id", "left").join(genes.select("gene_id", *extra), "gene_id", "left").select("gene_id", r6(F.col("var")).alias("var"), "var_name", r6(F.col("scale")).alias("scale"))


@query(_with(_MATRIX, _LOGITS, _SOFT, "m AS (SELECT cell_id, SUM(k * p) AS mean, SUM(k * k * p) - SUM(k * p) * SUM(k * p) AS var FROM soft GROUP BY 1)", select="SELECT cell_id, round(power(cell_id % 4 - mean, 2), 4) AS mse, round(abs(cell_id % 4 - mean), 4) AS mae, round(power(cell_id % 4 - mean, 2) / (var + 0.1), 3) AS z_mse, round(abs(cell_id % 4 - mean) / sqrt(var + 0.1), 3) AS z_mae FROM m"))
def metric_csv(spark, d):
    """Errors of the predicted class number, plain and in deviations, written without a header and read back."""
    m = evaluate.predictive_moments(_soft(spark, d))
    off = F.col("cell_id") % 4 - F.col("mean")
    out = m.select("cell_id", F.round(off * off, 4).alias("mse"), F.round(F.abs(off), 4).alias("mae"), F.round(off * off / (F.col("var") + 0.1), 3).alias("z_mse"), F.round(F.abs(off) / F.sqrt(F.col("var") + 0.1), 3).alias("z_mae"))
    folder = shared.new_folder(spark, "metrics")
    out.write.csv(folder, header=False)
    return spark.read.csv(folder, schema="cell_id long, mse double, mae double, z_mse double, z_mae double")


@query(_with(_CELLS, _MATRIX, _NORM, select="SELECT 'counts' AS layer, assay, round(SUM(x), 3) AS total FROM matrix JOIN cells USING (cell_id) GROUP BY 2 UNION ALL SELECT 'norm', assay, round(SUM(x), 3) FROM norm JOIN cells USING (cell_id) GROUP BY 2"))
def layered_matrix(spark, d):
    folder = shared.new_folder(spark, "layers")
    sinks.write_matrix({"counts": virtual.matrix(spark, d), "norm": _norm(spark, d)}, virtual.cells(spark, d).select("cell_id", "assay"), folder)
    m, c = spark.read.parquet(f"{folder}/matrix"), spark.read.parquet(f"{folder}/cells")
    return m.join(c, "cell_id").groupBy("layer", "assay").agg(F.round(F.sum("x"), 3).alias("total"))


@query(_with(_EDGES, _CLO, select="SELECT ancestor, descendant, dist FROM clo", recursive=True))
def ontology_bundle(spark, d):
    clo, folder = _closure(spark, d), shared.new_folder(spark, "ontologies")
    sinks.write_ontologies({"place": clo, "upside": clo.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("descendant"), "dist")}, folder)
    back = spark.read.parquet(folder).where("ontology = 'upside'")
    return back.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("descendant"), "dist")


@query(_with(_MATRIX, select="SELECT gene_id, round(median(x) / 10, 6) AS scale, round(ln(1 + median(x)), 6) AS log_median FROM matrix WHERE x <> 0 GROUP BY 1"))
def state_as_input(spark, d):
    """Saved medians as the scale of another step."""
    folder = shared.new_folder(spark, "state")
    sinks.save_state(stats.nonzero_median(virtual.matrix(spark, d)), folder, model="nonzero_median", genes="all")
    both = sinks.load_fields(spark, f"{folder}/state", {"gene_id": Field("gene_id"), "scale": Field("median", convert=lambda c: r6(c / 10)), "log_median": Field("median", convert=fields.compose(F.log1p, r6))})
    assert sinks.load_state(spark, folder)[1] == {"model": "nonzero_median", "genes": "all"}
    return both


@query("SELECT n_name AS setting, CAST(n_regionkey AS VARCHAR) AS before, CASE WHEN n_nationkey % 6 <> 5 THEN CAST(n_regionkey + CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS now FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 6 = 5")
def resume_checks(spark, d):
    """Settings of nations that a later run has otherwise or not at all."""
    saved = table(spark, d, "nation").select(F.col("n_name").alias("setting"), "n_nationkey", F.col("n_regionkey").alias("value"))
    now = saved.where("n_nationkey % 6 != 5").withColumn("value", F.col("value") + F.when(F.col("n_nationkey") % 4 == 0, 1).otherwise(0))
    return sinks.resume_problems(saved.select("setting", "value"), now.select("setting", "value"))


# assignment ---------------------------------------------------------------------------------------

_PLACED = "o AS (SELECT o_orderkey AS cell_id, o_orderkey // 1000 AS shard FROM orders), s AS (SELECT cell_id, row_number() OVER (ORDER BY md5('5|shard|' || CAST(shard AS VARCHAR)), md5('5|row|' || CAST(cell_id AS VARCHAR))) - 1 AS slot FROM o)"


@query(_with(_PLACED, select="SELECT cell_id, CAST(slot % 2 AS BIGINT) AS replica, CAST((slot // 2) // 64 - 5 AS BIGINT) AS turn, CAST((((slot // 2) // 64) % 3 + 1) % 3 AS BIGINT) AS worker FROM s WHERE (slot // 2) // 64 >= 5 UNION ALL SELECT cell_id, CAST((slot + n) % 2 AS BIGINT), CAST(((slot + n) // 2) // 64 - 5 AS BIGINT), CAST(((((slot + n) // 2) // 64) % 3 + 1) % 3 AS BIGINT) FROM s, (SELECT COUNT(*) AS n FROM orders) WHERE slot + n < ceil(n / 2.0) * 2 AND ((slot + n) // 2) // 64 >= 5"))
def resumed_assignment(spark, d):
    s = _shuffled(spark, d)
    n = s.count()
    out = sampling.resumed(sampling.same_order(sampling.even_positions(s, n, 2, False), n, 2, 64, 3), 5, 3)
    return out.select("cell_id", *[F.col(c).cast("long").alias(c) for c in ("replica", "turn", "worker")])


@query("SELECT o_orderkey AS cell_id, CAST(17 + (o_orderkey // 1000) * 6 + (o_orderkey % 2) * 3 + o_orderkey % 3 AS BIGINT) AS seed FROM orders")
def worker_seeds(spark, d):
    """The seed under which each order is read: of its epoch, replica and worker."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("cell_id"), sampling.worker_seed(17, F.floor(k / 1000), k % 2, k % 3, 2, 3).cast("long").alias("seed"))


@query(_with(_CELLS, "b AS (SELECT batch, COUNT(*) AS n FROM cells GROUP BY 1)", select="SELECT batch, CAST(r AS INTEGER) AS replicas, CAST(ceil(ceil(n / CAST(r AS DOUBLE)) / 64.0) AS BIGINT) AS padded, CAST(ceil((n // r) / 64.0) AS BIGINT) AS dropped, CAST((n // r) // 64 AS BIGINT) AS whole FROM b, (VALUES (1), (2), (7)) v(r)"))
def batch_counts(spark, d):
    """Mini-batches of each batch's cells: with a padded tail, without it, and whole ones only."""
    n = virtual.cells(spark, d).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).withColumn("replicas", F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))))
    of = lambda *how: sampling.batches(F.col("n"), F.col("replicas"), 64, *how)
    return n.select("batch", "replicas", of().alias("padded"), of(True).alias("dropped"), of(True, True).alias("whole"))


# prompts ------------------------------------------------------------------------------------------

_UP = "(CAST('0x' || left(md5('{s}|' || cell_id || '|' || place), 8) AS UBIGINT) / 4294967296.0)"
_RT = "t AS (SELECT cell_id, place, gene_id + 2 AS token FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY x DESC, gene_id) AS place FROM matrix) WHERE place <= 6)"


@query(_with(_MATRIX, _RT, select=f"SELECT cell_id, CAST(place AS INTEGER) AS place, CASE WHEN {_UP.format(s=3)} < 0.15 THEN CASE WHEN {_UP.format(s=4)} < 0.8 THEN 1 WHEN {_UP.format(s=4)} < 0.9 THEN CAST(2 + floor({_UP.format(s=5)} * 50) AS BIGINT) ELSE token END ELSE token END AS masked, CASE WHEN {_UP.format(s=3)} < 0.15 THEN token ELSE -100 END AS label FROM t"))
def mlm_masked(spark, d):
    from ..operators import tokens

    t = tokens.rank_tokens(virtual.matrix(spark, d), 6).withColumn("token", F.col("token").cast("long"))
    return prompts.mlm_mask(t, 52, 0.15, 3).select("cell_id", "place", "masked", "label")


_TARGET = f"tt AS (SELECT cell_id, SUM(x) AS total FROM matrix GROUP BY 1), tg AS (SELECT cell_id, total, round_even(least(20, least(total, 80)) + (least(total, 80) - least(20, least(total, 80))) * least({_UC.format(s=11)} / 0.5, 1.0), 0) AS target FROM tt)"


@query(_with(_MATRIX, _TARGET, select="SELECT cell_id, total, target, round(target / total, 6) AS p FROM tg"))
def library_targets(spark, d):
    return prompts.library_target(virtual.matrix(spark, d), 20.0, 80.0, 0.5, 11).select("cell_id", "total", "target", r6(F.col("p")).alias("p"))


@query(_with(_MATRIX, _TARGET, f"u AS (SELECT cell_id, gene_id, x, target / total AS p, {_U.format(s=12)} AS u FROM matrix JOIN tg USING (cell_id))", "k AS (SELECT cell_id, gene_id, u, p, x, k, SUM(CASE WHEN p >= 1 THEN CASE WHEN k = x THEN 1.0 ELSE 0.0 END ELSE exp(lgamma(x + 1) - lgamma(k + 1) - lgamma(x - k + 1) + k * ln(p) + (x - k) * ln(CASE WHEN p < 1 THEN 1 - p ELSE 1 END)) END) OVER (PARTITION BY cell_id, gene_id ORDER BY k) AS cdf FROM (SELECT *, unnest(range(0, CAST(x AS BIGINT) + 1)) AS k FROM u))", select="SELECT cell_id, gene_id, CAST(coalesce(MIN(k) FILTER (cdf >= u), MAX(k)) AS DOUBLE) AS x FROM k GROUP BY 1, 2"))
def library_downsampled(spark, d):
    m = virtual.matrix(spark, d)
    return prompts.downsample(m, prompts.library_target(m, 20.0, 80.0, 0.5, 11), 12).select("cell_id", "gene_id", "x")


_PREFIX = "w AS (SELECT k, CASE WHEN k = 0 THEN 0.1 ELSE 1.0 / k END AS w FROM range(6) r(k)), cw AS (SELECT k, SUM(w) OVER (ORDER BY k) / (SELECT SUM(w) FROM w) AS c FROM w), px AS (SELECT cell_id, COUNT(*) FILTER (u >= c) AS prefix FROM (SELECT DISTINCT cell_id, " + _UC.format(s=13) + " AS u FROM matrix), cw GROUP BY 1)"


@query(_with(_MATRIX, _CTX, _PREFIX, select="SELECT cell_id, gene_id, CAST(least(prefix, 5) AS INTEGER) AS prefix, CASE WHEN place > least(prefix, 5) THEN 1 ELSE 0 END AS is_query, round(CASE WHEN place > least(prefix, 5) THEN 1.0 ELSE 0.0 END / greatest(SUM(CASE WHEN place > least(prefix, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id), 1), 6) AS weight FROM ctx JOIN px USING (cell_id)"))
def sampled_prefixes(spark, d):
    ctx = _ctx(spark, d)
    out = prompts.split_by_prefix(ctx, prompts.sampled_prefix(ctx.select("cell_id").distinct(), 5, 13))
    return out.select("cell_id", "gene_id", "prefix", "is_query", r6(F.col("weight")).alias("weight"))


_UF = "(CAST('0x' || left(md5('15|' || cell_id || '|' || field), 8) AS UBIGINT) / 4294967296.0)"


@query(_with(_CELLS, f"f AS (SELECT cell_id, field, row_number() OVER (PARTITION BY cell_id ORDER BY {_UF}, field) AS place FROM cells CROSS JOIN (VALUES ('assay'), ('batch'), ('tissue')) v(field))", select=f"SELECT cell_id, field, CASE WHEN place <= floor({_UC.format(s=16)} * 4) THEN 1 ELSE 0 END AS is_prompt FROM f"))
def metadata_prompts(spark, d):
    return prompts.metadata_prompt(virtual.cells(spark, d), ["assay", "batch", "tissue"], 15)


_UA = "greatest(CAST('0x' || left(md5('19|' || cell_id || '|' || ancestor), 8) AS UBIGINT) / 4294967296.0, 1e-10)"


@query(_with(_EDGES, _CLO, _CELLS, select=f"SELECT cell_id, ancestor AS term FROM (SELECT cell_id, ancestor, row_number() OVER (PARTITION BY cell_id ORDER BY ln(0.6) + dist * ln(0.4) - ln(-ln({_UA})) DESC, ancestor DESC) AS r FROM cells JOIN clo ON descendant = tissue) WHERE r = 1", recursive=True))
def ontology_resampled(spark, d):
    return prompts.ontology_resample(virtual.cells(spark, d), _closure(spark, d), "tissue", 0.6, 19)


@query(_with(_MATRIX, _CTX, select="SELECT cell_id, gene_id, CASE WHEN place <= 2 THEN round_even(x * 0.5, 0) ELSE 0 END AS value, COUNT(*) FILTER (place <= 2) OVER (PARTITION BY cell_id) AS prompt_size, COUNT(*) FILTER (place > 2) OVER (PARTITION BY cell_id) AS query_size, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY place <= 2, place) AS INTEGER) AS at FROM ctx"))
def test_prompt_tokens(spark, d):
    return prompts.test_tokens(_ctx(spark, d), 2, 0.5).select("cell_id", "gene_id", "value", "prompt_size", "query_size", "at")


@query(_with(_MATRIX, _CTX, "g AS (SELECT cell_id, gene_id, place, is_prompt, CASE WHEN is_prompt = 1 THEN round(ln(1 + x), 6) ELSE 0 END AS value FROM ctx CROSS JOIN (VALUES (0), (1)) v(is_prompt))", select="SELECT cell_id, gene_id, is_prompt, value, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY is_prompt, place) AS INTEGER) AS at FROM g"))
def generate_prompt_tokens(spark, d):
    return prompts.generate_tokens(_ctx(spark, d)).select("cell_id", "gene_id", "is_prompt", r6(F.col("value")).alias("value"), "at")


_VOCAB = {"assay": ["O", "F"], "batch": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "tissue": ["AFRICA", "ALL", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", *[f"NATION_{k}" for k in range(25)]]}
_CODES = "codes(field, slot, size, name, code) AS (VALUES " + ", ".join(f"('{f}', {k}, {len(v)}, '{n}', {c})" for k, (f, v) in enumerate(_VOCAB.items()) for c, n in enumerate(v)) + "), fields AS (SELECT DISTINCT field, slot, size FROM codes), named AS (SELECT cell_id, field, slot, size, CASE field WHEN 'assay' THEN assay WHEN 'batch' THEN batch ELSE tissue END AS name FROM cells CROSS JOIN fields), coded AS (SELECT n.*, c.code FROM named n LEFT JOIN codes c ON n.field = c.field AND n.name = c.name)"
_MEASURED = "gene_id % 4 <> ascii(assay) % 4"
_TOKENS = 'SELECT cell_id, "at", field, gene_id, value, token, is_prompt, is_query, label, round(weight, 6) AS weight FROM (SELECT * FROM gt UNION ALL SELECT * FROM mt)'
_GENE_ROWS = "gt AS (SELECT cell_id, CAST(place - 1 AS INTEGER) AS at, 'gene_value' AS field, gene_id, round(ln(1 + {x}) * p, 6) AS value, CAST(NULL AS INTEGER) AS token, CAST(p AS INTEGER) AS is_prompt, CAST(q AS INTEGER) AS is_query, CAST(least(greatest(x, 0), 29) AS BIGINT) AS label, q / greatest(SUM(q) OVER (PARTITION BY cell_id), 1.0) AS weight FROM g)"
_META_ROWS = "mt AS (SELECT cell_id, CAST(slot + 5 AS INTEGER) AS at, field, CAST(NULL AS BIGINT) AS gene_id, 0.0 AS value, CAST(CASE WHEN q = 1 THEN size ELSE coalesce({own}, 0) END AS INTEGER) AS token, CAST(p AS INTEGER) AS is_prompt, CAST(q AS INTEGER) AS is_query, CAST(coalesce(code, 0) AS BIGINT) AS label, CAST(q AS DOUBLE) AS weight FROM m)"


def _context(spark, d, genes: DataFrame, metadata: DataFrame) -> DataFrame:
    placed = genes.withColumn("at", (F.col("place") - 1).cast("int"))
    out = prompts.context(placed, metadata, 5)
    return out.withColumns({"value": r6(F.col("value")), "weight": r6(F.col("weight"))})


@query(_with(_EDGES, _CLO, _CELLS, _MATRIX, _CTX, _PREFIX, f"g AS (SELECT ctx.*, CASE WHEN {_MEASURED} AND place > least(prefix, 5) THEN 1 ELSE 0 END AS q, CASE WHEN {_MEASURED} AND place <= least(prefix, 5) THEN 1 ELSE 0 END AS p FROM ctx JOIN px USING (cell_id) JOIN cells USING (cell_id))", _GENE_ROWS.format(x="x"), _CODES, f"asked AS (SELECT cell_id, field, CASE WHEN row_number() OVER (PARTITION BY cell_id ORDER BY {_UF}, field) <= floor({_UC.format(s=16)} * 4) THEN 1 ELSE 0 END AS a FROM named)", f"re AS (SELECT cell_id, ancestor AS name FROM (SELECT cell_id, ancestor, row_number() OVER (PARTITION BY cell_id ORDER BY ln(0.6) + dist * ln(0.4) - ln(-ln({_UA})) DESC, ancestor DESC) AS r FROM cells JOIN clo ON descendant = tissue) WHERE r = 1)", "m AS (SELECT c.*, CASE WHEN c.code IS NOT NULL AND a = 0 THEN 1 ELSE 0 END AS q, CASE WHEN c.code IS NOT NULL AND a = 1 THEN 1 ELSE 0 END AS p, x.code AS coarser FROM coded c JOIN asked ON asked.cell_id = c.cell_id AND asked.field = c.field LEFT JOIN re ON re.cell_id = c.cell_id AND c.field = 'tissue' LEFT JOIN codes x ON x.field = 'tissue' AND x.name = re.name AND c.field = 'tissue')", _META_ROWS.format(own="coalesce(coarser, code)"), select=_TOKENS, recursive=True))
def gpt_train_tokens(spark, d):
    """Gene and metadata tokens to train on: sampled prefixes, genes that the assay measures, sampled metadata prompts with tissues coarsened along the ontology."""
    cells, ctx = virtual.cells(spark, d), _ctx(spark, d)
    split = prompts.split_by_prefix(ctx, prompts.sampled_prefix(ctx.select("cell_id").distinct(), 5, 13))
    kinds = cells.select("assay").distinct().crossJoin(F.broadcast(virtual.genes(spark, d).select("gene_id")))
    genes = tokens.values_labels(prompts.measured_only(split, kinds.where(F.col("gene_id") % 4 != F.ascii("assay") % 4), cells, "assay"), 30)
    asked = prompts.metadata_prompt(cells, list(_VOCAB), 15)
    coarser = prompts.ontology_resample(cells, _closure(spark, d), "tissue", 0.6, 19).select("cell_id", F.lit("tissue").alias("field"), F.col("term").alias("name"))
    return _context(spark, d, genes, prompts.metadata_tokens(cells, _VOCAB, asked, coarser))


@query(_with(_CELLS, _MATRIX, _CTX, "tot AS (SELECT cell_id, SUM(x) AS total FROM matrix GROUP BY 1)", "g AS (SELECT ctx.*, total, CASE WHEN place > 3 THEN 1 ELSE 0 END AS q, CASE WHEN place > 3 THEN 0 ELSE 1 END AS p FROM ctx JOIN tot USING (cell_id))", _GENE_ROWS.format(x="round_even(x * least(total, 50.0) / total, 0)"), _CODES, "m AS (SELECT *, CASE WHEN code IS NULL THEN 1 ELSE 0 END AS q, CASE WHEN code IS NULL THEN 0 ELSE 1 END AS p FROM (SELECT * REPLACE (CASE WHEN field = 'tissue' AND cell_id % 5 = 0 THEN NULL ELSE code END AS code) FROM coded))", _META_ROWS.format(own="code"), select=_TOKENS))
def gpt_predict_tokens(spark, d):
    """Tokens to predict from: counts scaled to a library of 50 at most; fields without a known name are asked for."""
    cells = virtual.cells(spark, d).withColumn("tissue", F.when(F.col("cell_id") % 5 != 0, F.col("tissue")))
    total = virtual.matrix(spark, d).groupBy("cell_id").agg(F.sum("x").alias("total"))
    split = tokens.prompt_query(_ctx(spark, d), 3).join(total, "cell_id")
    genes = tokens.values_labels(split, 30).withColumn("value", F.log1p(F.bround(F.col("x") * F.least("total", F.lit(50.0)) / F.col("total"))) * F.col("is_prompt"))
    return _context(spark, d, genes, prompts.metadata_tokens(cells, _VOCAB, predict=True))


@query(_with(_CELLS, _MATRIX, _CTX, "g AS (SELECT * REPLACE (row_number() OVER (PARTITION BY cell_id ORDER BY place <= 2, place) AS place), CASE WHEN place > 2 THEN 1 ELSE 0 END AS q, CASE WHEN place > 2 THEN 0 ELSE 1 END AS p FROM ctx)", _GENE_ROWS.format(x="round_even(x * 0.5, 0)"), _CODES, "m AS (SELECT *, CASE WHEN code IS NOT NULL AND field <> 'assay' THEN 1 ELSE 0 END AS q, CASE WHEN code IS NOT NULL AND field = 'assay' THEN 1 ELSE 0 END AS p FROM coded)", _META_ROWS.format(own="code"), select=_TOKENS))
def gpt_test_tokens(spark, d):
    """Tokens to test with: queries first, prompts alone downsampled, the assay as the only metadata prompt."""
    ctx = prompts.test_tokens(_ctx(spark, d), 2, 0.5).withColumn("place", F.col("at"))
    split = ctx.withColumn("is_query", 1 - F.col("is_prompt")).withColumn("weight", F.col("is_query") / F.greatest("query_size", F.lit(1)))
    genes = tokens.values_labels(split.drop("at"), 30).withColumn("value", F.log1p(F.bround(F.col("x") * 0.5)) * F.col("is_prompt"))
    return _context(spark, d, genes, prompts.metadata_tokens(virtual.cells(spark, d), _VOCAB, ["assay"]))


@query(_with(_CELLS, _MATRIX, _CTX, _CODES, "t AS (SELECT cell_id, CAST(place - 1 AS INTEGER) AS place, CASE WHEN place > 2 THEN 0 ELSE 1 END AS p FROM ctx UNION ALL SELECT cell_id, CAST(slot + 5 AS INTEGER), CASE WHEN code IS NOT NULL AND field = 'assay' THEN 1 ELSE 0 END FROM coded)", select="SELECT a.cell_id, a.place AS at, COUNT(*) AS keys, CAST(SUM(b.place) AS BIGINT) AS places FROM t a JOIN t b ON a.cell_id = b.cell_id AND (b.p = 1 OR a.place = b.place) GROUP BY 1, 2"))
def gpt_attention_keys(spark, d):
    """How many places each token attends to, and their sum: one row a token with its list, not a row a pair."""
    genes = tokens.values_labels(tokens.prompt_query(_ctx(spark, d), 2), 30)
    out = prompts.attends(_context(spark, d, genes, prompts.metadata_tokens(virtual.cells(spark, d), _VOCAB, ["assay"])))
    return out.select("cell_id", "at", F.size("keys").cast("long").alias("keys"), F.aggregate("keys", F.lit(0).cast("long"), lambda acc, k: acc + k).alias("places"))


@query(_with(_MATRIX, select="SELECT cell_id, gene_id, round(lgamma(x + 2.5) - lgamma(2.5) - lgamma(x + 1) + 2.5 * ln(2.5 / (2.5 + mu)) + x * ln(mu / (2.5 + mu)), 6) AS log_prob FROM (SELECT *, AVG(x) OVER (PARTITION BY cell_id) AS mu FROM matrix)"))
def nb_log_probs(spark, d):
    m = virtual.matrix(spark, d).withColumn("mu", F.avg("x").over(Window.partitionBy("cell_id")))
    return m.select("cell_id", "gene_id", r6(prompts.nb_log_prob(F.col("x"), F.col("mu"), F.lit(2.5))).alias("log_prob"))


@query(_with(_MATRIX, f"u AS (SELECT cell_id, gene_id, x AS mu, {_U.format(s=21)} AS u FROM matrix)", "k AS (SELECT cell_id, gene_id, u, k, SUM(exp(lgamma(k + 4.0) - lgamma(4.0) - lgamma(k + 1.0) + 4.0 * ln(4.0 / (4.0 + mu)) + k * ln(mu / (4.0 + mu)))) OVER (PARTITION BY cell_id, gene_id ORDER BY k) AS cdf FROM (SELECT *, unnest(range(0, CAST(12 * mu AS BIGINT) + 80)) AS k FROM u))", select="SELECT cell_id, gene_id, MIN(k) FILTER (cdf >= u) AS x FROM k GROUP BY 1, 2"))
def nb_sampled(spark, d):
    return virtual.matrix(spark, d).select("cell_id", "gene_id", prompts.nb_sample(F.col("x"), F.lit(4.0), tr.uniform(21, "cell_id", "gene_id")).alias("x"))


@query("WITH e AS (SELECT vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(v / greatest(sqrt(SUM(v * v) OVER (PARTITION BY vec_id)), 1e-12), 6) AS v FROM e")
def l2_normalised(spark, d):
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, v: acc + v))
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda v: v.cast("double") / F.greatest(norm, F.lit(1e-12)))).alias("dim", "v"))
    return e.select("vec_id", "dim", r6(F.col("v")).alias("v"))


# fits and scores ----------------------------------------------------------------------------------


@query()
def svd_merged(spark, d):
    """Singular values of incremental fits that are merged level by level."""
    f = fits.merged_svd(table(spark, d, "embeddings").repartition(8, "vec_id"), 32).first()
    values = np.linalg.norm(np.array([list(x) for x in f["parts"]]), axis=1)
    return spark.createDataFrame([(k + 1, float(v), float(v * v / f["n"])) for k, v in enumerate(values)], "pc int, singular double, variance double")


@query()
def scaling_curves(spark, d):
    """Per shipping mode a + b q^-c for the mean price of a unit by quantity, the best of several starts."""
    li = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("double").alias("x")).agg(F.avg(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("y"))
    return fits.fitted_curves(li, "l_returnflag", lambda x, a, b, c: a + b * np.power(x, -c), [[1000.0, 100.0, 0.5], [2000.0, 1.0, 1.0], [500.0, -100.0, 0.1]])


@query()
def validation_classifier(spark, d):
    e = table(spark, d, "embeddings")
    return fits.validation_accuracy(e.where("vec_id % 5 != 0"), e.where("vec_id % 5 = 0"))


@query("WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT label, round(sqrt(SUM(v * v)), 6) AS l2, round(AVG(abs(v)), 6) AS l1 FROM e GROUP BY 1")
def group_norms(spark, d):
    return fits.norms(table(spark, d, "embeddings"), "label").select("label", r6(F.col("l2")).alias("l2"), r6(F.col("l1")).alias("l1"))


_W1 = "w1 AS (SELECT gene_id, CAST(k AS INTEGER) AS k, sin(gene_id + 3.0 * k) / 10 AS w FROM genes CROSS JOIN range(5) r(k)), bb AS (SELECT DISTINCT batch, CAST(k AS INTEGER) AS k, cos(length(batch) + 1.0 * k) AS s FROM cells CROSS JOIN range(5) r(k))"
_VAE = "h0 AS (SELECT cell_id, k, SUM(x * w) AS v FROM norm JOIN w1 USING (gene_id) GROUP BY 1, 2), h1 AS (SELECT h0.cell_id, k, v + s AS v FROM h0 JOIN cells USING (cell_id) JOIN bb USING (batch, k)), h2 AS (SELECT cell_id, k, greatest((v - AVG(v) OVER (PARTITION BY cell_id)) / sqrt(var_pop(v) OVER (PARTITION BY cell_id) + 1e-5), 0) AS v FROM h1), z AS (SELECT cell_id, CAST(j AS INTEGER) AS k, SUM(v * sin(1.0 + k + 2 * j)) AS v FROM h2 CROSS JOIN range(2) r(j) GROUP BY 1, 2)"


def _network(spark, d, m, log_input: bool) -> tuple[DataFrame, networks.Network]:
    """A fixed network over all genes, and the cells as sparse rows with their batch's code: one layer with a bias of each batch, normalised and rectified, then linear heads."""
    cells = virtual.cells(spark, d)
    genes = [r[0] for r in virtual.genes(spark, d).select("gene_id").orderBy("gene_id").collect()]
    batches = [r[0] for r in cells.select("batch").distinct().orderBy("batch").collect()]
    g, k, j, long = np.array(genes, float), np.arange(5.0), np.arange(2.0), np.array([len(b) for b in batches], float)
    first = networks.Layer(np.sin(g[:, None] + 3 * k) / 10, shift=np.cos(long[:, None] + k), norm="layer", activation="relu")
    net = networks.Network(
        genes, encoder=[first], mean=networks.Layer(np.sin(1 + k[:, None] + 2 * j)), log_var=networks.Layer(np.cos(0.3 * k[:, None] + j) / 4),
        scale=networks.Layer(np.cos(g + j[:, None]) / 5, bias=np.sin(g * 0.5), activation="softmax"),
        theta=np.exp(np.sin(g + long[:, None])), log_input=log_input,
    )
    return networks.coded(lowrank.sparse_rows(m, genes), cells, batches, "batch"), net


@query(_with(_CELLS, _GENES, _MATRIX, _NORM, _W1, _VAE, select="SELECT cell_id, k, round(v, 5) AS v FROM z"))
def vae_latent(spark, d):
    out = networks.encode(*_network(spark, d, _norm(spark, d), False))
    return out.select("cell_id", F.posexplode("mean").alias("k", "v")).select("cell_id", "k", F.round("v", 5).alias("v"))


@query(_with(_CELLS, _GENES, _MATRIX, _NORM, _W1, _VAE, "o AS (SELECT cell_id, gene_id, SUM(v * cos(gene_id + 1.0 * k)) / 5 + sin(gene_id * 0.5) AS e FROM z CROSS JOIN genes WHERE gene_id % 2 = 0 GROUP BY 1, 2)", "p AS (SELECT cell_id, gene_id, exp(e - mx) / SUM(exp(e - mx)) OVER (PARTITION BY cell_id) AS p FROM (SELECT *, MAX(e) OVER (PARTITION BY cell_id) AS mx FROM o))", select="SELECT gene_id, round(AVG(p * 10000), 4) AS mean FROM p GROUP BY 1"))
def vae_reconstruct(spark, d):
    """Mean over all cells of what a fixed decoder gives for a subset of genes, at a library of 10,000."""
    rows, net = _network(spark, d, _norm(spark, d), False)
    even = [k for k, g in enumerate(net.genes) if g % 2 == 0]
    net.scale = networks.Layer(net.scale.weight[:, even], bias=net.scale.bias[even], activation="softmax")
    names = spark.createDataFrame([(i, net.genes[k]) for i, k in enumerate(even)], "at int, gene_id long")
    net.genes = [net.genes[k] for k in even]
    return networks.expected_by_gene(rows, net, library=10_000.0).join(F.broadcast(names), "at").select("gene_id", F.round(F.col("s") / F.col("n"), 4).alias("mean"))


_COUNTED = "norm AS (SELECT cell_id, gene_id, ln(1 + x) AS x FROM matrix)"
_HEADS = "lv AS (SELECT cell_id, CAST(j AS INTEGER) AS k, exp(SUM(v * cos(0.3 * k + j) / 4)) + 1e-4 AS v FROM h2 CROSS JOIN range(2) r(j) GROUP BY 1, 2), heads AS (SELECT cell_id, k, z.v AS mean, lv.v AS var FROM z JOIN lv USING (cell_id, k))"


@query(_with(_CELLS, _GENES, _MATRIX, _COUNTED, _W1, _VAE, _HEADS, "o AS (SELECT cell_id, gene_id, SUM(mean * cos(gene_id + 1.0 * k)) / 5 + sin(gene_id * 0.5) AS e FROM heads CROSS JOIN genes GROUP BY 1, 2)", "t AS (SELECT cell_id, SUM(x) AS total FROM matrix GROUP BY 1)", "p AS (SELECT o.cell_id, o.gene_id, total * exp(e) / SUM(exp(e)) OVER (PARTITION BY o.cell_id) + 1e-10 AS mu, exp(sin(o.gene_id + length(batch) * 1.0)) + 1e-10 AS theta, coalesce(x, 0) AS x FROM o JOIN t USING (cell_id) JOIN cells USING (cell_id) LEFT JOIN matrix m ON m.cell_id = o.cell_id AND m.gene_id = o.gene_id)", "rec AS (SELECT cell_id, -SUM(lgamma(x + theta) - lgamma(theta) - lgamma(x + 1) + theta * (ln(theta) - ln(theta + mu)) + x * (ln(mu) - ln(theta + mu))) AS reconstruction FROM p GROUP BY 1)", "k AS (SELECT cell_id, SUM(var + mean * mean - 1 - ln(var)) / 2 AS kl FROM heads GROUP BY 1)", select="SELECT cell_id, round(reconstruction, 4) AS reconstruction, round(kl, 4) AS kl FROM rec JOIN k USING (cell_id)"))
def vae_losses(spark, d):
    """Each cell's negative binomial reconstruction over all genes, with dispersion by batch and the cell's own library, and its divergence from the prior."""
    out = networks.losses(*_network(spark, d, virtual.matrix(spark, d), True))
    return out.select("cell_id", F.round("reconstruction", 4).alias("reconstruction"), F.round("kl", 4).alias("kl"))


@query(_with(_CELLS, _GENES, _MATRIX, _COUNTED, _W1, _VAE, _HEADS, "u AS (SELECT *, CAST('0x' || left(md5((31 + 2 * k) || '|' || cell_id), 8) AS UBIGINT) / 4294967296.0 AS a, CAST('0x' || left(md5((32 + 2 * k) || '|' || cell_id), 8) AS UBIGINT) / 4294967296.0 AS b FROM heads)", select="SELECT cell_id, k, round(mean + sqrt(var) * sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b), 5) AS v FROM u"))
def vae_latent_sampled(spark, d):
    out = networks.encode(*_network(spark, d, virtual.matrix(spark, d), True), samples=31)
    return out.select("cell_id", F.posexplode("sample").alias("k", "v")).select("cell_id", "k", F.round("v", 5).alias("v"))


def _view(copy: int, seed: int) -> str:
    return f"SELECT {copy} AS copy, cell_id, gene_id, CASE WHEN {_UC.format(s=seed)} < 0.9 AND {_U.format(s=seed + 2)} < 0.1 + 0.2 * {_U.format(s=seed + 1)} THEN 0 ELSE x END AS x FROM norm"


@query(_with(_CELLS, _MATRIX, _NORM, f"views AS ({_view(0, 41)} UNION ALL {_view(1, 51)})", "h0 AS (SELECT copy, cell_id, k, SUM(x * sin(gene_id + 3.0 * k) / 10) AS v FROM views CROSS JOIN range(5) r(k) GROUP BY 1, 2, 3)", "h1 AS (SELECT copy, cell_id, k, greatest((coalesce(v, 0) - 0.1 * k) / sqrt(1 + 0.1 * k + 1e-5), 0) AS v FROM (SELECT cell_id, copy, k FROM cells CROSS JOIN range(2) c(copy) CROSS JOIN range(5) r(k)) LEFT JOIN h0 USING (copy, cell_id, k))", "z0 AS (SELECT copy, cell_id, j, SUM(v * cos(k + 2.0 * j)) + 0.2 + 0.1 * j AS v FROM h1 CROSS JOIN range(3) r(j) GROUP BY 1, 2, 3)", "z AS (SELECT cell_id // 64 AS batch, copy, cell_id, j, v / greatest(sqrt(SUM(v * v) OVER (PARTITION BY copy, cell_id)), 1e-12) AS v FROM z0)", "s AS (SELECT a.batch, a.copy AS ca, a.cell_id AS ia, b.copy AS cb, b.cell_id AS ib, SUM(a.v * b.v) / 0.5 AS s FROM z a JOIN z b ON a.batch = b.batch AND a.j = b.j AND (a.copy <> b.copy OR a.cell_id <> b.cell_id) GROUP BY ALL)", "l AS (SELECT batch, ia, ca, ln(SUM(exp(s))) - SUM(CASE WHEN ia = ib THEN s ELSE 0 END) AS l FROM s GROUP BY 1, 2, 3)", select="SELECT batch, COUNT(*) AS n, round(AVG(l), 5) AS loss FROM l GROUP BY 1"))
def contrastive_losses(spark, d):
    """Two views of each cell with values dropped, through a network with stored batch norms; each mini-batch's loss."""
    m, cells = _norm(spark, d), virtual.cells(spark, d)
    genes = [r[0] for r in virtual.genes(spark, d).select("gene_id").orderBy("gene_id").collect()]
    k, j = np.arange(5.0), np.arange(3.0)
    first = networks.Layer(np.sin(np.array(genes, float)[:, None] + 3 * k) / 10, norm="batch", stored=(0.1 * k, 1 + 0.1 * k), activation="relu")
    net = networks.Network(genes, encoder=[first], mean=networks.Layer(np.cos(k[:, None] + 2 * j), bias=0.2 + 0.1 * j), log_input=False)
    unit = lambda c: F.transform(c, lambda v: v / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, u: acc + u * u)), F.lit(1e-12)))
    views = None
    for copy, seed in enumerate((41, 51)):
        rows = lowrank.sparse_rows(tr.dropout(m, 0.1, 0.3, 0.9, seed), genes, cells).withColumn("code", F.lit(-1))
        own = networks.encode(rows, net).select(F.floor(F.col("cell_id") / 64).alias("batch"), F.col("cell_id").alias("id"), F.lit(copy).alias("copy"), unit(F.col("mean")).alias("z"))
        views = own if views is None else views.unionByName(own)
    return evaluate.nt_xent_batches(views, 0.5).select("batch", "n", F.round("loss", 5).alias("loss"))


_WIDTHS = "wd AS (SELECT * FROM (VALUES (2), (4), (8)) w(width) CROSS JOIN (VALUES (0), (1)) s(seed)), hh AS (SELECT width, seed, cell_id, k, SUM(x * sin(gene_id + 3.0 * k + seed)) / width AS v FROM matrix CROSS JOIN wd CROSS JOIN range(8) r(k) WHERE k < width GROUP BY width, seed, cell_id, k), full_h AS (SELECT width, seed, c.cell_id, k, coalesce(v, 0) AS v FROM cells c CROSS JOIN wd CROSS JOIN range(8) r(k) LEFT JOIN hh USING (width, seed, cell_id, k) WHERE k < width), zz AS (SELECT width, seed, cell_id, j, SUM(greatest(v, 0) * cos(k + 2.0 * j + seed)) AS v FROM full_h CROSS JOIN range(2) r(j) GROUP BY width, seed, cell_id, j)"


@query(_with(_CELLS, _MATRIX, _WIDTHS, select="SELECT CAST(width AS INTEGER) AS width, CAST(seed AS INTEGER) AS seed, 'encoder 0' AS layer, COUNT(*) AS n, round(AVG(greatest(v, 0)), 5) AS l1 FROM full_h GROUP BY 1, 2 UNION ALL SELECT CAST(width AS INTEGER), CAST(seed AS INTEGER), 'latent', COUNT(*), round(AVG(abs(v)), 5) FROM zz GROUP BY 1, 2"))
def coordinate_check(spark, d):
    """How large a network's layers are at several widths and seeds: sizes that stay as the width grows."""
    m, cells = virtual.matrix(spark, d), virtual.cells(spark, d)
    genes = [r[0] for r in virtual.genes(spark, d).select("gene_id").orderBy("gene_id").collect()]
    rows = lowrank.sparse_rows(m, genes, cells).withColumn("code", F.lit(-1))
    out = None
    for width in (2, 4, 8):
        for seed in (0, 1):
            k = np.arange(float(width))
            first = networks.Layer(np.sin(np.array(genes, float)[:, None] + 3 * k + seed) / width, activation="relu")
            net = networks.Network(genes, encoder=[first], mean=networks.Layer(np.cos(k[:, None] + 2 * np.arange(2.0) + seed)), log_input=False)
            own = networks.layer_sizes(rows, net).select(F.lit(width).alias("width"), F.lit(seed).alias("seed"), "layer", "n", F.round("l1", 5).alias("l1"))
            out = own if out is None else out.unionByName(own)
    return out


@query("WITH n AS (SELECT COUNT(*) AS n FROM embeddings), r AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings), w AS (SELECT o_orderkey AS pos, (o_orderkey * 37) % n AS row FROM orders, n) SELECT pos, row, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INTEGER) AS size FROM w JOIN r USING (row)")
def nested_rows(spark, d):
    """Rows of a nest of arrays and labels by number, repeats included."""
    e = table(spark, d, "embeddings")
    leaf = lambda c: e.select(F.col("vec_id").alias("row"), c.alias("value"))
    tree = fields.nest({"x": {"vector": leaf(F.col("embedding")), "size": leaf(F.size("embedding"))}, "label": leaf(F.col("label"))})
    n = tree.count()
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 37 % n).alias("row"))
    return shards.gather_rows(tree, "row", wanted).select("pos", "row", "label", r6(F.col("x.vector")[0]).alias("first"), F.col("x.size").alias("size"))


@query("SELECT round(ln(1 + abs(s_acctbal)), 6) AS value FROM supplier")
def file_field(spark, d):
    """One converted column of a file."""
    folder = shared.new_folder(spark, "field")
    virtual.genes(spark, d).write.csv(folder, header=True)
    return sinks.load_field(spark, folder, Field("scale", convert=fields.compose(lambda c: c.cast("double"), F.abs, F.log1p, r6)), "csv", header=True)


@query("SELECT l_returnflag AS part, round(SUM(l_extendedprice * l_discount) / COUNT(*), 4) AS loss FROM lineitem GROUP BY 1 UNION ALL SELECT 'all', round(SUM(l_extendedprice * l_discount) / COUNT(*), 4) FROM lineitem")
def mean_losses(spark, d):
    """Exact means from sums and counts of batches, per part and over all."""
    loss = (F.col("l_extendedprice") * F.col("l_discount")).cast("double")
    per = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(loss).alias("s"), F.count(F.lit(1)).alias("n"))
    mean = F.round(F.sum("s") / F.sum("n"), 4).alias("loss")
    return per.groupBy(F.col("l_returnflag").alias("part")).agg(mean).unionByName(per.agg(F.lit("all").alias("part"), mean))


@query(_with(_EDGES, _CLO, _CELLS, "pr AS (SELECT tissue AS truth, 'NATION_' || (cell_id % 25) AS guess FROM cells)", "dd AS (SELECT x.descendant AS truth, y.descendant AS guess, MIN(x.dist + y.dist) AS dist FROM clo x JOIN clo y ON x.ancestor = y.ancestor GROUP BY 1, 2)", select="SELECT round(AVG(CASE WHEN truth = guess THEN 1.0 ELSE 0 END), 6) AS accuracy, round(AVG(dist) FILTER (truth <> guess), 6) AS error_distance FROM pr LEFT JOIN dd USING (truth, guess)", recursive=True))
def mean_error_distance(spark, d):
    pr = virtual.cells(spark, d).select(F.col("tissue").alias("a"), F.concat(F.lit("NATION_"), F.col("cell_id") % 25).alias("b"))
    j = pr.join(ontology.distances(virtual.edges(spark, d)), ["a", "b"], "left")
    return j.agg(r6(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("accuracy"), r6(F.avg(F.when(F.col("a") != F.col("b"), F.col("dist")))).alias("error_distance"))


# ontology -----------------------------------------------------------------------------------------


@query("SELECT replace(n_name, '_', ':') AS term, split_part(replace(n_name, '_', ':'), ':', 1) AS prefix FROM nation UNION ALL SELECT 'unknown', 'unknown'")
def term_names(spark, d):
    name = F.replace(F.col("n_name"), F.lit("_"), F.lit(":"))
    known = table(spark, d, "nation").select(name.alias("term"))
    return known.unionByName(spark.createDataFrame([("unknown",)], "term string")).withColumn("prefix", F.split_part("term", F.lit(":"), F.lit(1)))


# suppliers under their nation and under a band of their balance, nations under regions; every tenth supplier has two labels
_GRAPH = """terms AS (SELECT 'T:all' AS term, 'all' AS label UNION ALL SELECT 'T:r' || r_regionkey, r_name FROM region UNION ALL SELECT 'T:n' || n_nationkey, n_name FROM nation
 UNION ALL SELECT DISTINCT 'T:b' || CAST(floor(s_acctbal / 2000) AS INTEGER), 'band ' || CAST(floor(s_acctbal / 2000) AS INTEGER) FROM supplier UNION ALL SELECT 'T:s' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 10 <> 3),
 edges AS (SELECT 'T:all' AS parent, 'T:r' || r_regionkey AS child FROM region UNION ALL SELECT 'T:r' || n_regionkey, 'T:n' || n_nationkey FROM nation UNION ALL SELECT DISTINCT 'T:all', 'T:b' || CAST(floor(s_acctbal / 2000) AS INTEGER) FROM supplier
 UNION ALL SELECT 'T:n' || s_nationkey, 'T:s' || s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3 UNION ALL SELECT 'T:b' || CAST(floor(s_acctbal / 2000) AS INTEGER), 'T:s' || s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3)"""


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """That graph written as OBO text and read again."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(f"T:{p}"), F.col(c).cast("string"))
    band = F.floor(F.col("s_acctbal") / 2000).cast("string")
    two = s.where("s_suppkey % 10 = 3").select(name("s", "s_suppkey").alias("term"), F.lower("s_name").alias("label"))
    terms = spark.createDataFrame([("T:all", "all")], "term string, label string")
    for part in (r.select(name("r", "r_regionkey").alias("term"), F.col("r_name").alias("label")), n.select(name("n", "n_nationkey").alias("term"), F.col("n_name").alias("label")), s.select(F.concat(F.lit("T:b"), band).alias("term"), F.concat(F.lit("band "), band).alias("label")).distinct(), s.select(name("s", "s_suppkey").alias("term"), F.col("s_name").alias("label")), two):
        terms = terms.unionByName(part)
    edges = r.select(F.lit("T:all").alias("parent"), name("r", "r_regionkey").alias("child"))
    for part in (n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")), s.select(F.lit("T:all").alias("parent"), F.concat(F.lit("T:b"), band).alias("child")).distinct(), s.select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("child")), s.select(F.concat(F.lit("T:b"), band).alias("parent"), name("s", "s_suppkey").alias("child"))):
        edges = edges.unionByName(part)
    folder = shared.new_folder(spark, "obo")
    ontologies.write_obo(terms, edges, folder)
    return ontologies.read_obo(spark, folder, "T:")


@query(_with(_GRAPH, select="SELECT term, label, COUNT(parent) AS parents FROM terms LEFT JOIN edges ON child = term GROUP BY 1, 2"))
def ontology_text_terms(spark, d):
    terms, edges = _graph(spark, d)
    n = edges.groupBy(F.col("child").alias("term")).agg(F.count(F.lit(1)).alias("parents"))
    return terms.join(n, "term", "left").select("term", "label", F.coalesce("parents", F.lit(0)).alias("parents"))


@query(_with(_GRAPH, "walk AS (SELECT term AS ancestor, term AS descendant, 0 AS dist FROM terms UNION SELECT ancestor, child, dist + 1 FROM walk JOIN edges ON descendant = parent)", select="SELECT ancestor, descendant, MIN(dist) AS dist FROM walk GROUP BY 1, 2", recursive=True))
def graph_closure(spark, d):
    """Ancestors over two parents a term."""
    return ontology.closure(_graph(spark, d)[1])


@query(_with(_GRAPH, "links AS (SELECT parent AS p, child AS c FROM edges UNION SELECT child, parent FROM edges)", "walk AS (SELECT term AS a, term AS b, 0 AS dist FROM terms UNION SELECT a, c, dist + 1 FROM walk JOIN links ON b = p WHERE dist < 6)", select="SELECT a, b, CAST(MIN(dist) AS INTEGER) AS dist FROM walk WHERE a IN (SELECT term FROM terms WHERE term NOT LIKE 'T:s%' OR term LIKE '%7') GROUP BY 1, 2 UNION ALL SELECT 'unknown', 'unknown', 0", recursive=True))
def graph_distances(spark, d):
    """Fewest steps between all terms and those of groups and some suppliers, and a term that is near none."""
    return ontology.distances(_graph(spark, d)[1], "unknown", F.expr("a not like 'T:s%' or a like '%7'"))


@query(_with(_EDGES, _CLO, "u AS (SELECT * FROM clo UNION ALL SELECT 'unknown', 'unknown', 0)", select="SELECT descendant, COUNT(*) AS ancestors, MAX(dist) AS height FROM u GROUP BY 1", recursive=True))
def closure_with_unknown(spark, d):
    clo = ontology.with_unknown(_closure(spark, d))
    return clo.groupBy("descendant").agg(F.count(F.lit(1)).alias("ancestors"), F.max("dist").alias("height"))


@query(_with(_EDGES, _CLO, _CELLS, "seen AS (SELECT DISTINCT tissue AS term FROM cells WHERE assay = 'P')", "k AS (SELECT DISTINCT ancestor AS term FROM clo JOIN seen ON descendant = term)", select="SELECT ancestor, descendant, dist FROM clo WHERE ancestor IN (SELECT term FROM k) AND descendant IN (SELECT term FROM k) AND ancestor <> 'ALL' AND descendant <> 'ALL'", recursive=True))
def restricted_ontology(spark, d):
    seen = virtual.cells(spark, d).where("assay = 'P'").select(F.col("tissue").alias("term")).distinct()
    return ontology.restricted(_closure(spark, d), seen)


@query(_with(_EDGES, _CLO, _CELLS, "dd AS (SELECT x.descendant AS a, y.descendant AS b, MIN(x.dist + y.dist) AS dist FROM clo x JOIN clo y ON x.ancestor = y.ancestor GROUP BY 1, 2)", "n AS (SELECT tissue, row_number() OVER (ORDER BY tissue) - 1 AS code FROM (SELECT DISTINCT tissue FROM cells))", select="SELECT CAST(x.code AS INTEGER) AS i, CAST(y.code AS INTEGER) AS j, CAST(dist AS INTEGER) AS dist FROM dd JOIN n x ON a = x.tissue JOIN n y ON b = y.tissue", recursive=True))
def distance_slice(spark, d):
    names = [r[0] for r in virtual.cells(spark, d).select("tissue").distinct().orderBy("tissue").collect()]
    return ontology.distance_slice(ontology.distances(virtual.edges(spark, d)), names)


# text, logs, SQL ----------------------------------------------------------------------------------


@query(r"SELECT s_suppkey AS gene_id, starts_with(s_name, 'Supplier#') AS has_prefix, regexp_replace(s_name, '^Supplier#', '') AS bare, split_part(s_name, '#', 1) AS kind, replace(s_name, '#', ':') AS colon, ends_with(s_name, '7') AS seven, contains(s_name, '00000001') AS some, 'PC' || (s_suppkey + 1) AS pc, 'cell_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS padded FROM supplier")
def name_functions(spark, d):
    n, k = F.col("s_name"), F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("gene_id"), n.startswith("Supplier#").alias("has_prefix"), F.regexp_replace(n, "^Supplier#", "").alias("bare"), F.split_part(n, F.lit("#"), F.lit(1)).alias("kind"),
        F.replace(n, F.lit("#"), F.lit(":")).alias("colon"), n.endswith("7").alias("seven"), n.contains("00000001").alias("some"), F.concat(F.lit("PC"), k + 1).alias("pc"), F.format_string("cell_%06d", k).alias("padded"),
    )


@query("WITH t AS (SELECT event_type AS label, CAST(value AS DOUBLE) AS value FROM events) SELECT label, COUNT(*) AS n, round(AVG(value), 6) AS mean, round(stddev_samp(value), 6) AS spread FROM t GROUP BY 1")
def scalar_events(spark, d):
    """Scalars by the last part of their tag; timings (tags that end in sec) are left out."""
    e = table(spark, d, "events").select(F.concat(F.lit("train/epoch/"), F.col("event_type")).alias("tag"), F.col("value").cast("double").alias("value"))
    e = e.unionByName(e.select(F.concat("tag", F.lit("_sec")).alias("tag"), "value")).where(~F.col("tag").endswith("sec"))
    return e.groupBy(paths.last_element(F.col("tag")).alias("label")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("spread"))


@query("SELECT 'trial_' || s_nationkey AS trial, round(SUM(s_acctbal), 2) AS loss, CAST(s_nationkey * 8 AS INTEGER) AS width, row_number() OVER (ORDER BY round(SUM(s_acctbal), 2), 'trial_' || s_nationkey) AS place FROM supplier GROUP BY s_nationkey")
def trial_losses(spark, d):
    """One log a trial with its settings as JSON and its loss at the end of a line, read back and put in order."""
    t = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.round(F.sum(F.col("s_acctbal").cast("double")), 2).alias("loss"))
    trial = F.concat(F.lit("trial_"), F.col("s_nationkey")).alias("trial")
    lines = F.array(F.concat(F.lit('{"trainer": {"init": {"width": '), F.col("s_nationkey") * 8, F.lit("}}}")), F.lit("step 1 loss 99.5"), F.concat(F.lit("Avg Eval Loss, trial done: "), F.format_string("%.2f", "loss")))
    folder = shared.new_folder(spark, "logs")
    t.select(trial, F.explode(lines).alias("value")).repartition("trial").write.partitionBy("trial").text(folder)
    back = spark.read.text(folder).select("trial", "value")
    loss = F.when(F.col("value").startswith("Avg Eval Loss"), F.element_at(F.split("value", " "), -1).cast("double"))
    width = F.get_json_object("value", "$.trainer.init.width").cast("int")
    rows = back.groupBy("trial").agg(F.max(loss).alias("loss"), F.max(width).alias("width"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("loss", "trial"))).orderBy("loss")  # one row a trial


@query("SELECT c_mktsegment AS cell_type, COUNT(*) AS n, COUNT(DISTINCT n_name) AS tissues FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def sql_scan(spark, d):
    for t in ("customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(f"rowloom_{t}")
    return spark.sql("SELECT c_mktsegment AS cell_type, COUNT(*) AS n, COUNT(DISTINCT n_name) AS tissues FROM rowloom_customer JOIN rowloom_nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")


@query(_with(_CELLS, select="SELECT cell_id, assay AS a, 'x' AS b, CAST(2 AS BIGINT) AS n FROM cells"))
def merged_maps(spark, d):
    """A later dict's keys win."""
    m = F.map_zip_with(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("x")), F.create_map(F.lit("a"), F.col("assay")), lambda k, x, y: F.coalesce(y, x))
    return virtual.cells(spark, d).select("cell_id", m["a"].alias("a"), m["b"].alias("b"), F.size(m).cast("long").alias("n"))


@query("SELECT p_partkey, round(pow(10, -3 + 6.0 * p_size / 50), 6) AS logspace, round(0.5 + p_size * 0.25, 6) AS linspace FROM part")
def grids(spark, d):
    """Points of a logarithmic and a linear grid by each part's size."""
    i = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", r6(F.pow(F.lit(10.0), -3 + 6.0 * i / 50)).alias("logspace"), r6(0.5 + i * 0.25).alias("linspace"))


@query(_with(_CENT, select="SELECT label, CAST(k AS INTEGER) AS k, round(SUM(c * sin(dim + 2.0 * k)) + cos(label + 1.0 * k), 5) AS v FROM cent CROSS JOIN range(3) r(k) GROUP BY label, k"))
def linear_with_bias(spark, d):
    """x W + b + a bias of the row's own covariate."""
    cent = evaluate.centroids(table(spark, d, "embeddings"), "label")
    three = spark.range(3).select(F.col("id").cast("int").alias("k"))
    w = spark.range(64).select(F.col("id").cast("int").alias("i")).crossJoin(three).withColumn("w", F.sin(F.col("i") + 2.0 * F.col("k")))
    shift = cent.select("label").distinct().crossJoin(three).withColumn("s", F.cos(F.col("label") + F.col("k").cast("double")))
    return fits.linear(cent.select("label", F.col("dim").alias("i"), F.col("c").alias("v")), w, shift=shift, row="label").select("label", "k", F.round("v", 5).alias("v"))


@query(_with(_GRAPH, "walk AS (SELECT term AS ancestor, term AS descendant FROM terms UNION SELECT ancestor, child FROM walk JOIN edges ON descendant = parent)", "k AS (SELECT ancestor AS term, COUNT(*) AS below FROM walk GROUP BY 1)", select="SELECT term, below = 1 AS leaf, CAST(row_number() OVER (ORDER BY below = 1, term) - 1 AS INTEGER) AS place FROM k", recursive=True))
def nonleaf_order(spark, d):
    """Terms with others below them first, then the leaves: where each stands when logits are propagated."""
    return ontology.nonleaf_first(ontology.closure(_graph(spark, d)[1]))


@query(_with(_EDGES, _CLO, select="SELECT x.descendant AS a, y.descendant AS b, CAST(MIN(x.dist + y.dist) AS INTEGER) AS dist FROM clo x JOIN clo y ON x.ancestor = y.ancestor GROUP BY 1, 2 UNION ALL SELECT 'unknown', 'unknown', 0", recursive=True))
def distance_matrix_file(spark, d):
    """All distances as one array a term in a Parquet file, and back."""
    folder = f"{shared.new_folder(spark, 'distances')}/matrix"
    ontology.write_distances(ontology.distances(virtual.edges(spark, d), "unknown"), folder)
    return ontology.read_distances(spark, folder)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    """Counts and sums of event types by hour of event time, as a stream over the table's files."""
    out = running.stream_windows(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
