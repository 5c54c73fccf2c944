"""The annotated matrix that the driver's tables stand for: cells (rows), genes (columns), matrix (values, zeros absent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the value table that one task groups, sorts and windows, about.
TASK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("batch"), F.col("o_orderstatus").alias("assay"), F.col("c_mktsegment").alias("cell_type"), F.col("n_name").alias("tissue"), F.col("o_totalprice").alias("library"))
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene_id"), F.col("s_name").alias("var_name"), F.col("s_acctbal").alias("scale"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # one exchange by cell serves the sums here and all windows over cells later; its partitions grow in number, not in size
    parts = -(-li.count() // TASK_ROWS)
    li = li.repartition(max(parts, spark.sparkContext.defaultParallelism), "l_orderkey") if parts > 1 else li.repartition("l_orderkey")
    return li.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_suppkey").alias("gene_id")).agg(F.sum("l_quantity").alias("x"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ontology ALL -> region -> nation as parent, child."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.lit("ALL").alias("parent"), F.col("r_name").alias("child"))
    return top.unionByName(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))
