"""A corpus from raw documents to packed sequences: five stages, each calling one operator of rowloom.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame that is written as Parquet and read again for the next. All but the last return the
columns of documents. Stages that drop or repeat rows number them first and decide by that number,
so rows with a null id or the id of another row count like all others. Columns of docs keep their
values whatever their names, very long texts count whole, and an empty table leaves an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import common, exact_dedup, language_id, mixing, packing, similar


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written so that it stays, and that column's name, which no column of docs has."""
    name = "_".join(["row", *docs.columns])
    return common.materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _without(rows: DataFrame, row: str, verdicts: DataFrame) -> DataFrame:
    """rows less those that verdicts(uid, kept) does not keep."""
    gone = common.materialize(verdicts.where("not kept").select(F.col("uid").alias(row)), "verdicts")
    return rows.join(common.broadcast_if_small(gone, gone.count()), row, "left_anti").drop(row)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without letters go; all others take the best learnt language, whatever its score. Without any label every text goes."""
    return language_id.with_language(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays: the longest, then of the least id, then the first read. Null texts are empty ones."""
    rows, row = _numbered(docs)
    return _without(rows, row, exact_dedup.exact_groups(rows, uid_col=row)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are alike in five-word shingles from 0.8 on the least id stays, then the first read."""
    rows, row = _numbered(docs)
    groups = similar.similar_groups(rows, id_col=row).select(F.col("doc_id").alias("uid"), "component_id")
    groups = groups.join(rows.select(F.col(row).alias("uid"), F.col("doc_id").cast("long").alias("doc_id")), "uid")
    groups = common.materialize(groups, "near-groups")
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = common.join_groups(groups, common.materialize(best, "near-best"), "component_id", "n", groups.count())
    return _without(rows, row, named.select("uid", F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many equal rows as the mix takes copies of a row."""
    rows, row = _numbered(docs)
    taken = mixing.mix(rows, uid_col=row).where("copies > 0").select(F.col("uid").alias(row), F.col("copies").cast("int").alias(f"{row}_copies"))
    taken = common.materialize(taken, "mix-copies")
    rows = rows.join(common.broadcast_if_small(taken, taken.count()), row)
    return rows.withColumn(f"{row}_copy", F.explode(F.sequence(F.lit(1), F.col(f"{row}_copies")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a row's tokens and its place; a null text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: A trained model, hashed fingerprints and sampling are beyond SQL; the stages' tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
