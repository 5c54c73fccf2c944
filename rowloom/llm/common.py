"""What the operators share: tables in the shared folder, skew-safe joins, bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: long texts make batches of thousands of rows too large for a worker.
BATCH_ROWS = 512
#: A key that holds at least this share of all rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001
#: Most rows of a table that may be broadcast after counting it.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='rowloom-')}"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rowloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, most: int, total: int | None = None) -> DataFrame:
    """All rows if they are `most` at most, else exactly `most`, drawn by a hash of the whole row and its place in the input.

    Nulls and repeats in any column draw apart. Twice as many rows as are wanted are written first, so that draws stay.
    """
    total = df.count() if total is None else total
    if total <= most:
        return df
    draw = "_".join(["draw", *df.columns])
    drawn = df.withColumn(draw, F.shiftright(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id()), 1))
    low = -(1 << 62) + int(min(1.0, (2 * most + 100) / total) * ((1 << 63) - 1))
    drawn = materialize(drawn.where(F.col(f"`{draw}`") <= low), "drawn")
    cut = drawn.select(F.col(f"`{draw}`").alias("d")).orderBy("d").limit(most).agg(F.max("d")).first()[0]
    return drawn.where(F.col(f"`{draw}`") <= cut).drop(draw)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows to one row a key, where some keys may hold a large share of the rows.

    `groups` has `key`, the number of rows `size` and further columns. Keys with at least
    HOT_SHARE of `total` rows are at most 1 / HOT_SHARE rows, so they are broadcast; the rest is
    joined by a shuffle, in which rows of hot keys are spread by a hash of the whole row.
    """
    hot_rows = max(2, int(total * HOT_SHARE))
    extra = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) >= hot_rows).select(F.col(key), F.struct(*extra).alias("__hot"))
    cold = groups.where(F.col(size) < hot_rows).select(F.col(key).alias("__key"), F.lit(True).alias("__cold"), F.struct(*extra).alias("__rest"))
    out = rows.join(F.broadcast(hot), key, "left")
    is_cold = F.col("__hot").isNull()
    spread = F.when(is_cold, F.col(key)).otherwise(F.xxhash64(*[F.col(c) for c in rows.columns]).cast(rows.schema[key].dataType))
    out = out.withColumns({"__key": spread, "__cold": is_cold}).join(cold, ["__key", "__cold"], "left")
    picked = F.coalesce(F.col("__hot"), F.col("__rest"))
    return out.select(*rows.columns, *[picked[c].alias(c) for c in extra])


def broadcast_if_small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only a table that was counted; beyond the bound Spark joins by a shuffle."""
    return F.broadcast(df) if rows <= most else df
