"""Sinks: prediction parts, statistics, model state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, folder: str, key: str = "x", names: str = "obs_name", size: int | None = None, fields: list[str] = (), gzip: bool = True) -> None:
    """Headerless CSV: the row's name, further fields in reverse, then the first `size` values of the array `key`."""
    width = size or df.select(F.max(F.size(key))).first()[0] or 0
    cols = [F.col(names), *[F.col(c) for c in reversed(list(fields))], *[F.get(F.col(key), k).alias(f"v{k}") for k in range(width)]]
    df.select(*cols).write.csv(folder, header=False, compression="gzip" if gzip else "none")


def read_predictions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.csv(folder, schema=schema, header=False)


def write_stats(stats: DataFrame, folder: str) -> None:
    stats.write.csv(folder, header=True)


def save_state(state: DataFrame, folder: str, **meta) -> None:
    """Model state as Parquet with its settings beside it."""
    state.write.parquet(f"{folder}/state")
    state.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.json(f"{folder}/meta")


def load_state(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/state"), json.loads(spark.read.json(f"{folder}/meta").first()["meta"])


def check_resume(saved: dict, now: dict) -> None:
    """Settings that decide which rows a step sees must be the same."""
    differ = sorted(k for k in saved.keys() | now.keys() if saved.get(k) != now.get(k))
    if differ:
        raise ValueError(f"cannot resume, as these settings changed: {differ}")


def check_disk_space(free: int, first_file: int, files: int, share: float = 0.9) -> int:
    """Bytes that `files` of the first one's size will take; raises if they are more than a share of what is free."""
    need = first_file * files
    if need > share * free:
        raise OSError(f"{need} bytes are needed, {free} are free")
    return need


def write_top_genes(ranked: dict[int, DataFrame], folder: str) -> None:
    """For each number of genes the whole table and that of the flagged genes."""
    for n, df in sorted(ranked.items()):
        df.write.csv(f"{folder}/top{n}.csv", header=True)
        df.where("highly_variable").write.csv(f"{folder}/top{n}_flagged.csv", header=True)


def write_matrix(layers: dict[str, DataFrame], cells: DataFrame, folder: str) -> None:
    """Matrices of the same cells as layers of one table, and the cells beside it."""
    for name, m in layers.items():
        m.write.parquet(f"{folder}/matrix/layer={name}")
    cells.write.parquet(f"{folder}/cells")


def write_ontologies(parts: dict[str, DataFrame], folder: str) -> None:
    """One table for several ontologies, a folder each."""
    for name, df in parts.items():
        df.write.parquet(f"{folder}/ontology={name}")


def load_field(spark: SparkSession, path: str, field, format: str = "parquet", **options) -> DataFrame:
    """One converted column of a file, as `value`."""
    return spark.read.options(**options).format(format).load(path).select(field.column().alias("value"))


def load_fields(spark: SparkSession, path: str, fields: dict, format: str = "parquet", **options) -> DataFrame:
    """Several converted columns of one file."""
    df = spark.read.options(**options).format(format).load(path)
    return df.select(*[f.column().alias(n) for n, f in fields.items()])


def resume_problems(saved: DataFrame, now: DataFrame) -> DataFrame:
    """setting, before, now of (setting, value) tables, where the two differ or one lacks it."""
    a, b = (t.select("setting", F.col("value").cast("string").alias(n)) for t, n in ((saved, "before"), (now, "now")))
    return a.join(b, "setting", "full").where(~F.col("before").eqNullSafe(F.col("now")))
