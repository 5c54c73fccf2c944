"""Sharded sources: paths, limits, row and column requests, schema checks."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import range_join


class SchemaMismatch(ValueError):
    """A shard does not have the reference's columns, types or categories."""


def expand_braces(pattern: str) -> list[str]:
    """All paths of a pattern with {a,b} lists and {000..005} ranges."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    span = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", m[1])
    if span:
        lo, hi, width = int(span[1]), int(span[2]), max(map(len, span.groups())) if "0" in (span[1][0], span[2][0]) else 0
        items = [str(k).zfill(width) for k in range(lo, hi + 1)] if lo <= hi else [str(k).zfill(width) for k in range(lo, hi - 1, -1)]
    elif "," in m[1]:
        items = m[1].split(",")
    else:
        return [pattern]
    return [x for i in items for x in expand_braces(pattern[: m.start()] + i + pattern[m.end() :])]


def limits(n_shards: int, shard_size: int, last_shard_size: int | None = None) -> list[int]:
    """Cumulative row ends of shards of one size, but for the last."""
    if n_shards < 1 or shard_size < 1:
        raise ValueError("shards and their size must be positive")
    ends = [shard_size * (k + 1) for k in range(n_shards)]
    if last_shard_size is not None:
        ends[-1] = shard_size * (n_shards - 1) + last_shard_size
    return ends


def read_shards(spark: SparkSession, pattern: str, label: str | None = None, keys: list[str] | None = None, index_unique: str | None = None, row: str = "cell_id", convert: dict | None = None, like: DataFrame | None = None) -> DataFrame:
    """One lazy table over all shards. `label` names a column with the shard's key (its name, or its entry in `keys`).

    `index_unique` makes row names unique as row, separator, key; `convert` maps columns to functions of them;
    `like` gives the columns and their types, whatever the shards' own: shards of one schema are read together, and each such
    table is cast before they are united."""
    paths = expand_braces(pattern)
    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    if keys is not None and len(keys) != len(paths):
        raise ValueError(f"{len(keys)} keys for {len(paths)} shards")
    df = _united(spark, paths, like, row if index_unique is not None else None).withColumn("__key", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)).drop("_metadata")
    if keys is not None:
        df = df.withColumn("__key", F.element_at(F.create_map(*[F.lit(x) for pair in zip(names, keys, strict=True) for x in pair]), F.col("__key")))
    if index_unique is not None:
        df = df.withColumn(row, F.concat_ws(index_unique, F.col(row).cast("string"), "__key"))
    df = df.withColumns({c: f(F.col(c)) for c, f in (convert or {}).items()})
    return df.withColumnRenamed("__key", label) if label else df.drop("__key")


def _united(spark: SparkSession, paths: list[str], like: DataFrame | None, text: str | None) -> DataFrame:
    """All shards' rows with the file's path as metadata; like's columns and types if it is given, but for `text`, which stays text."""
    if like is None:
        return spark.read.parquet(*paths).select("*", "_metadata")
    with ThreadPoolExecutor(16) as pool:
        schemas = list(pool.map(lambda p: spark.read.parquet(p).schema, paths))
    by: dict[str, list[str]] = {}
    for p, s in zip(paths, schemas, strict=True):
        by.setdefault(s.json(), []).append(p)
    out = None
    for own in by.values():
        df = spark.read.parquet(*own)
        if missing := [c for c in like.columns if c not in df.columns]:
            raise SchemaMismatch(f"{own[0]} has no columns {missing}")
        df = df.select(*[F.col(f.name).cast("string" if f.name == text else f.dataType).alias(f.name) for f in like.schema.fields], "_metadata")
        out = df if out is None else out.unionByName(df)
    return out


def shard_table(spark: SparkSession, ends: list[int]) -> DataFrame:
    starts = [0, *ends[:-1]]
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(starts, ends, strict=True))], "shard_id int, start long, stop long")


def lookup_shards(rows: DataFrame, row: str, shards: DataFrame) -> DataFrame:
    """Each row with the shard that holds it."""
    return range_join(rows, shards, row)


def gather_rows(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows for wanted(pos, key), one per request: duplicates stay, `pos` keeps the order."""
    return wanted.join(df, key)


def schema_problems(reference: DataFrame, candidate: DataFrame, columns: list[str] | None = None, categorical: list[str] = ()) -> list[str]:
    """What a shard has differently: columns, their order, types, and for categorical ones their values."""
    want = {f.name: f.dataType.simpleString() for f in reference.schema.fields if columns is None or f.name in columns}
    have = {f.name: f.dataType.simpleString() for f in candidate.schema.fields if columns is None or f.name in columns}
    out = [f"missing column {c}" for c in want if c not in have] + [f"unknown column {c}" for c in have if c not in want]
    if not out and list(want) != list(have):
        out.append("columns in another order")
    out += [f"{c} has type {have[c]}, not {t}" for c, t in want.items() if c in have and have[c] != t]
    out += [f"{c} has other categories" for c in categorical if c in have and c in want and not category_difference(reference, candidate, c).isEmpty()]
    return out


def check_schema(reference: DataFrame, candidate: DataFrame, columns: list[str] | None = None, categorical: list[str] = ()) -> None:
    if problems := schema_problems(reference, candidate, columns, categorical):
        raise SchemaMismatch("; ".join(problems))


def category_difference(reference: DataFrame, candidate: DataFrame, column: str) -> DataFrame:
    """category, side: values that one of the two has alone."""
    a, b = (d.select(F.col(column).alias("category")).distinct() for d in (reference, candidate))
    return a.exceptAll(b).withColumn("side", F.lit("reference")).unionByName(b.exceptAll(a).withColumn("side", F.lit("candidate")))
