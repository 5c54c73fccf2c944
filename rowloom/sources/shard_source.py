"""A data source over Parquet shards: one partition a shard, row limits from the footers, types of a reference.

    spark.dataSource.register(ShardSource)
    spark.read.format("shards").schema("cell_id long, batch string").load("/data/cells_{000..005}.parquet")

Columns that the schema names are the only ones read, and get its types whatever the shards' own; without
one the first shard's schema counts. `row_index`, if the schema has it (or option rows = true adds it), is a row's place over
all shards, `shard` the shard's name. Comparisons of `row_index` and `shard` with constants choose the shards, and
inside a shard the row groups, before anything but footers is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.ranges import range_join
from .shards import expand_braces

ROW, SHARD = "row_index", "shard"
#: Footers that are read at once.
THREADS = 16


def _files(path: str):
    """The file system of a path and the Parquet files in it, in order of name; a shard may be a file or a folder."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return system, [inner]
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".parquet"))


def footer_rows(path: str) -> int:
    import pyarrow.parquet as pq

    system, files = _files(path)
    return sum(pq.ParquetFile(f, filesystem=system).metadata.num_rows for f in files)


def footer_schema(path: str) -> StructType:
    import pyarrow.parquet as pq

    system, files = _files(path)
    return from_arrow_schema(pq.ParquetFile(files[0], filesystem=system).schema_arrow)


def row_counts(paths: list[str]) -> list[int]:
    """Rows of each shard by its footers."""
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(footer_rows, paths))


@dataclass
class Shard(InputPartition):
    path: str
    number: int
    start: int
    stop: int
    ranges: list[tuple[int, int]] = field(default_factory=list)


def _overlap(ranges: list[tuple[int, int]], start: int, stop: int) -> list[tuple[int, int]]:
    return [(max(a, start), min(b, stop)) for a, b in ranges if a < stop and b > start]


class ShardReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str]):
        self.schema, self.paths = schema, paths
        self.ranges: list[tuple[int, int]] = [(0, 1 << 62)]  # rows asked for
        self.names: set[str] | None = None

    def pushFilters(self, filters):
        """Spark evaluates all filters again, so what is pushed only has to be a superset."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == SHARD and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            elif column == ROW:
                own = {
                    EqualTo: lambda f: [(f.value, f.value + 1)],
                    In: lambda f: [(v, v + 1) for v in sorted({v for v in f.value if v is not None})],
                    GreaterThan: lambda f: [(f.value + 1, 1 << 62)],
                    GreaterThanOrEqual: lambda f: [(f.value, 1 << 62)],
                    LessThan: lambda f: [(0, f.value)],
                    LessThanOrEqual: lambda f: [(0, f.value + 1)],
                }.get(type(f))
                if own:
                    self.ranges = [r for a, b in own(f) for r in _overlap(self.ranges, a, b)]
        return filters

    def partitions(self) -> list[Shard]:
        out, start = [], 0
        for k, (path, n) in enumerate(zip(self.paths, row_counts(self.paths), strict=True)):
            own = _overlap(self.ranges, start, start + n)
            if own and (self.names is None or shard_name(path) in self.names):
                out.append(Shard(path, k, start, start + n, own))
            start += n
        return out

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, files = _files(partition.path)
        target = to_arrow_schema(self.schema)
        at = partition.start
        for name in files:
            file = pq.ParquetFile(name, filesystem=system)
            columns = [f.name for f in target if f.name not in (ROW, SHARD)]
            missing = [c for c in columns if c not in file.schema_arrow.names]
            if missing:
                raise ValueError(f"{name} has no columns {missing}")
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                if _overlap(partition.ranges, at, at + n):
                    for b in file.iter_batches(row_groups=[g], columns=columns or None):
                        yield self._cast(b, at, partition.path, target)
                        at += b.num_rows
                else:
                    at += n

    def _cast(self, b: pa.RecordBatch, at: int, path: str, target: pa.Schema) -> pa.RecordBatch:
        cols = []
        for f in target:
            if f.name == ROW:
                cols.append(pa.array(range(at, at + b.num_rows), pa.int64()))
            elif f.name == SHARD:
                cols.append(pa.array([shard_name(path)] * b.num_rows, pa.string()))
            else:
                c = b.column(b.schema.get_field_index(f.name))
                c = c.dictionary_decode() if pa.types.is_dictionary(c.type) else c
                cols.append(c.cast(f.type, safe=not pa.types.is_floating(f.type)))
        return pa.RecordBatch.from_arrays(cols, schema=target)


def shard_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


class ShardSource(DataSource):
    """Options: path, a pattern with {a,b} lists and {000..005} ranges; rows = true to add row_index and shard to the schema."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def _paths(self) -> list[str]:
        paths = expand_braces(self.options["path"])
        if not paths:
            raise ValueError("no shard")
        return paths

    def schema(self) -> StructType:
        first = footer_schema(self._paths()[0])
        more = [StructField(ROW, LongType()), StructField(SHARD, StringType())] if self.options.get("rows", "false") == "true" else []
        return StructType([*first.fields, *more])

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(schema, self._paths())


def load(spark: SparkSession, pattern: str, schema: StructType | str | None = None, rows: bool = False) -> DataFrame:
    """The shards of a pattern as one table."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardSource)
    reader = spark.read.format("shards").option("rows", str(rows).lower())
    return (reader.schema(schema) if schema is not None else reader).load(pattern)


def limits(spark: SparkSession, pattern: str) -> DataFrame:
    """shard_id, shard, start, stop from footers alone."""
    paths = expand_braces(pattern)
    out, start = [], 0
    for k, (p, n) in enumerate(zip(paths, row_counts(paths), strict=True)):
        out.append((k, shard_name(p), start, start + n))
        start += n
    return spark.createDataFrame(out, "shard_id int, shard string, start long, stop long")


def request(spark: SparkSession, pattern: str, wanted: DataFrame, schema: StructType | str) -> DataFrame:
    """Rows for wanted(pos, row_index), one per request: repeats stay, `pos` keeps their order. Only the shards that hold one are read."""
    touched = range_join(wanted.select(ROW).distinct(), limits(spark, pattern), ROW)
    names = [r[SHARD] for r in touched.select(SHARD).distinct().collect()]  # shards, not rows
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    asked = StructType([*fields.fields, StructField(ROW, LongType()), StructField(SHARD, StringType())])
    rows = load(spark, pattern, asked).where(F.col(SHARD).isin(names) if names else F.lit(False))
    return wanted.join(rows.drop(SHARD), ROW)
