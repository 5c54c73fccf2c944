"""Shards through the data source: types, limits, pruning by rows and names; and joins to ranges."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan
from pyspark.sql.types import StructType

from rowloom.operators.ranges import range_join
from rowloom.sources import shard_source, shards

REF = "A int, B string, C double"


@pytest.fixture(scope="module")
def pattern(tmp_path_factory):
    """Three shards of 20, 30 and 50 rows; one column with three types, two orders of columns."""
    base = tmp_path_factory.mktemp("mixed")
    at = 0
    for k, n in enumerate((20, 30, 50)):
        rows = range(at, at + n)
        a = [pa.array([str(i) for i in rows]), pa.array(rows, pa.int64()), pa.array(rows, pa.float32())][k]
        cols = {"A": a, "B": pa.array([f"b{i % 3}" for i in rows]).dictionary_encode(), "C": pa.array([i / 4 for i in rows], pa.float32() if k else pa.float64()), f"own{k}": pa.array([k] * n)}
        names = list(cols) if k != 1 else list(reversed(cols))
        pq.write_table(pa.table({c: cols[c] for c in names}), f"{base}/s_{k:02d}.parquet", row_group_size=10)
        at += n
    return f"{base}/s_{{00..02}}.parquet"


def test_types_are_the_references_whatever_the_shards(spark, pattern):
    df = shard_source.load(spark, pattern, REF)
    assert df.schema.simpleString() == "struct<A:int,B:string,C:double>"
    assert sorted((r.A, r.B, r.C) for r in df.collect()) == [(i, f"b{i % 3}", i / 4) for i in range(100)]
    same = shards.read_shards(spark, pattern, like=df)
    assert same.schema.simpleString() == df.schema.simpleString() and same.exceptAll(df).isEmpty() and same.count() == 100
    with pytest.raises(shards.SchemaMismatch):
        shards.read_shards(spark, pattern, like=df.withColumn("D", F.lit(1)))


def test_without_a_schema_the_first_shards_counts(spark, pattern):
    df = shard_source.load(spark, pattern.replace("{00..02}", "00"), rows=True)
    assert df.columns == ["A", "B", "C", "own0", "row_index", "shard"] and df.count() == 20
    with pytest.raises(Exception, match="own0"):
        shard_source.load(spark, pattern).collect()
    with pytest.raises(Exception, match="99"):
        shard_source.load(spark, pattern.replace("{00..02}", "99"), REF).collect()


def test_limits_come_from_footers(spark, pattern):
    assert [tuple(r) for r in shard_source.limits(spark, pattern).orderBy("shard_id").collect()] == [(0, "s_00.parquet", 0, 20), (1, "s_01.parquet", 20, 50), (2, "s_02.parquet", 50, 100)]


@pytest.mark.parametrize(
    ("filters", "numbers", "rows"),
    [
        ([], [0, 1, 2], 100),
        ([EqualTo(("row_index",), 20)], [1], 1),
        ([In(("row_index",), (3, 55, 1000, None))], [0, 2], 2),
        ([GreaterThanOrEqual(("row_index",), 19), LessThan(("row_index",), 21)], [0, 1], 2),
        ([In(("shard",), ("s_02.parquet", "x"))], [2], 50),
        ([EqualTo(("shard",), "s_00.parquet"), GreaterThanOrEqual(("row_index",), 60)], [], 0),
        ([EqualTo(("A",), 1)], [0, 1, 2], 100),
    ],
)
def test_filters_choose_shards_and_row_groups(pattern, filters, numbers, rows):
    r = shard_source.ShardReader(StructType.fromDDL(REF + ", row_index long, shard string"), shards.expand_braces(pattern))
    assert list(r.pushFilters(filters)) == filters
    parts = r.partitions()
    assert [p.number for p in parts] == numbers
    read = [i for p in parts for b in r.read(p) for i in b.column(3).to_pylist()]
    assert len(read) <= min(10 * max(rows, 1) * (rows < 50) + 100 * (rows >= 50), 100) and len(read) >= rows


def test_filters_reach_the_source_from_sql(spark, pattern):
    df = shard_source.load(spark, pattern, "A int, row_index long, shard string")
    assert df.where("row_index = 21").rdd.getNumPartitions() == 1
    assert [tuple(r) for r in df.where("row_index in (21, 99)").orderBy("A").collect()] == [(21, 21, "s_01.parquet"), (99, 99, "s_02.parquet")]


def test_requests_keep_order_and_repeats_and_touch_few_shards(spark, pattern):
    asked = [60, 51, 60, 99, 70]
    wanted = spark.createDataFrame(list(enumerate(asked)), "pos long, row_index long")
    got = shard_source.request(spark, pattern, wanted, REF)
    assert [r["A"] for r in got.orderBy("pos").collect()] == asked
    assert shard_source.request(spark, pattern, wanted.where("false"), REF).count() == 0


def _pairs(points, ranges):
    return sorted((p, k) for p in points for k, a, b in ranges if p is not None and a is not None and b is not None and a <= p < b)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_ranges_of_all_lengths_and_values_on_bounds(spark, kind):
    rng = random.Random(4)
    value = (lambda: rng.randint(-5000, 5000)) if kind == "long" else (lambda: rng.choice([rng.uniform(-50, 50), float(rng.randint(-50, 50))]))
    ranges = []
    for k in range(400):
        a = value()
        ranges.append((k, a, a + rng.choice([0, 1, 2, 64, 1000, 7]) * (1 if kind == "long" else rng.choice([1.0, 0.01]))))
    ranges += [(400, 5, 3), (401, None, 7), (402, 1, None), (403, -(2**40), 2**40)]
    ranges = [(k, None if a is None else (int if kind == "long" else float)(a), None if b is None else (int if kind == "long" else float)(b)) for k, a, b in ranges]
    points = [*{value() for _ in range(300)}, *{a for _, a, _ in ranges if a is not None}, *{b for _, _, b in ranges if b is not None}, None]
    points = list(dict.fromkeys(None if p is None else (int if kind == "long" else float)(p) for p in points))
    p, r = spark.createDataFrame([(x,) for x in points], f"v {kind}"), spark.createDataFrame(ranges, f"k int, start {kind}, stop {kind}")
    assert sorted((x["v"], x["k"]) for x in range_join(p, r, "v").collect()) == _pairs(points, ranges)
    left = range_join(p, r, "v", how="left").collect()
    assert {x["v"] for x in left} == set(points) and sum(x["k"] is None for x in left) == len([q for q in points if not any(q == y for y, _ in _pairs(points, ranges))])


def test_ten_thousand_ranges_without_a_nested_loop(spark, monkeypatch):
    ends = [0]
    rng = random.Random(1)
    for _ in range(10_000):
        ends.append(ends[-1] + rng.choice([1, 3, 100, 5000]))
    table = shards.shard_table(spark, ends[1:])
    rows = spark.range(0, ends[-1] + 50, 101).withColumnRenamed("id", "row")
    found = shards.lookup_shards(rows, "row", table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    import bisect

    got = {r["row"]: r["shard_id"] for r in found.collect()}
    assert got == {x: bisect.bisect_right(ends, x) - 1 for x in range(0, ends[-1], 101)}
    monkeypatch.setattr("rowloom.operators.ranges.BROADCAST_RANGES", 10)
    assert shards.lookup_shards(rows, "row", table).count() == len(got)
