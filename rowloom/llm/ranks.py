"""Exact ranks in groups from histograms of key digits, without a sort over a group.

Keys are longs. A group's key range is cut into buckets of some BUCKET_ROWS rows; their counts are
summed up by digits of the bucket number, DIGIT_BITS at a time, so that no window holds more than one
node's children. A row's rank is what lies before its bucket and its place in it. Buckets that hold far
more rows than planned (clustered keys, ties) are groups of the next pass, by the same key while it
varies, then by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKET_ROWS, DIGIT_BITS = 8_192, 12


def before(counts: DataFrame, keys: list[str], at: str, n: str = "n", bits: int | None = None) -> DataFrame:
    """counts(keys..., at, n) with `before`: the sum of n over smaller `at` >= 0 under equal keys. One row per keys and `at`."""
    most = counts.agg(F.max(at)).first()[0] or 0
    return _before(counts, keys, at, n, bits or DIGIT_BITS, most)


def _before(counts: DataFrame, keys: list[str], at: str, n: str, bits: int, most: int) -> DataFrame:
    up, name = F.shiftright(at, bits), f"{at}_up"
    inside = Window.partitionBy(*keys, up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("before", F.coalesce(F.sum(n).over(inside), F.lit(0)).cast("long"))
    if most >> bits == 0:
        return out
    sums = counts.groupBy(*keys, up.alias(name)).agg(F.sum(n).alias("__n"))
    above = _before(sums, keys, name, "__n", bits, most >> bits).select(*keys, name, F.col("before").alias("__above"))
    return out.withColumn(name, up).join(above, [*keys, name]).withColumn("before", F.col("before") + F.col("__above")).drop(name, "__above")


def _bucket(key: Column, low: Column, shift: Column) -> Column:
    cut = lambda x: F.call_function("shiftright", x, shift)
    return cut(key) - cut(low)


def ranked(rows: DataFrame, group: str, keys: list[str], total: int, bucket_rows: int | None = None) -> DataFrame:
    """rows with `rank`, from 0 in each group, by keys, and the group's number of rows `group_size`. Rows must be a written
    table; group is not null and the keys are longs without nulls. Rows that agree in all keys are ranked in any order.
    """
    bucket_rows = bucket_rows or BUCKET_ROWS
    names, done, at = rows.columns, [], 0
    rest = rows.withColumns({"__cell": F.col(group).cast("string"), "__base": F.lit(0).cast("long"), "__size": F.lit(None).cast("long")})
    while True:
        spans = rest.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"), *[f(k).alias(f"__{f.__name__}{i}") for i, k in enumerate(keys) for f in (F.min, F.max)])
        # the first key that varies in the cell, and the shift that makes about 2 n / bucket_rows buckets of its range
        use = F.coalesce(*[F.when(F.col(f"__min{i}") < F.col(f"__max{i}"), F.lit(i)) for i in range(len(keys))], F.lit(len(keys) - 1))
        pick = lambda f: F.element_at(F.array(*[F.col(f"__{f}{i}") for i in range(len(keys))]), F.col("__use") + 1)
        wide = (F.col("__high").cast("double") - F.col("__low").cast("double") + 1) / F.ceil(2 * F.col("__n") / bucket_rows)
        spans = spans.withColumn("__use", use).withColumns({"__low": pick("min"), "__high": pick("max")})
        spans = spans.withColumn("__shift", F.greatest(F.lit(0), F.ceil(F.log2(wide))).cast("int")).select("__cell", "__n", "__use", "__low", "__shift")
        spans = common.materialize(spans, f"rank-spans{at}")
        # fewer rows than a bucket's: small enough for one window whatever the keys
        put = common.join_groups(rest, spans, "__cell", "__n", total)
        key = F.element_at(F.array(*[F.col(k) for k in keys]), F.col("__use") + 1)
        put = put.withColumns({"__bucket": F.when(F.col("__n") <= bucket_rows, F.lit(0)).otherwise(_bucket(key, F.col("__low"), F.col("__shift"))).cast("long"), "__size": F.coalesce("__size", "__n")})
        put = put.drop("__use", "__low", "__shift")
        hist = common.materialize(put.groupBy("__cell", "__bucket").agg(F.count(F.lit(1)).alias("n"), F.first("__n").alias("__n")), f"rank-hist{at}")
        nodes = common.materialize(before(hist, ["__cell"], "__bucket"), f"rank-nodes{at}")
        heavy = nodes.where(f"n > {4 * bucket_rows}").select("__cell", "__bucket", F.col("before").alias("__before"), F.lit(True).alias("__heavy"))
        n_heavy = heavy.count()
        put = put.drop("__n")
        if n_heavy:
            put = put.join(common.broadcast_if_small(heavy, n_heavy), ["__cell", "__bucket"], "left")
            more = put.where("__heavy").withColumns({"__cell": F.concat_ws(".", "__cell", "__bucket"), "__base": F.col("__base") + F.col("__before")})
            more = common.materialize(more.drop("__heavy", "__before", "__bucket"), f"rank-rest{at}")
            put = put.where("__heavy is null").drop("__heavy", "__before")
        own = F.row_number().over(Window.partitionBy("__cell", "__bucket").orderBy(*keys)) - 1
        light = put.withColumn("__own", own).join(nodes.select("__cell", "__bucket", "before"), ["__cell", "__bucket"])
        done.append(light.select(*names, (F.col("__base") + F.col("before") + F.col("__own")).alias("rank"), F.col("__size").alias("group_size")))
        if not n_heavy:
            break
        rest, at = more, at + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
