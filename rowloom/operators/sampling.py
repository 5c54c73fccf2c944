"""Splits, shuffles and the assignment of row positions to replicas, batches and workers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import position


def split_sizes(n: int, train: float | int | None, val: float | int | None) -> tuple[int, int]:
    """Rows of the two parts: shares are rounded up, a missing part is the rest (none of both: all train)."""

    def size(v, lowest: int) -> int | None:
        if v is None:
            return None
        if isinstance(v, float):
            if not 0 <= v <= 1:
                raise ValueError("shares lie between 0 and 1")
            return math.ceil(n * v)
        if v < lowest:
            raise ValueError(f"sizes are at least {lowest}")
        return v

    a, b = size(train, 1), size(val, 0)
    if a is None and b is None:
        return n, 0
    a, b = (n - b if a is None else a), (n - a if b is None else b)
    if a + b > n or min(a, b) < 0:
        raise ValueError("the parts hold more rows than there are")
    return a, b


def ordinal(df: DataFrame, bucket: Column, within: list[Column], bucket_order: Column | None = None) -> DataFrame:
    """`pos` from 0 by bucket, then within: rows are numbered in their buckets, and each bucket starts where those before it end.

    No task sees more than a bucket's rows, or one row a bucket."""
    rows = df.withColumn("__bucket", bucket)
    order = F.col("__bucket") if bucket_order is None else bucket_order
    per = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__order", order)
    start = per.select("__bucket", (F.sum("__n").over(Window.orderBy("__order", "__bucket")) - F.col("__n")).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(*within)) - 1
    return rows.withColumn("__own", own).join(start, "__bucket").withColumn("pos", F.col("__start") + F.col("__own")).drop("__bucket", "__own", "__start")


def split(df: DataFrame, order: str, n: int, train=None, val=None, n_predict: int = 0, width: int = 1 << 16) -> DataFrame:
    """`part` by ordinal position: train, val, rest; the last n_predict rows are also flagged. `order` is a whole number."""
    a, b = split_sizes(n, train, val)
    part = F.when(F.col("pos") < a, "train").when(F.col("pos") < a + b, "val").otherwise("rest")
    return ordinal(df, F.floor(F.col(order) / width), [F.col(order)]).withColumns({"part": part, "is_predict": F.col("pos") >= n - n_predict})


def shard_shuffle(df: DataFrame, shard: str, row: str, seed: int, epoch: int = 0) -> DataFrame:
    """`pos`: shards in a seeded order, rows in a seeded order within."""
    return ordinal(df, F.col(shard), [position(F.lit(seed + epoch), F.lit("row"), row)], position(F.lit(seed + epoch), F.lit("shard"), "__bucket"))


def _even(n: int, replicas: int, drop_last: bool) -> tuple[int, int]:
    per = n // replicas if drop_last else -(-n // replicas)
    return per, per * replicas


def even_positions(df: DataFrame, n: int, replicas: int, drop_last: bool) -> DataFrame:
    """Rows (pos, ...) cut to a multiple of the replicas, or padded from the start; `slot` numbers the result."""
    _, total = _even(n, replicas, drop_last)
    out = df.where(F.col("pos") < total).withColumn("slot", F.col("pos"))
    rounds = -(-total // max(1, n))
    for k in range(1, rounds):
        out = out.unionByName(df.where(F.col("pos") + k * n < total).withColumn("slot", F.col("pos") + k * n))
    return out


def _placed(df: DataFrame, replica: Column, at: Column, batch: int, per: int) -> DataFrame:
    return df.withColumns({"replica": replica, "batch": F.floor(at / batch), "in_batch": at % batch})


def same_order(slots: DataFrame, n: int, replicas: int, batch: int, workers: int, drop_last: bool = False) -> DataFrame:
    """Replica r has slots r, r + R, ...; batches go round the workers."""
    per, _ = _even(n, replicas, drop_last)
    out = _placed(slots, F.col("slot") % replicas, F.floor(F.col("slot") / replicas), batch, per)
    return out.withColumns({"worker": F.col("batch") % workers, "turn": F.col("batch")})


def cache_efficient(slots: DataFrame, n: int, replicas: int, batch: int, workers: int, drop_last: bool = False) -> DataFrame:
    """Replica r has one contiguous run, and so has each worker; `turn` is the order in which batches arrive."""
    per, _ = _even(n, replicas, drop_last)
    out = _placed(slots, F.floor(F.col("slot") / per), F.col("slot") % per, batch, per)
    batches = -(-per // batch)
    each = -(-batches // workers)
    out = out.withColumn("worker", F.floor(F.col("batch") / each))
    return out.withColumn("turn", (F.col("batch") % each) * workers + F.col("worker"))


def drop_incomplete(placed: DataFrame, batch: int) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("replica", "batch"))
    return placed.withColumn("__n", n).where(F.col("__n") == batch).drop("__n")


def n_batches(n: int, replicas: int, batch: int, drop_last: bool = False, drop_incomplete_batch: bool = False) -> int:
    per, _ = _even(n, replicas, drop_last)
    return per // batch if drop_incomplete_batch else -(-per // batch)


def batches(n: Column, replicas: Column, batch: int, drop_last: bool = False, drop_incomplete: bool = False) -> Column:
    """The same number as a column."""
    per = F.floor(n / replicas) if drop_last else F.ceil(n / replicas)
    return F.floor(per / batch) if drop_incomplete else F.ceil(per / batch)


def reservoir(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """A uniform sample of a fixed size, by a seeded order."""
    return df.orderBy(position(F.lit(seed), key), key).limit(most)


def priority_sample(df: DataFrame, key: str, most: int, seed: int, group: str | None = None) -> DataFrame:
    """The `most` rows of each group that are first in the seeded order of their key: what a sample of samples gives, too, so it is
    kept and merged as state. Tasks pass on `most` rows a group at most."""
    w = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(position(F.lit(seed), key), key)
    name = "_".join(["place", *df.columns])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most).drop(name)


def resumed(placed: DataFrame, step: int, workers: int) -> DataFrame:
    """What is left after `step` batches of each replica: earlier turns go, and workers are renumbered so that the next batch is worker 0's."""
    left = placed.where(F.col("turn") >= step)
    return left.withColumns({"worker": F.pmod(F.col("worker") - step % workers, F.lit(workers)), "turn": F.col("turn") - step})


def worker_seed(seed: int, epoch: Column, replica: Column, worker: Column, replicas: int, workers: int) -> Column:
    return F.lit(seed) + epoch * replicas * workers + replica * workers + worker


def rank_and_replicas(replicas: int | None = None) -> tuple[int, int]:
    """In a task its partition among the replicas; (0, 1) on the driver."""
    from pyspark import TaskContext

    task = TaskContext.get()
    if task is None or replicas is None:
        return 0, 1
    if replicas < 1:
        raise ValueError("there must be a replica")
    return task.partitionId() % replicas, replicas
