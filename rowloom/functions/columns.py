"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def average_rank(value: str, *partition: str) -> Column:
    """Rank from 1, ties at their mean."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2.0


def softmax(value: str, *partition: str) -> Column:
    w = Window.partitionBy(*partition)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return e / F.sum(e).over(w)


def position(*key: str) -> Column:
    """A seeded order that any engine can repeat: md5 of the parts."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k for k in key]))


def linear_lr(step: Column, warmup: int, total: int) -> Column:
    up = step / float(warmup)
    down = F.greatest(F.lit(0.0), (F.lit(total) - step) / float(max(1, total - warmup)))
    return F.when(step < warmup, up).otherwise(down)


def kl_weight(step: Column, steps: int, least: float = 0.0, most: float = 1.0) -> Column:
    return F.when(step < steps, F.lit(least) + step / float(steps) * (most - least)).otherwise(F.lit(most))


def nb_variance(mu: Column, theta: Column) -> Column:
    """Negative binomial variance mu + mu^2 / theta; 0 where theta is 0."""
    return F.when(theta == 0, 0.0).otherwise(mu + mu * mu / F.nullif(theta, F.lit(0.0)))
