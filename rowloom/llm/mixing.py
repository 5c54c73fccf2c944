"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words. Target over size is a document's expected number of
copies: the whole part is taken as it is, the fraction is an inclusion probability. The cube
method moves the probabilities of three documents at a time along the null space of the balancing
constraints (documents, words) until one is 0 or 1, so that sums never change. Groups of a source
do this apart; what each leaves, two documents at most, meets in the next level, and one small
landing problem per source remains.

Nulls: a null text has no words; a null source is a source of its own, last in order; a null id is kept. Rows
without words take nothing. Repeated rows are drawn apart; where more rows than a group holds have one id and
size, which nothing tells apart, they are dealt over groups of their own. Very long texts are counted whole.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most so many times its source's size.
MOST_TIMES = 3
#: Documents of one group of the first level, and groups that meet in the next.
GROUP_ROWS, FAN_IN = 2_000, 1_000
EPS = 1e-9


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", uid_col: str | None = None) -> DataFrame:
    """doc_id, source, size: the number of words between [\\x20\\x09-\\x0D], and `uid` if uid_col names it."""
    common.small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [0 if t is None else len(t.split()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64()), *[b.column(c) for c in more]], ["doc_id", "source", "size", *more])

    more = ["uid"] if uid_col else []
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("binary").alias("text"), *[F.col(uid_col).cast("long").alias(c) for c in more])
    return cols.mapInArrow(count, "doc_id long, source string, size long" + ", uid long" * len(more))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, rank, docs, source_size, target: one row a source, so the windows without a key stay small.

    A target is min(cap, level x weight) with one level for all: sources in order of cap / weight
    fill up first, and the level is what the rest shares by weight.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    out = by_source.withColumns({"rank": F.row_number().over(order), "weight": pick, "cap": F.col("source_size").cast("double") * most_times})
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    out = out.withColumns({
        "before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(everything).cast("double"),
    })
    level = (F.col("total") - F.col("before")) / F.col("rest")
    out = out.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", level.alias("level")))).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return out.select("source", "rank", "docs", "source_size", target.alias("target"))


def flight(prob: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Move probabilities until two at most lie between 0 and 1; both sums are kept."""
    p = list(prob)
    live: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        _move(p, live, u, rng)
        live = [k for k in live if EPS < p[k] < 1 - EPS]
    return p


def _move(p: list[float], ids: list[int], u: tuple[float, ...], rng: random.Random) -> None:
    up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(ids, u, strict=True) if v)
    down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(ids, u, strict=True) if v)
    step = up if rng.random() * (up + down) < down else -down
    for k, v in zip(ids, u, strict=True):
        x = p[k] + step * v
        p[k] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x


def landing(prob: list[float], size: list[float], rng: random.Random) -> list[float]:
    """The last two: keep the words' sum alone, then draw the last one."""
    p = list(prob)
    live = [k for k in range(len(p)) if EPS < p[k] < 1 - EPS]
    while len(live) >= 2 and size[live[0]] and size[live[1]]:
        _move(p, live[:2], (1 / size[live[0]], -1 / size[live[1]]), rng)
        live = [k for k in live if EPS < p[k] < 1 - EPS]
    for k in live:
        p[k] = 1.0 if rng.random() < p[k] else 0.0
    return [float(round(x)) for x in p]


def _cube(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "uid"], na_position="last", kind="stable")
        rng = random.Random(f"{seed}:{pdf['rank'].iat[0]}:{pdf['bucket'].iat[0]}:{pdf['part'].iat[0]}:{last}")
        size = pdf["size"].astype(float).tolist()
        p = flight(pdf["prob"].tolist(), size, rng)
        pdf["prob"] = landing(p, size, rng) if last else p
        return pdf

    return run


def mix(docs: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES, seed: int = 17, **cols: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, and `uid` if uid_col names a column that tells rows apart: one row per input row."""
    sizes, named = word_sizes(docs, **cols), cols.get("uid_col") is not None
    sizes = common.materialize(sizes if named else sizes.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
    targets = common.materialize(source_targets(sizes, weights, most_times), "mix-targets")
    n_sources = targets.count()
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.alias("s").join(common.broadcast_if_small(targets, n_sources).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("doc_id", "uid", "size", "rank", "docs", "source_size", "target", F.floor(times + EPS).cast("long").alias("whole"), times.alias("times"))
    rows = rows.withColumn("prob", F.when(F.col("size") > 0, F.greatest(F.col("times") - F.col("whole"), F.lit(0.0))).otherwise(0.0)).drop("times")
    groups = F.ceil(F.col("docs") / GROUP_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), groups)).drop("docs")
    # rows of one id and size fall into one bucket; where they overfill it, its rows are dealt over parts
    full = rows.groupBy("rank", "bucket").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("parts")).where("parts > 2")
    full = common.materialize(full, "mix-full")
    rows = rows.join(common.broadcast_if_small(full, full.count()), ["rank", "bucket"], "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0)).cast("long")).drop("parts")
    most = targets.agg(F.max(F.ceil(F.col("docs") / GROUP_ROWS))).first()[0] or 1
    done, level = [], 0
    while True:
        last = most <= 1
        rows = common.materialize(rows.groupBy("rank", "bucket", "part").applyInPandas(_cube(seed + level, last), rows.schema), f"mix-level{level}")
        if last:
            break
        done.append(rows.where("prob in (0, 1)"))
        rows = rows.where("prob not in (0, 1)").withColumns({"bucket": F.floor(F.col("bucket") / FAN_IN), "part": F.lit(0).cast("long")})
        most, level = -(-most // FAN_IN), level + 1
    for part in done:
        rows = rows.unionByName(part)
    copies = F.col("whole") + F.col("prob").cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), *["uid"] * named)
