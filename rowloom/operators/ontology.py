"""Ontology operators over edges (parent, child)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: Rounds of doubling: paths of up to 2 ** MOST_ROUNDS steps.
MOST_ROUNDS = 24
#: Most links of an ontology whose neighbourhoods go out with the tasks; the largest ones have some hundred thousand.
MOST_LINKS = 5_000_000
#: Pairs of terms that one task walks, about, and rows of one batch of them.
TASK_PAIRS, WALK_ROWS = 50_000_000, 65_536


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def closure(edges: DataFrame) -> DataFrame:
    """ancestor, descendant, dist (fewest steps), each term its own ancestor; terms may have several parents.

    Paths double each round, so rounds are the logarithm of the depth. A cycle raises ValueError. Loops of a term on itself do not count.
    """
    links = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"))
    terms = links.select(F.col("ancestor").alias("t")).unionByName(links.select(F.col("descendant").alias("t"))).where("t is not null").distinct()
    start = terms.select(F.col("t").alias("ancestor"), F.col("t").alias("descendant"), F.lit(0).alias("dist"))
    start = start.unionByName(links.where("ancestor != descendant").distinct().withColumn("dist", F.lit(1)))
    known, mark = _written(start, "closure"), None
    for _ in range(MOST_ROUNDS + 1):
        other = known.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("ancestor"))
        if not known.where("dist > 0").join(other.join(known.where("dist > 0"), ["ancestor", "descendant"], "left_semi"), ["ancestor", "descendant"], "left_semi").isEmpty():
            raise ValueError("the ontology has a cycle")
        now = known.agg(F.count(F.lit(1)), F.sum("dist")).first()
        if now == mark:
            return known
        mark = now
        x = known.select("ancestor", F.col("descendant").alias("via"), F.col("dist").alias("first"))
        y = known.select(F.col("ancestor").alias("via"), "descendant", F.col("dist").alias("second"))
        known = _written(x.join(y, "via").groupBy("ancestor", "descendant").agg(F.min(F.col("first") + F.col("second")).cast("int").alias("dist")), "closure")
    raise ValueError(f"paths are longer than 2 ** {MOST_ROUNDS}")


def distances(edges: DataFrame, unknown: str | None = None, sources: Column | None = None) -> DataFrame:
    """a, b, dist: fewest undirected steps; pairs that are not connected have no row. `unknown` names one more term, near none; `sources`, a condition on a, the terms to start from.

    Terms are dealt over tasks, and each walks the neighbourhoods of all terms, which go out once after a check of their number: one job, whatever the depth.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("parent").alias("p"), F.col("child").alias("c")).where("p is not null and c is not null")
    if both.count() > MOST_LINKS:
        raise ValueError(f"more than {MOST_LINKS} links")
    links = both.distinct().toPandas()
    names = sorted({*links["p"], *links["c"], *([unknown] if unknown else [])})
    code = {n: k for k, n in enumerate(names)}
    p, c = (links[x].map(code).to_numpy(int) for x in ("p", "c"))
    tails, heads = np.concatenate([p, c]), np.concatenate([c, p])
    order = np.argsort(tails, kind="stable")
    shared = spark.sparkContext.broadcast((np.searchsorted(tails[order], np.arange(len(names) + 1)), heads[order], names))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, near, every = shared.value
        text = pa.array(every)
        for b in batches:
            for source in b.column(0).to_pylist():
                dist = np.full(len(every), -1, np.int32)
                dist[source], front, step = 0, np.array([source]), 0
                while len(front):
                    step += 1
                    sizes = begin[front + 1] - begin[front]
                    at = np.repeat(begin[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    front = np.unique(near[at])
                    front = front[dist[front] < 0]
                    dist[front] = step
                met = np.flatnonzero(dist >= 0)
                for s in range(0, len(met), WALK_ROWS):
                    some = met[s : s + WALK_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.repeat(text[source], len(some)), text.take(pa.array(some)), pa.array(dist[some])], ["a", "b", "dist"])

    kind = edges.schema["parent"].dataType.simpleString()
    start = range(len(names))
    if sources is not None:
        named = spark.createDataFrame(pa.table({"at": pa.array(start, pa.int64()), "a": pa.array(names, pa.string())})).where(sources)
        start = [r[0] for r in named.select("at").collect()]  # terms at most
    parts = min(max(len(start), 1), max(4 * spark.sparkContext.defaultParallelism, -(-len(start) * len(names) // TASK_PAIRS)))
    at = spark.range(len(names), numPartitions=parts) if sources is None else spark.sparkContext.parallelize([(k,) for k in start], parts).toDF("id long")
    return at.mapInArrow(walk, f"a {kind}, b {kind}, dist int")


def with_ancestors(subset: DataFrame, clo: DataFrame) -> DataFrame:
    """term: the subset and all its ancestors."""
    return clo.join(F.broadcast(subset.select(F.col("term").alias("descendant"))), "descendant").select(F.col("ancestor").alias("term")).distinct()


def leaves(clo: DataFrame) -> DataFrame:
    return clo.groupBy(F.col("ancestor").alias("term")).count().where("count = 1").select("term")


def coarse_map(clo: DataFrame, coarse: DataFrame) -> DataFrame:
    """term, label for each coarse(label, term) and its descendants; other terms are 'other'."""
    hit = clo.join(F.broadcast(coarse.select("label", F.col("term").alias("ancestor"))), "ancestor").select(F.col("descendant").alias("term"), "label").distinct()
    rest = clo.select(F.col("descendant").alias("term")).distinct().join(hit, "term", "left_anti").withColumn("label", F.lit("other"))
    return hit.unionByName(rest)


def propagate_probs(probs: DataFrame, clo: DataFrame) -> DataFrame:
    """row, term, p: the clamped sum over a term's descendants of probs(row, term, p)."""
    up = F.broadcast(clo.select("ancestor", F.col("descendant").alias("term")))
    return probs.join(up, "term").groupBy("row", F.col("ancestor").alias("term")).agg(F.least(F.lit(1.0), F.sum("p")).alias("p"))


def propagate_logits(logits: DataFrame, clo: DataFrame) -> DataFrame:
    """row, term, logit: logsumexp over descendants less logsumexp over all, each around its own maximum."""
    up = F.broadcast(clo.select("ancestor", F.col("descendant").alias("term")))
    j = logits.join(up, "term").groupBy("row", F.col("ancestor").alias("term")).agg(F.max("logit").alias("m"), F.collect_list("logit").alias("all"))
    own = F.col("m") + F.log(F.aggregate("all", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("m"))))
    top = logits.groupBy("row").agg(F.max("logit").alias("tm"), F.collect_list("logit").alias("every"))
    every = F.col("tm") + F.log(F.aggregate("every", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("tm"))))
    return j.join(top, "row").select("row", "term", (own - every).alias("logit"))


def smoothed_counts(counts: DataFrame, clo: DataFrame, p: float) -> DataFrame:
    """term, n: counts(term, n) spread over ancestors with weights p (1 - p)^dist that add up to 1, in whole numbers."""
    w = clo.select(F.col("descendant").alias("term"), "ancestor", (p * F.pow(F.lit(1 - p), "dist")).alias("w"))
    total = w.groupBy("term").agg(F.sum("w").alias("t"))
    share = w.join(total, "term")
    return counts.join(F.broadcast(share), "term").groupBy(F.col("ancestor").alias("term")).agg(F.floor(F.sum(F.col("n") * F.col("w") / F.col("t")) + 1e-9).alias("n"))


def with_unknown(clo: DataFrame, name: str = "unknown") -> DataFrame:
    """The closure and a term that is only its own ancestor."""
    return clo.unionByName(clo.sparkSession.createDataFrame([(name, name, 0)], "ancestor string, descendant string, dist int"))


def restricted(clo: DataFrame, observed: DataFrame) -> DataFrame:
    """The closure among observed terms and their ancestors, without roots."""
    terms = with_ancestors(observed, clo)
    roots = clo.groupBy("descendant").count().where("count = 1").select("descendant").join(clo.where("dist > 0").select(F.col("ancestor").alias("descendant")).distinct(), "descendant")
    keep = terms.join(roots, terms.term == roots.descendant, "left_anti")
    out = clo.join(keep.select(F.col("term").alias("ancestor")), "ancestor", "left_semi")
    return out.join(keep.select(F.col("term").alias("descendant")), "descendant", "left_semi").select("ancestor", "descendant", "dist")


def distance_slice(dist: DataFrame, names: list[str]) -> DataFrame:
    """i, j, dist among the named terms, numbered in that order; unknown names are an error."""
    side = dist.sparkSession.createDataFrame(list(enumerate(names)), "i int, name string")
    missing = sorted(r[0] for r in side.join(dist, F.col("name") == F.col("a"), "left_anti").select("name").collect())
    if missing:
        raise ValueError(f"terms without distances: {missing}")
    out = dist.join(F.broadcast(side.select("i", F.col("name").alias("a"))), "a").join(F.broadcast(side.select(F.col("i").alias("j"), F.col("name").alias("b"))), "b")
    return out.select("i", "j", "dist")


def nonleaf_first(clo: DataFrame) -> DataFrame:
    """term, leaf, place: terms with others below them in order of name, then the leaves. Terms are a vocabulary, so one window numbers them."""
    below = clo.groupBy(F.col("ancestor").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    leaf = F.col("n") == 1
    return below.select("term", leaf.alias("leaf"), (F.row_number().over(Window.orderBy(leaf, "term")) - 1).alias("place"))


def write_distances(dist: DataFrame, folder: str) -> None:
    """A row a term with its distances to all terms in order of name; -1 where there is no path."""
    names = dist.select(F.col("a").alias("b")).distinct()
    every = names.select(F.col("b").alias("a")).crossJoin(F.broadcast(names))  # terms x terms, as the matrix is
    full = every.join(dist, ["a", "b"], "left").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("dist", F.lit(-1)).alias("d")))).alias("row"))
    full.select("a", F.transform("row", lambda r: r["d"]).alias("dist")).write.parquet(folder)


def read_distances(spark: SparkSession, folder: str) -> DataFrame:
    """a, b, dist of pairs with a path."""
    rows = spark.read.parquet(folder)
    names = rows.agg(F.sort_array(F.collect_list("a")).alias("names"))  # the terms
    pairs = rows.crossJoin(F.broadcast(names)).select("a", F.explode(F.arrays_zip(F.col("names").alias("b"), F.col("dist").alias("d"))).alias("p"))
    return pairs.select("a", F.col("p.b").alias("b"), F.col("p.d").alias("dist")).where("dist >= 0")
