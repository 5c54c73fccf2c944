"""Highly variable genes from aggregated moments: three selections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder


def seurat_dispersion(moments: DataFrame, n_bins: int = 20, batch: str | None = None) -> DataFrame:
    """Adds mean (log1p), dispersion (log) and dispersion_norm to rows (gene_id, mean, var): z within equal-width bins of the mean."""
    part = [batch] if batch else []
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    ratio = F.col("var") / mean
    d = moments.withColumns({"dispersion": F.when(ratio > 0, F.ln(F.when(ratio > 0, ratio))), "mean": F.log1p(mean)})
    every = Window.partitionBy(*part)
    lo, hi = F.min("mean").over(every), F.max("mean").over(every)
    place = F.ceil((F.col("mean") - lo) / F.nullif(hi - lo, F.lit(0.0)) * n_bins)
    d = d.withColumn("mean_bin", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(n_bins), place)), F.lit((n_bins + 1) // 2)).cast("int"))
    w = Window.partitionBy(*part, "mean_bin")
    avg, std = F.avg("dispersion").over(w), F.stddev_samp("dispersion").over(w)
    z = F.when(std.isNull(), F.col("dispersion") / F.nullif(avg, F.lit(0.0))).otherwise((F.col("dispersion") - avg) / F.nullif(std, F.lit(0.0)))
    return d.withColumn("dispersion_norm", z)


def seurat_top(d: DataFrame, n_top: int) -> DataFrame:
    """Flags genes at or above the n-th largest normalised dispersion; ties stay."""
    n = F.rank().over(Window.orderBy(F.col("dispersion_norm").desc_nulls_last()))
    cut = d.select("dispersion_norm", n.alias("place")).where(f"place <= {int(n_top)} and dispersion_norm is not null").agg(F.min("dispersion_norm").alias("cut"))
    return d.crossJoin(F.broadcast(cut)).withColumn("highly_variable", F.coalesce("dispersion_norm", F.lit(0.0)) >= F.col("cut")).drop("cut")


def seurat_cutoff(d: DataFrame, min_disp=0.5, max_disp=float("inf"), min_mean=0.0125, max_mean=3.0) -> DataFrame:
    z = F.coalesce("dispersion_norm", F.lit(0.0))
    return d.withColumn("dispersion_norm", z).withColumn("highly_variable", (F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.col("dispersion_norm") > min_disp) & (F.col("dispersion_norm") < max_disp))


def seurat_batched(moments: DataFrame, n_top: int, n_bins: int = 20) -> DataFrame:
    """Per batch top genes; genes by number of batches, then mean dispersion: exactly n_top are flagged."""
    d = seurat_dispersion(moments, n_bins, "batch")
    n = F.rank().over(Window.partitionBy("batch").orderBy(F.col("dispersion_norm").desc_nulls_last()))
    d = d.withColumn("top", ((n <= n_top) & F.col("dispersion_norm").isNotNull()).cast("int"))
    g = d.groupBy("gene_id").agg(F.sum("top").alias("nbatches"), F.avg(F.coalesce("dispersion_norm", F.lit(0.0))).alias("dispersion_norm"))
    place = F.row_number().over(Window.orderBy(F.desc("nbatches"), F.col("dispersion_norm").desc_nulls_last(), "gene_id"))
    return g.withColumn("highly_variable", place <= n_top)


def kotliar(moments: DataFrame, n_top: int | None = None, threshold: float | None = None, minimal_mean: float = 0.5) -> DataFrame:
    """Fano factor over the fit A^2 mean + B^2 of rows (gene_id, mean, var)."""
    d = moments.withColumn("fano", F.col("var") / F.nullif("mean", F.lit(0.0)))
    top20 = d.orderBy(F.desc("mean"), "gene_id").limit(20)
    a = top20.agg(F.min(F.sqrt("var") / F.nullif("mean", F.lit(0.0))).alias("a"))
    q = d.agg(*[F.percentile(c, p).alias(f"{c}_{n}") for c in ("mean", "fano") for n, p in (("lo", 0.1), ("hi", 0.9))])
    box = d.crossJoin(F.broadcast(q)).where("mean > mean_lo and mean < mean_hi and fano > fano_lo and fano < fano_hi")
    b = box.agg(F.sqrt(F.median("fano")).alias("b"), F.stddev_samp("fano").alias("spread"))
    d = d.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).withColumn("expected", F.col("a") * F.col("a") * F.col("mean") + F.col("b") * F.col("b"))
    d = d.withColumn("ratio", F.col("fano") / F.col("expected"))
    if n_top is not None:
        flag = F.row_number().over(Window.orderBy(F.col("ratio").desc_nulls_last(), "gene_id")) <= n_top
    else:
        limit = F.lit(threshold) if threshold is not None else 1 + F.col("spread")
        flag = F.coalesce((F.col("ratio") > limit) & (F.col("mean") > minimal_mean), F.lit(False))
    return d.withColumn("highly_variable", flag).drop("a", "b", "spread")


def by_batch(m: DataFrame, cells: DataFrame) -> DataFrame:
    """batch, gene_id, x of the matrix, written once for the passes over it."""
    folder = new_folder(m.sparkSession, "batched")
    m.join(cells.select("cell_id", "batch"), "cell_id").select("batch", "gene_id", "x").write.parquet(folder)
    return m.sparkSession.read.parquet(folder)


def _batched(m: DataFrame, cells: DataFrame) -> DataFrame:
    return m if "batch" in m.columns else m.join(cells.select("cell_id", "batch"), "cell_id")


def v3_moments(m: DataFrame, cells: DataFrame) -> DataFrame:
    """batch, gene_id, n, mean, var: sample variance over the batch's cells. m is the matrix or what by_batch made of it."""
    n = cells.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    s = _batched(m, cells).groupBy("batch", "gene_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    s = s.join(F.broadcast(n), "batch")
    return s.select("batch", "gene_id", "n", (F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("var"))


def _local_quadratic(at: float, x: np.ndarray, y: np.ndarray, h: float) -> float:
    d = np.abs(x - at)
    w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, None) ** 3)
    near = w > 0
    u, w = x[near] - at, w[near]
    a = np.stack([np.ones(len(u)), u, u**2], axis=1)
    return np.linalg.lstsq(a * w[:, None], y[near] * w, rcond=None)[0][0]


def _reach(at: np.ndarray, xs: np.ndarray, near: int) -> np.ndarray:
    """Distance of the `near`-th nearest of sorted xs: the run of so many whose farther end is nearest."""
    runs = len(xs) - near + 1
    s = np.searchsorted(xs[:runs] + xs[near - 1 :], 2 * at)
    tried = [np.clip(s + k, 0, runs - 1) for k in (-1, 0, 1)]
    return np.min([np.maximum(at - xs[t], xs[t + near - 1] - at) for t in tried], axis=0)


#: Targets whose sums are added up at a time.
LOESS_CHUNK = 16_384
#: Share of a well-placed determinant below which a fit is solved from its points.
LEAST_DETERMINANT = 1e-6
#: Mean of w t^4 below which the powers' sums cancel too far.
LEAST_SPREAD = 1e-4


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratics with tricube weights over the nearest span of points, a fit at each.

    On either side of a point tricube weights are a polynomial of the distance, so a fit needs sums of powers only. Runs of 1, 2, 4, ... sorted
    points have theirs around their own middle; the neighbourhood is made of two runs of each length at most on a side, moved to the point. So
    work grows with n log n. Fits whose points hardly tell a quadratic are solved from the points.
    """
    n, k = len(x), max(4, int(np.ceil(span * len(x))))
    order = np.argsort(x, kind="stable")
    xs, level = x[order], float(np.mean(y))
    ys = y[order] - level
    at, back = np.unique(x, return_inverse=True)
    h = np.maximum(_reach(at, xs, min(k, n)), 1e-12)
    middle = np.searchsorted(xs, at, side="right")
    sides = [(1.0, middle, np.searchsorted(xs, at + h, side="right")), (-1.0, np.searchsorted(xs, at - h), middle.copy())]
    count = sides[0][2] - sides[1][1]
    sums = np.zeros((8, len(at)))  # w, w t .. w t^4; w y, w y t, w y t^2

    def add(sign: float, hit: np.ndarray, runs: np.ndarray) -> None:
        for c in range(0, len(hit), LOESS_CHUNK):
            to, b = hit[c : c + LOESS_CHUNK], runs[c : c + LOESS_CHUNK]
            a, r = sign * (centre[b] - at[to]) / h[to], sign * radius[b] / h[to]
            up, out = [np.ones(len(to))], np.ones(len(to))
            for _ in range(13):
                up.append(up[-1] * a)
            part = [[out * m[0, b]] for m in (powers, weighted)]
            scaled = [[out * m[0, b]] for m in (powers, weighted)]
            for p in range(1, 14):
                out = out * r
                for moved, own, m in zip(part, scaled, (powers, weighted), strict=True):
                    if p < len(m):
                        own.append(out * m[p, b])
                        moved.append(sum(math.comb(p, j) * up[p - j] * own[j] for j in range(p + 1)))
            cube = lambda m, q: m[q] - 3 * m[q + 3] + 3 * m[q + 6] - m[q + 9]
            for q in range(5):
                sums[q, to] += sign**q * cube(part[0], q)
            for q in range(3):
                sums[5 + q, to] += sign**q * cube(part[1], q)

    size = 1
    while size <= n:
        whole = n // size
        blocks = xs[: whole * size].reshape(whole, size)
        centre, radius = (blocks[:, 0] + blocks[:, -1]) / 2, (blocks[:, -1] - blocks[:, 0]) / 2
        z = (blocks - centre[:, None]) / np.where(radius > 0, radius, 1.0)[:, None]
        own, up = ys[: whole * size].reshape(whole, size), np.ones_like(z)
        powers, weighted = np.empty((14, whole)), np.empty((12, whole))
        for p in range(14):
            powers[p] = up.sum(1)
            if p < 12:
                weighted[p] = (up * own).sum(1)
            up = up * z
        for s, (sign, lo, hi) in enumerate(sides):
            hit = np.flatnonzero((lo < hi) & (lo % 2 == 1))
            add(sign, hit, lo[hit])
            lo[hit] += 1
            hit = np.flatnonzero((lo < hi) & (hi % 2 == 1))
            hi[hit] -= 1
            add(sign, hit, hi[hit])
            sides[s] = (sign, lo // 2, hi // 2)
        size *= 2
    s0, s1, s2, s3, s4, t0, t1, t2 = sums
    c0, c1, c2 = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
    det = s0 * c0 + s1 * c1 + s2 * c2
    sure = (det > LEAST_DETERMINANT * s0 * s2 * s4) & (s4 > LEAST_SPREAD * count)
    out = (t0 * c0 + t1 * c1 + t2 * c2) / np.where(sure, det, 1.0)
    for i in np.flatnonzero(~sure):
        out[i] = _local_quadratic(at[i], xs, ys, h[i])
    return out[back] + level


def _cuts(xs: np.ndarray, least: int) -> list[float]:
    """Vertices between the ends of sorted xs: cells are halved at their median until they hold `least` points at most."""
    out, todo = [], [(0, len(xs))]
    while todo:
        lo, hi = todo.pop()
        mid = (lo + hi) // 2
        if hi - lo > least and xs[mid - 1] < xs[mid]:
            out.append((xs[mid - 1] + xs[mid]) / 2)
            todo += [(lo, mid), (mid, hi)]
        elif hi - lo > least and xs[lo] < xs[hi - 1]:  # ties over the median: cut beside them
            at = lo + int(np.searchsorted(xs[lo:hi], xs[mid], side="left")) or lo
            at = at if at > lo else lo + int(np.searchsorted(xs[lo:hi], xs[mid], side="right"))
            out.append((xs[at - 1] + xs[at]) / 2)
            todo += [(lo, at), (at, hi)]
    return out


def _at_vertex(v: float, xs: np.ndarray, ys: np.ndarray, near: int, places: np.ndarray) -> tuple[float, float]:
    """Value and slope of the local quadratic over the `near` nearest points of sorted xs, and over three of their places at least."""
    d = np.abs(xs - v)
    h = max(np.partition(d, near - 1)[near - 1], 1.001 * np.partition(np.abs(places - v), 2)[2])
    lo, hi = np.searchsorted(xs, [v - h, v + h])
    u, w = (xs[lo:hi] - v) / h, 1 - (d[lo:hi] / h) ** 3
    w = np.sqrt(np.clip(w, 0, None) ** 3)
    c = np.linalg.lstsq(np.stack([np.ones(len(u)), u, u * u], axis=1) * w[:, None], ys[lo:hi] * w, rcond=None)[0]
    return float(c[0]), float(c[1] / h)


def loess_interpolated(x: np.ndarray, y: np.ndarray, span: float = 0.3, cell: float = 0.2) -> np.ndarray:
    """LOESS on an interpolation tree: local quadratics at the vertices of cells of at most span x cell of the points, and
    between two vertices the cubic that has both values and slopes. Few fits, whatever the number of points."""
    n = len(x)
    near, least = min(n, int(n * span + 1e-5)), max(1, int(n * span * cell))
    if near < 3:
        raise ValueError(f"a span of {span} holds {near} of {n} points")
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    places = np.unique(xs)
    if len(places) < 3:
        raise ValueError("a quadratic needs three places")
    margin = 0.1 * (xs[-1] - xs[0]) + 1e-10 * np.abs(xs).max() + 1e-30
    vertices = np.array([xs[0] - margin, *sorted(_cuts(xs, least)), xs[-1] + margin])
    value, slope = np.array([_at_vertex(v, xs, ys, near, places) for v in vertices]).T
    k = np.clip(np.searchsorted(vertices, xs, side="right") - 1, 0, len(vertices) - 2)
    width = vertices[k + 1] - vertices[k]
    t = (xs - vertices[k]) / width
    fitted = (1 + 2 * t) * (1 - t) ** 2 * value[k] + t * (1 - t) ** 2 * width * slope[k] + t * t * (3 - 2 * t) * value[k + 1] - t * t * (1 - t) * width * slope[k + 1]
    out = np.empty(n)
    out[order] = fitted
    return out


def loess_with_jitter(x: np.ndarray, y: np.ndarray, span: float = 0.3, least: float = 1e-18, most: float = 1e-6, seed: int = 0) -> np.ndarray:
    """The interpolated fit; where it fails, again with uniform jitter on x, ten times as large each time up to `most`."""
    rng, jitter = np.random.default_rng(seed), 0.0
    while jitter <= most * (1 + 1e-9):
        try:
            return loess_interpolated(x if jitter == 0 else x + rng.uniform(-jitter, jitter, len(x)), y, span)
        except ValueError:
            jitter = least if jitter == 0 else jitter * 10
    raise ValueError(f"LOESS failed with jitter up to {most}")


def loess_trend(mo: DataFrame, span: float = 0.3, surface: str = "direct") -> DataFrame:
    """Adds est by LOESS in each batch; a batch has one row a gene. `surface` is direct (a fit at each gene) or interpolate (few fits)."""
    if surface not in ("direct", "interpolate"):
        raise ValueError(f"{surface} is no surface")
    curve = loess if surface == "direct" else loess_with_jitter

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("gene_id")
        f["est"] = 0.0
        ok = (f["var"] > 0) & (f["mean"] > 0)
        if ok.sum() >= (4 if surface == "direct" else np.ceil(3 / span)):
            f.loc[ok, "est"] = curve(np.log10(f.loc[ok, "mean"].to_numpy()), np.log10(f.loc[ok, "var"].to_numpy()), span)
        return f

    return mo.groupBy("batch").applyInPandas(fit, mo.schema.simpleString()[7:-1] + ",est:double")


def moment_problems(moments: DataFrame, batch: str | None = None) -> DataFrame:
    """batch (null without batches), problem, genes: what makes moments(gene_id, mean, var[, batch]) unfit for gene selection.

    Unnamed and repeated genes, genes without a mean or variance, and, over batches, genes that a batch lacks and another has.
    """
    if missing := [c for c in ("gene_id", "mean", "var", *([batch] if batch else [])) if c not in moments.columns]:
        raise ValueError(f"moments have no columns {missing}")
    b = F.col(batch).cast("string") if batch else F.lit(None).cast("string")
    rows = moments.select(b.alias("batch"), "gene_id", "mean", "var")
    report = lambda df, text: df.groupBy("batch").agg(F.count(F.lit(1)).alias("genes")).select("batch", F.lit(text).alias("problem"), "genes")
    out = report(rows.where("gene_id is null"), "unnamed")
    out = out.unionByName(report(rows.groupBy("batch", "gene_id").count().where("count > 1 and gene_id is not null"), "repeated"))
    out = out.unionByName(report(rows.where("mean is null or var is null"), "without moments"))
    if batch:
        every = rows.agg(F.count_distinct("gene_id").alias("all")).select("all")
        lacks = rows.groupBy("batch").agg(F.count_distinct("gene_id").alias("own")).crossJoin(F.broadcast(every))  # one row
        out = out.unionByName(lacks.where("own < all").select("batch", F.lit("missing").alias("problem"), (F.col("all") - F.col("own")).alias("genes")))
    return out


def check_moments(moments: DataFrame, n_top: int | None = None, batch: str | None = None) -> None:
    """ValueError for moments that have a problem, or fewer genes than are wanted."""
    found = moment_problems(moments, batch).orderBy("batch", "problem").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['genes']} genes {r['problem']}" + (f" in {r['batch']}" if r["batch"] else "") for r in found))
    if n_top is not None and not 0 < n_top <= moments.select("gene_id").distinct().count():
        raise ValueError(f"{n_top} genes cannot be flagged")


def v3_clip(mo: DataFrame, least_cells: int = 2) -> DataFrame:
    """Adds reg_std and clip = reg_std sqrt(n) + mean; infinite for batches that are too small."""
    std = F.sqrt(F.pow(F.lit(10.0), F.col("est")))
    return mo.withColumn("reg_std", std).withColumn("clip", F.when(F.col("n") < least_cells, F.lit(float("inf"))).otherwise(F.col("reg_std") * F.sqrt("n") + F.col("mean")))


def v3_norm_var(m: DataFrame, cells: DataFrame, clip: DataFrame) -> DataFrame:
    """batch, gene_id, norm_var from clipped sums; zeros add nothing as clips are not negative."""
    c, known = F.least("x", "clip"), ["n", "mean", "reg_std"]
    x = _batched(m, cells).join(clip.select("batch", "gene_id", "clip", *known), ["batch", "gene_id"])
    s = x.groupBy("batch", "gene_id").agg(F.sum(c).alias("s"), F.sum(c * c).alias("q"), *[F.max(k).alias(k) for k in known])
    top = F.col("n") * F.col("mean") * F.col("mean") + F.col("q") - 2 * F.col("mean") * F.col("s")
    return s.select("batch", "gene_id", "n", F.coalesce(top / F.nullif((F.col("n") - 1) * F.col("reg_std") * F.col("reg_std"), F.lit(0.0)), F.lit(0.0)).alias("norm_var"))


def v3_rank(nv: DataFrame, n_top: int, flavor: str = "seurat_v3", least_cells: int = 2) -> DataFrame:
    """gene_id, nbatches, median_rank, norm_var, highly_variable. Variances equal to nine decimals tie, so the order of summing decides nothing; the least gene goes first."""
    nv = nv.where(F.col("n") >= least_cells)
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.round("norm_var", 9).desc(), "gene_id")) - 1
    r = nv.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") < n_top, F.col("rank")))
    g = r.groupBy("gene_id").agg(F.count("rank").alias("nbatches"), F.percentile("rank", 0.5).alias("median_rank"), F.avg("norm_var").alias("norm_var"))
    by_rank, by_n = F.col("median_rank").asc_nulls_last(), F.desc("nbatches")
    order = [by_rank, by_n] if flavor == "seurat_v3" else [by_n, by_rank]
    return g.withColumn("highly_variable", F.row_number().over(Window.orderBy(*order, "gene_id")) <= n_top)
