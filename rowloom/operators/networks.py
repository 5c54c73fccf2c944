"""Scoring cells with a trained variational network: encoder, decoder and likelihood as products of Arrow batches with weights.

Rows are sparse cells (`lowrank.sparse_rows`) with the code of their batch; weights go out with the tasks once,
after a check of their size, and each chunk of rows is a few dense products. Nothing of cells x genes is
shuffled or kept: what is asked for is a row a cell, or sums a gene. Where a softmax of all genes follows a latent of few
numbers at once, and cells are many, sums over genes go through `surfaces` instead of a product of cells x genes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lowrank import _times
from .surfaces import Surface
from .transforms import uniform

#: Bytes of weights that go out with the tasks.
MOST_BYTES = 1 << 30
#: Numbers of a dense chunk (rows x genes).
CHUNK = 1 << 17
#: Numbers (rows x genes) that one task makes, about.
TASK_NUMBERS = 1 << 31
#: Numbers (rows x genes) up to which products are made as they are.
DENSE_NUMBERS = 1 << 27
#: Rows of a chunk that meets a surface's nodes.
SURFACE_ROWS = 4096
#: Numbers that a node of a surface takes for the cells' sizes, about: some pieces with their nodes.
_SIZES = 128
EPS = 1e-10


@dataclass
class Layer:
    """x W + bias + the row's own shift by its code; then layer norm or batch norm (stored mean and variance), then an activation."""

    weight: np.ndarray
    bias: np.ndarray | None = None
    shift: np.ndarray | None = None  # codes x out
    norm: str | None = None
    stored: tuple[np.ndarray, np.ndarray] | None = None
    activation: str | None = None
    eps: float = 1e-5

    def __post_init__(self):
        if self.norm not in (None, "layer", "batch") or self.activation not in (None, "relu", "softplus", "softmax"):
            raise ValueError("unknown norm or activation")
        if (self.norm == "batch") != (self.stored is not None):
            raise ValueError("batch norm, and it alone, has a stored mean and variance")

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in (self.weight, self.bias, self.shift) if a is not None)

    def after(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What follows the product, in its place."""
        if self.bias is not None:
            h += self.bias
        if self.shift is not None:
            known = (codes >= 0) & (codes < len(self.shift))
            h += np.where(known[:, None], self.shift[np.where(known, codes, 0)], 0.0)  # an unknown batch has no shift
        if self.norm == "layer":
            h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + self.eps)
        elif self.norm == "batch":
            h = (h - self.stored[0]) / np.sqrt(self.stored[1] + self.eps)
        if self.activation == "relu":
            h = np.maximum(h, 0)
        elif self.activation == "softplus":
            h = np.logaddexp(h, 0)
        elif self.activation == "softmax":
            h -= h.max(1, keepdims=True)
            np.exp(h, out=h)
            h /= h.sum(1, keepdims=True)
        return h

    def __call__(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.after(h @ self.weight, codes)


@dataclass
class Network:
    """Encoder layers, heads of the latent mean and log variance; decoder layers, the layer of expected shares, inverse dispersion by gene or by batch and gene."""

    genes: list
    mean: Layer
    encoder: list[Layer] = field(default_factory=list)
    log_var: Layer | None = None
    decoder: list[Layer] = field(default_factory=list)
    scale: Layer | None = None
    theta: np.ndarray | None = None  # genes, or codes x genes
    log_input: bool = True
    var_eps: float = 1e-4

    def checked(self) -> Network:
        layers = [*self.encoder, self.mean, *self.decoder, *[x for x in (self.log_var, self.scale) if x is not None]]
        need = sum(x.size for x in layers) + (self.theta.nbytes if self.theta is not None else 0)
        if need > MOST_BYTES:
            raise ValueError(f"{need} bytes of weights are more than go out with tasks")
        return self

    def latent(self, rows: int, row: np.ndarray, places: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Mean and variance of the latent of sparse rows."""
        values = np.log1p(values) if self.log_input else values
        first = self.encoder[0] if self.encoder else None
        if first is not None:
            h = first.after(_times(rows, row, places, values, first.weight), codes)
            for layer in self.encoder[1:]:
                h = layer(h, codes)
            mean, var = self.mean(h, codes), self.log_var(h, codes) if self.log_var else None
        else:
            mean = self.mean.after(_times(rows, row, places, values, self.mean.weight), codes)
            var = self.log_var.after(_times(rows, row, places, values, self.log_var.weight), codes) if self.log_var else None
        return mean, None if var is None else np.exp(var) + self.var_eps

    def shares(self, z: np.ndarray, codes: np.ndarray) -> np.ndarray:
        for layer in self.decoder:
            z = layer(z, codes)
        return self.scale(z, codes)

    @property
    def plain(self) -> bool:
        """Whether a softmax of all genes follows the latent at once."""
        return self.scale is not None and not self.decoder and self.scale.shift is None and self.scale.norm is None and self.scale.activation == "softmax"

    def dispersion(self, codes: np.ndarray) -> np.ndarray:
        return self.theta if self.theta.ndim == 1 else self.theta[codes]


def coded(rows: DataFrame, cells: DataFrame, categories: list[str], column: str) -> DataFrame:
    """rows with `code`, the place of each cell's category (-1 if it has none of them)."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(categories)), f"code int, `{column}` string")
    codes = cells.select("cell_id", column).join(F.broadcast(table), column, "left").select("cell_id", F.coalesce("code", F.lit(-1)).alias("code"))
    return rows.join(codes, "cell_id")


def noise(size: int, seed: int = 0) -> Column:
    """`size` standard normal numbers of each cell, the same on any partitioning."""
    one = lambda k: F.sqrt(-2 * F.log(1 - uniform(seed + 2 * k, "cell_id"))) * F.cos(2 * math.pi * uniform(seed + 2 * k + 1, "cell_id"))
    return F.array(*[one(k) for k in range(size)])


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """rows in as many tasks as their products need: sparse rows are few bytes, by which Spark would give them to few tasks."""
    parts = -(-rows.count() * width // TASK_NUMBERS)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), "cell_id") if parts > 1 else rows


def _each(rows: DataFrame, schema: str, width: int, run: Callable[..., Iterator[list[pa.Array]]], extra: bool = False, step: int | None = None) -> DataFrame:
    """run(cell ids, codes, row, places, values[, noise]) for chunks of `step` rows, spread over all cores, or else of about CHUNK / width rows."""
    names = ["cell_id", "code", "at", "x", *(["noise"] if extra else [])]
    out_names = [p.split()[0] for p in schema.split(", ")]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = step or max(1, CHUNK // width)
        for whole in batches:
            for begin in range(0, whole.num_rows, size):
                b = whole.slice(begin, size)
                sizes = np.asarray(b.column(2).value_lengths())
                row = np.repeat(np.arange(len(sizes)), sizes)
                more = [np.asarray(b.column(4).flatten()).reshape(len(sizes), -1)] if extra else []
                for cols in run(b.column(0), np.asarray(b.column(1)), row, b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(), *more):
                    yield pa.RecordBatch.from_arrays(cols, out_names)

    return (_spread(rows.select(*names)) if step else _dealt(rows.select(*names), width)).mapInArrow(part, schema)


def _cell(rows: DataFrame) -> str:
    return "cell_id " + rows.schema["cell_id"].dataType.simpleString()


def encode(rows: DataFrame, net: Network, samples: int | None = None) -> DataFrame:
    """cell_id, mean, var (arrays; var is null without its head), and `sample` = mean + sd noise if `samples` gives a seed."""
    net.checked()
    size, drawn = net.mean.weight.shape[1], samples is not None
    if drawn and net.log_var is None:
        raise ValueError("a sample needs the variance")
    rows = rows.withColumn("noise", noise(size, samples)) if drawn else rows
    kind = pa.list_(pa.float64())

    def run(ids, codes, row, places, values, draws=None):
        mean, var = net.latent(len(ids), row, places, values, codes)
        cols = [ids, pa.array(list(mean), kind), pa.array(list(var), kind) if var is not None else pa.nulls(len(ids), kind)]
        yield cols + ([pa.array(list(mean + np.sqrt(var) * draws), kind)] if drawn else [])

    width = max([x.weight.shape[1] for x in [*net.encoder, net.mean]])
    return _each(rows, f"{_cell(rows)}, mean array<double>, var array<double>" + ", sample array<double>" * drawn, width, run, drawn)


def expected(rows: DataFrame, net: Network, places: list[int] | None = None, code: int | None = None, library: float | None = None) -> DataFrame:
    """cell_id, expected: the decoder's means of the genes at `places` for each cell's latent mean, all cells in batch `code` and of size `library` if given."""
    net.checked()
    keep = np.arange(len(net.genes)) if places is None else np.array(places, int)

    def run(ids, codes, row, at, values):
        z, _ = net.latent(len(ids), row, at, values, codes)
        own = codes if code is None else np.full(len(codes), code)
        total = np.bincount(row, values, len(ids)) if library is None else np.full(len(ids), library)
        yield [ids, pa.array(list(total[:, None] * net.shares(z, own)[:, keep]), pa.list_(pa.float64()))]

    return _each(rows, f"{_cell(rows)}, expected array<double>", len(net.genes), run)


def expected_by_gene(rows: DataFrame, net: Network, code: int | None = None, library: float | None = None) -> DataFrame:
    """at, n, s: sums of `expected` over all cells; each task adds up its own, so genes x tasks rows move."""
    net.checked()
    size = len(net.genes)
    if net.plain and (found := _surface(rows, net, library=library)):
        return _expected_by_gene(rows, net, *found, library)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, step = 0, np.zeros(size), max(1, CHUNK // size)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                b = whole.slice(begin, step)
                sizes = np.asarray(b.column(1).value_lengths())
                row, codes, values = np.repeat(np.arange(len(sizes)), sizes), np.asarray(b.column(0)), b.column(2).flatten().to_numpy()
                z, _ = net.latent(len(sizes), row, b.column(1).flatten().to_numpy(), values, codes)
                total = np.bincount(row, values, len(sizes)) if library is None else np.full(len(sizes), library)
                s += total @ net.shares(z, codes if code is None else np.full(len(codes), code))
                n += len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(s)], ["at", "n", "s"])

    return _dealt(rows, size).select("code", "at", "x").mapInArrow(part, "at int, n long, s double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@dataclass
class _Extent:
    """Rows, and the least and greatest latents and sizes of those whose size has a logarithm."""

    n: int
    low: np.ndarray
    high: np.ndarray
    least: float
    most: float


def _read(b: pa.RecordBatch, begin: int, step: int) -> tuple[np.ndarray, ...]:
    """code, row, place, value and perhaps noise of a chunk of code, at, x[, noise]."""
    b = b.slice(begin, step)
    sizes = np.asarray(b.column(1).value_lengths())
    row = np.repeat(np.arange(len(sizes)), sizes)
    more = [np.asarray(b.column(3).flatten()).reshape(len(sizes), -1)] if b.num_columns > 3 else []
    return np.asarray(b.column(0)), row, b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(), *more


def _surface(rows: DataFrame, net: Network, library: float | None = None, sizes: int = 1, drawn: bool = False) -> tuple[_Extent, Surface] | None:
    """The extent of all rows' latents and the nodes over it; None if a product of rows x genes is less than these take, or a latent is not finite."""
    dims = net.mean.weight.shape[1]
    if dims > 3:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, least, most = 0, np.full(dims, np.inf), np.full(dims, -np.inf), np.inf, -np.inf
        for whole in batches:
            for begin in range(0, whole.num_rows, SURFACE_ROWS):
                codes, row, places, values, *draws = _read(whole, begin, SURFACE_ROWS)
                mean, var = net.latent(len(codes), row, places, values, codes)
                z = mean + np.sqrt(var) * draws[0] if draws else mean
                total = np.bincount(row, values, len(codes)) if library is None else np.full(len(codes), library)
                n += len(codes)
                low, high = np.minimum(low, z.min(0)), np.maximum(high, z.max(0))
                some = total[(total > 0) & np.isfinite(total)]
                if len(some):
                    least, most = min(least, some.min()), max(most, some.max())
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([list(low)], kind), pa.array([list(high)], kind), pa.array([least]), pa.array([most])], ["n", "low", "high", "least", "most"])

    found = _spread(rows).select("code", "at", "x", *(["noise"] if drawn else [])).mapInArrow(part, "n long, low array<double>, high array<double>, least double, most double").where("n > 0").collect()  # a row a task
    if sum(f["n"] for f in found) * len(net.genes) <= DENSE_NUMBERS:
        return None
    low, high = np.min([f["low"] for f in found], 0), np.max([f["high"] for f in found], 0)
    extent = _Extent(sum(f["n"] for f in found), low, high, min(f["least"] for f in found), max(f["most"] for f in found))
    if not (np.isfinite(low).all() and np.isfinite(high).all() and np.isfinite(extent.most) and extent.least > 0):
        return None
    surface = Surface(net.scale.weight, net.scale.bias, low, high)
    return (extent, surface) if surface.even and surface.size * sizes <= extent.n else None


def _spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, whatever few bytes they have."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell_id")


def _expected_by_gene(rows: DataFrame, net: Network, extent: _Extent, surface: Surface, library: float | None) -> DataFrame:
    """`expected_by_gene` by the cells' weights of the nodes, summed; the genes meet those."""
    totals = surface.totals()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(surface.size)
        for whole in batches:
            for begin in range(0, whole.num_rows, SURFACE_ROWS):
                codes, row, places, values = _read(whole, begin, SURFACE_ROWS)
                near = surface.at(net.latent(len(codes), row, places, values, codes)[0])
                total = np.bincount(row, values, len(codes)) if library is None else np.full(len(codes), library)
                mass += (total / (near @ totals)) @ near
        yield pa.RecordBatch.from_arrays([pa.array(range(surface.size), pa.int32()), pa.array(mass)], ["node", "mass"])

    sums = _spread(rows).select("code", "at", "x").mapInArrow(part, "node int, mass double").groupBy("node").agg(F.sum("mass").alias("mass")).orderBy("node").toArrow()
    s = surface.by_gene(sums["mass"].to_numpy())
    table = pa.table({"at": pa.array(range(len(s)), pa.int32()), "n": pa.array(np.full(len(s), extent.n)), "s": pa.array(s)})
    return rows.sparkSession.createDataFrame(table)


def _tables(rows: DataFrame, surface: Surface, pieces: list, theta: np.ndarray) -> list[list[np.ndarray]]:
    """By code and piece of sizes: the negative binomial's sums over genes at the nodes, a task each."""
    spark = rows.sparkSession
    spec = [(k, c, p) for k, (c, p) in enumerate((c, p) for c in range(len(theta)) for p in range(len(pieces)))]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums = surface.log_sums(theta[c], pieces[p].nodes, EPS)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([p], pa.int32()), pa.array([sums.ravel()], pa.list_(pa.float64()))], ["c", "p", "v"])

    each = spark.createDataFrame(spec, "k int, c int, p int").repartitionByRange(len(spec), "k").select("c", "p")
    found = {(r["c"], r["p"]): r["v"] for r in each.mapInArrow(part, "c int, p int, v array<double>").collect()}  # codes x pieces rows
    return [[np.array(found[c, p]).reshape(surface.size, -1) for p in range(len(pieces))] for c in range(len(theta))]


def _zeros(surface: Surface, pieces: list, tables: list[list[np.ndarray]], near: np.ndarray, tau: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Each row's sum over genes from the tables."""
    first, length = pieces[0].middle - pieces[0].half, 2 * pieces[0].half
    piece = np.clip(np.floor((tau - first) / length) if length > 0 else np.zeros(len(tau)), 0, len(pieces) - 1).astype(int)
    unit = codes % len(tables) * len(pieces) + piece  # a code of -1 is the last, as in the product
    out = np.empty(len(tau))
    order = np.argsort(unit, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
        c, p = divmod(int(unit[some[0]]), len(pieces))
        out[some] = ((near[some] @ tables[c][p]) * pieces[p].at(tau[some])).sum(1)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y, product = x + 8, np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    s = 1 / (y * y)
    series = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def losses(rows: DataFrame, net: Network, likelihood: str = "nb", samples: int | None = None) -> DataFrame:
    """cell_id, reconstruction (minus the log probability of all the cell's counts, zeros included) and kl (of the latent to the standard normal), at the latent mean or a sample of it."""
    net.checked()
    if likelihood not in ("nb", "poisson"):
        raise NotImplementedError(f"{likelihood} is not known")
    if net.log_var is None or (likelihood == "nb" and net.theta is None):
        raise ValueError("losses need the latent's variance, and the negative binomial its dispersion")
    rows = rows.withColumn("noise", noise(net.mean.weight.shape[1], samples)) if samples is not None else rows

    def own_counts(values: np.ndarray, own: np.ndarray, t: np.ndarray) -> np.ndarray:
        return _log_gamma(values + t) - _log_gamma(t) - _log_gamma(values + 1) + values * (np.log(own) - np.log(own + t))

    def dense(z, total, codes, row, places, values):
        """The log probability of all of each row's counts."""
        mu = net.shares(z, codes)
        mu *= total[:, None]
        mu += EPS
        own = mu[row, places]
        if likelihood == "poisson":
            return -mu.sum(1) + np.bincount(row, values * np.log(own) - _log_gamma(values + 1), len(z))
        theta = np.broadcast_to(net.dispersion(codes) + EPS, mu.shape)
        t = theta[row, places]
        mu /= theta
        np.log1p(mu, out=mu)
        zero = -np.einsum("ij,ij->i", theta, mu)
        return zero + np.bincount(row, own_counts(values, own, t), len(z))

    logs, step = dense, None
    if net.plain and (found := _surface(rows, net, sizes=1 if likelihood == "poisson" else _SIZES * (1 if net.theta.ndim == 1 else len(net.theta)), drawn=samples is not None)):
        extent, surface = found
        totals, pieces = surface.totals(), surface.sizes(extent.least, extent.most)
        theta = None if likelihood == "poisson" else np.atleast_2d(net.theta) + EPS
        tables = None if theta is None else _tables(rows, surface, pieces, theta)
        step = SURFACE_ROWS

        def logs(z, total, codes, row, places, values):
            near = surface.at(z)
            sized = total > 0
            tau = np.log(np.where(sized, total, extent.least)) - np.log(near @ totals)
            own = np.exp(surface.exponent(row, places, z) + tau[row]) + EPS
            if theta is None:
                out = -(total + EPS * len(net.genes)) + np.bincount(row, values * np.log(own) - _log_gamma(values + 1), len(z))
            else:
                t = theta[codes[row] % len(theta), places]
                out = -_zeros(surface, pieces, tables, near, tau, codes) + np.bincount(row, own_counts(values, own, t), len(z))
            for k in np.flatnonzero(~sized):  # no logarithm of the size
                one = row == k
                out[k] = dense(z[k : k + 1], total[k : k + 1], codes[k : k + 1], np.zeros(one.sum(), int), places[one], values[one])[0]
            return out

    def run(ids, codes, row, places, values, draws=None):
        mean, var = net.latent(len(ids), row, places, values, codes)
        z = mean if draws is None else mean + np.sqrt(var) * draws
        log = logs(z, np.bincount(row, values, len(ids)), codes, row, places, values)
        kl = 0.5 * (var + mean * mean - 1 - np.log(var)).sum(1)
        yield [ids, pa.array(-log), pa.array(kl)]

    return _each(rows, f"{_cell(rows)}, reconstruction double, kl double", len(net.genes), run, samples is not None, step)


def layer_sizes(rows: DataFrame, net: Network) -> DataFrame:
    """layer, n, l1: the mean size of each encoder layer's outputs and of the latent means over all cells, as sums of the tasks."""
    net.checked()
    names = [*[f"encoder {k}" for k in range(len(net.encoder))], "latent"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(names)), np.zeros(len(names), int)
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            row, codes, places, values = np.repeat(np.arange(len(sizes)), sizes), np.asarray(b.column(0)), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            h = None
            for k, layer in enumerate([*net.encoder, net.mean]):
                h = layer.after(_times(len(sizes), row, places, np.log1p(values) if net.log_input else values, layer.weight), codes) if h is None else layer(h, codes)
                total[k] += np.abs(h).sum()
                count[k] += h.size
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(count), pa.array(total)], ["layer", "n", "s"])

    parts = rows.select("code", "at", "x").mapInArrow(part, "layer string, n long, s double")
    return parts.groupBy("layer").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("l1"))
