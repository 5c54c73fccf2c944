"""Sums over all genes of a softmax decoder as smooth functions of a latent of few numbers.

A gene's share depends on the cell by its latent z alone: exp(z W_g + b_g) over the sum S(z) of all genes'. Over the box
that holds all cells' z such sums are known from their values at a grid of Chebyshev nodes: to double precision, as the
number of nodes follows from how far into the complex plane the functions are analytic (`nodes_for`). So genes
meet nodes, and cells meet nodes, but cells do not meet genes. All genes and all cells count.
"""

from __future__ import annotations

import math

import numpy as np

#: Genes whose factors are held at once.
CHUNK = 4096
#: Relative error at which a Chebyshev series ends.
ERROR = 1e-15
#: Largest ratio of mean to dispersion whose logarithm is summed as a power series.
SERIES = 0.5
#: Exponents that move further over the box than this either way have sums of too many magnitudes for one grid.
MOST_REACH = 3.0
#: Length of a piece of the logarithm of a cell's size.
PIECE = 1.0


def nodes_for(reach: float) -> int:
    """Nodes for functions of an exponent that moves by `reach` either way: exp, and log(1 + exp) up to three quarters of the way to its singularity at i pi."""
    if reach <= 0:
        return 1
    y = 0.75 * math.pi / reach
    return 1 + math.ceil(-math.log(ERROR) / math.log(y + math.sqrt(1 + y * y)))


def _times_all(factors: list[np.ndarray]) -> np.ndarray:
    """Row-wise products of all columns of all factors."""
    out = factors[0]
    for f in factors[1:]:
        out = (out[:, :, None] * f[:, None, :]).reshape(len(out), -1)
    return out


class Axis:
    """Chebyshev nodes of an interval."""

    def __init__(self, low: float, high: float, size: int):
        self.middle, self.half, self.size = (low + high) / 2, (high - low) / 2, size
        angle = math.pi * (np.arange(size) + 0.5) / size
        self.nodes = self.middle + self.half * np.cos(angle)
        self._to_nodes = np.cos(np.outer(np.arange(size), angle)) * 2 / size
        self._to_nodes[0] /= 2

    def at(self, z: np.ndarray) -> np.ndarray:
        """Each z's weights of the nodes' values."""
        x = (z - self.middle) / self.half if self.half > 0 else z - self.middle
        t = np.ones((self.size, len(z)))
        if self.size > 1:
            t[1] = x
        for k in range(2, self.size):
            t[k] = 2 * x * t[k - 1] - t[k - 2]
        return t.T @ self._to_nodes


class Surface:
    """The nodes of a box of latents, for a softmax of weight (latent x genes) and bias; there are none unless it is `even`."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray | None, low: np.ndarray, high: np.ndarray):
        # what all genes share cancels in a softmax, so exponents are taken about their middle
        self.weight = weight - (weight.min(1, keepdims=True) + weight.max(1, keepdims=True)) / 2
        self.bias = np.zeros(weight.shape[1]) if bias is None else bias - bias.max()
        reach = (high - low) / 2 * np.abs(self.weight).max(1)
        self.reach = reach
        self.axes = [Axis(a, b, nodes_for(r)) for a, b, r in zip(low, high, reach, strict=True)] if self.even else []  # a grid of no use may be huge
        self.size = math.prod(x.size for x in self.axes)

    @property
    def even(self) -> bool:
        """Whether the sums' relative error is that of doubles but for e^(2 MOST_REACH) at most."""
        return float(self.reach.sum()) <= MOST_REACH

    def at(self, z: np.ndarray) -> np.ndarray:
        return _times_all([x.at(z[:, j]) for j, x in enumerate(self.axes)])

    def exponent(self, row: np.ndarray, places: np.ndarray, z: np.ndarray) -> np.ndarray:
        """z W + bias at single places."""
        return self.bias[places] + sum(z[row, j] * w[places] for j, w in enumerate(self.weight))

    def _factors(self, begin: int) -> tuple[np.ndarray, np.ndarray, slice]:
        some = slice(begin, begin + CHUNK)
        f = [np.exp(np.outer(w[some], x.nodes)) for w, x in zip(self.weight, self.axes, strict=True)]
        return _times_all([np.ones((len(f[0]), 1)), *f[:-1]]), f[-1], some

    def totals(self) -> np.ndarray:
        """S at the nodes."""
        out = 0.0
        for begin in range(0, len(self.bias), CHUNK):
            left, right, some = self._factors(begin)
            out = out + left.T @ (np.exp(self.bias[some])[:, None] * right)
        return out.ravel()

    def by_gene(self, mass: np.ndarray) -> np.ndarray:
        """Sums of exp(z W + bias) over nodes that weigh `mass`."""
        out = np.empty(len(self.bias))
        for begin in range(0, len(out), CHUNK):
            left, right, some = self._factors(begin)
            out[some] = np.exp(self.bias[some]) * ((left @ mass.reshape(left.shape[1], -1)) * right).sum(1)
        return out

    def sizes(self, least: float, most: float) -> list[Axis]:
        """Pieces of log(cell's size) - log S for sizes from least to most."""
        s = np.log(self.totals())
        gap = sum(r * math.pi / (2 * x.size) for r, x in zip(self.reach, self.axes, strict=True))  # from any z to a node
        low, high = math.log(least) - (s.max() + gap), math.log(most) - (s.min() - gap)
        count = max(1, math.ceil((high - low) / PIECE))
        ends = np.linspace(low, high, count + 1)
        return [Axis(a, b, nodes_for((b - a) / 2)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def log_sums(self, theta: np.ndarray, tau: np.ndarray, eps: float) -> np.ndarray:
        """Sums over genes of theta log(1 + (exp(z W + bias + tau) + eps) / theta), nodes x taus."""
        e = sum(np.abs(w) * x.half + w * x.middle for w, x in zip(self.weight, self.axes, strict=True)) + self.bias
        most = math.exp(min(700.0, float((e - np.log(theta)).max() + tau.max())))
        return self._series(theta, tau, eps, most) if most <= SERIES else self._direct(theta, tau, eps)

    def _series(self, theta: np.ndarray, tau: np.ndarray, eps: float, most: float) -> np.ndarray:
        """The logarithm's powers, each a product of matrices; eps counts to the first order, as its square is nothing."""
        terms = 1 if most <= 0 else max(2, math.ceil(math.log(1e-17) / math.log(most)))
        mid = tau.mean()
        sums = [0.0] * terms
        for begin in range(0, len(self.bias), CHUNK):
            left, right, some = self._factors(begin)
            t = theta[some]
            own = np.exp(self.bias[some] + mid) / t
            a, b = np.ones_like(left), np.ones_like(right)
            power = np.ones_like(own)
            for k in range(1, terms + 1):
                a *= left
                b *= right
                power = power * own
                weight = (t / k - eps) * power * (1 if k % 2 else -1)
                sums[k - 1] = sums[k - 1] + a.T @ (weight[:, None] * b)
        rise = np.exp(np.outer(np.arange(1, terms + 1), tau - mid))
        return eps * len(self.bias) + np.stack([s.ravel() for s in sums], 1) @ rise

    def _direct(self, theta: np.ndarray, tau: np.ndarray, eps: float) -> np.ndarray:
        out = np.zeros((self.size, len(tau)))
        step = max(1, (1 << 17) // self.size)
        for begin in range(0, len(self.bias), CHUNK):
            left, right, some = self._factors(begin)
            every = _times_all([left, right]) * np.exp(self.bias[some])[:, None]
            t = theta[some]
            for i in range(0, len(t), step):
                part, own = every[i : i + step], t[i : i + step]
                for k, v in enumerate(tau):
                    x = part * math.exp(v)
                    x += eps
                    x /= own[:, None]
                    np.log1p(x, out=x)
                    out[:, k] += own @ x
        return out
