"""Vantage-point trees over 64-bit fingerprints and Hamming distance.

The upper levels are one tree on the driver, built from a sample of SAMPLE_PER_LEAF points a leaf (32 MB for
the 131,072 leaves of 2^MAX_DEPTH, which hold five billion points at 40,000 each; beyond that shards grow); its leaves are the shards. A point goes to its own shard and, where its distance to a
vantage point lies within the search radius below the split, also to the shards beyond: by the
triangle inequality any two points within the radius then meet in a shard. Inside a shard the same
rule goes on down to small leaves, which are compared in blocks. Results never depend on the
sample, only the shards' sizes do.
"""

from __future__ import annotations

import numpy as np

MAX_DEPTH = 17
#: Sampled points for each leaf of the upper tree.
SAMPLE_PER_LEAF = 32
LEAF = 1024


def distance(points: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def build(sample: np.ndarray, depth: int) -> list[tuple[int, int] | None]:
    """A heap of (vantage point, radius): node k has the inner child 2k+1 and the outer child 2k+2; None ends a branch."""
    tree: list[tuple[int, int] | None] = [None] * ((1 << depth) - 1)
    parts = {0: np.unique(sample)}
    for k in range(len(tree)):
        pts = parts.pop(k, None)
        split = None if pts is None else _split(pts)
        if split is None:
            continue
        tree[k] = split
        inner = distance(pts, np.uint64(split[0])) <= split[1]
        parts[2 * k + 1], parts[2 * k + 2] = pts[inner], pts[~inner]
    return tree


def _split(pts: np.ndarray) -> tuple[int, int] | None:
    """Of a few vantage points, the one whose distances spread most."""
    best = None
    for v in pts[:: max(1, len(pts) // 5)][:5]:
        d = distance(pts, v)
        mu = int(np.median(d))
        mu -= int(mu == d.max())
        if mu >= d.min() and (best is None or d.std() > best[0]):
            best = (d.std(), int(v), mu)
    return None if best is None else best[1:]


def packed(tree: list[tuple[int, int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a node splits, vantage points, radii) of a heap, for `route`."""
    return np.array([t is not None for t in tree], bool), np.array([t[0] if t else 0 for t in tree], np.uint64), np.array([t[1] if t else 0 for t in tree], np.int64)


def route(tree: tuple[np.ndarray, np.ndarray, np.ndarray], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of the point) for the shards that each point belongs to or reaches into from within."""
    splits, vantage, radii = tree
    at, idx = np.zeros(len(points), np.int64), np.arange(len(points))
    shards, ids = [], []
    while len(idx):
        live = np.zeros(len(at), bool)
        known = at < len(splits)
        live[known] = splits[at[known]]
        shards.append(at[~live])
        ids.append(idx[~live])
        at, idx = at[live], idx[live]
        if not len(idx):
            break
        mu = radii[at]
        d = distance(points[idx], vantage[at]).astype(np.int64)
        inner, across = d <= mu, (d <= mu) & (d > mu - radius)
        at = np.concatenate([np.where(inner, 2 * at + 1, 2 * at + 2), 2 * at[across] + 2])
        idx = np.concatenate([idx, idx[across]])
    return (np.concatenate(shards), np.concatenate(ids)) if shards else (at, idx)


def near_blocks(points: np.ndarray, radius: int, leaf: int = LEAF):
    """Yield (i, j) arrays of all pairs of indices within the radius, block by block; a pair may come twice."""
    todo = [(np.arange(len(points)), None)]
    while todo:
        a, b = todo.pop()
        if len(a) == 0 or (b is not None and len(b) == 0):
            continue
        if (len(a) if b is None else max(len(a), len(b))) <= leaf:
            yield from _brute(points, a, b, radius)
            continue
        every = a if b is None else np.concatenate([a, b])
        split = _split(points[every[:: max(1, len(every) // 2048)]])
        if split is None:
            yield from _brute(points, a, b, radius)
            continue
        v, mu = np.uint64(split[0]), split[1]
        da = distance(points[a], v)
        ia, oa = a[da <= mu], a[da > mu]
        edge_ia, edge_oa = a[(da <= mu) & (da.astype(int) > mu - radius)], a[(da > mu) & (da <= mu + radius)]
        if b is None:
            parts = [(ia, None), (oa, None), (edge_ia, edge_oa)]
            stuck = max(len(ia), len(oa)) > 0.98 * len(a)
        else:
            db = distance(points[b], v)
            ib, ob = b[db <= mu], b[db > mu]
            parts = [(ia, ib), (oa, ob), (edge_ia, b[(db > mu) & (db <= mu + radius)]), (edge_oa, b[(db <= mu) & (db.astype(int) > mu - radius)])]
            stuck = sum(len(x) * len(y) for x, y in parts) > 0.95 * len(a) * len(b)
        if stuck:  # all points stand close together: no split parts them
            yield from _brute(points, a, b, radius)
        else:
            todo += parts


def _brute(points: np.ndarray, a: np.ndarray, b: np.ndarray | None, radius: int, step: int = 512):
    other = a if b is None else b
    for s in range(0, len(a), step):
        x = a[s : s + step]
        for t in range(s if b is None else 0, len(other), 4096):
            y = other[t : t + 4096]
            i, j = np.nonzero(np.bitwise_count(points[x][:, None] ^ points[y][None, :]) <= radius)
            i, j = x[i], y[j]
            real = i != j
            if real.any():
                yield i[real], j[real]


def forest(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the least index of the points it can reach by links within the radius."""
    return roots(len(points), near_blocks(points, radius))


def roots(n: int, links) -> np.ndarray:
    """For each of n points the least index that it can reach by links, which come as blocks (i, j)."""
    root = np.arange(n)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in links:
        while True:  # follow links of all at once
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        differ = root[i] != root[j]
        if not differ.any():
            continue
        pairs = np.unique(np.stack([root[i[differ]], root[j[differ]]], axis=1), axis=0)
        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    for k in range(len(root)):
        find(k)
    while (root[root] != root).any():
        root = root[root]
    return root
