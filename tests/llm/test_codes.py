"""Product codes against plain integer arithmetic and, on a whole table, against SQL."""

import hashlib
import math
import random

import numpy as np

from rowloom.llm import codes
from tests.oracle import differences

SCHEMA = "vec_id long, embedding array<float>, label int"


def _whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def expected(rows, width=None):
    rows = [r for r in rows if _whole(r[1])]
    lengths = [len(r[1]) for r in rows]
    length = max(set(lengths), key=lambda d: (lengths.count(d), d))
    scaled = lambda v: [max(-codes.LIMIT, min(codes.LIMIT, math.floor(float(np.float32(x)) * 4096))) for x in v] + [0] * (-length % 8)
    rows = sorted(((r[0], scaled(r[1]), r[2]) for r in rows if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-length // 8)
    parts = [[r[1][p * w : (p + 1) * w] for r in rows] for p in range(8)]
    books = [x[:16] for x in parts]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for q in parts[p]:
                held[near(q, book)[1]].append(q)
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for h, e in zip(held, book, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(parts[p][i], books[p]) for p in range(8)] for i in range(len(rows))]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(rows, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by[r[2]], digest) for r, f, e in zip(rows, found, error, strict=True)), key=repr)


def _got(spark, rows):
    out = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5))
    return sorted((tuple(r)[:5] for r in out.collect()), key=repr)


def _rows(seed, n, length=16):
    rng = random.Random(seed)
    out = [(rng.choice([None, rng.randint(0, 40), rng.randint(-99, 999)]), [rng.choice([0.0, -0.25, rng.gauss(0, 1), rng.gauss(3, 0.1)]) for _ in range(length)], rng.choice([None, 1, 2, 2, 2, 2])) for _ in range(n)]
    return out + out[:30]


def test_equals_the_definition(spark):
    rows = _rows(1, 300) + [(1, None, 1), (2, [1.0, None] * 8, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, None), (5, [], 1), (6, [1.0] * 8, 2), (7, [1e30] * 8 + [-1e30] * 8, 1)]
    assert _got(spark, rows) == expected(rows)


def test_fewer_rows_than_entries_and_odd_lengths(spark):
    assert _got(spark, _rows(2, 4, 11)[:5]) == expected(_rows(2, 4, 11)[:5])


def test_equal_vectors_leave_entries_unused(spark):
    rows = [(k, [0.5] * 16, None) for k in range(40)] + [(100 + k, [float(k)] * 16, k % 2) for k in range(9)]
    assert _got(spark, rows) == expected(rows)


def test_no_row_is_whole(spark):
    assert codes.compress(spark.createDataFrame([(1, None, 1), (2, [None], 2), (3, [], 1)], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold_and_leave_few_candidates():
    rng = np.random.default_rng(3)
    entries, q = rng.integers(-9000, 9000, (16, 8)), rng.integers(-9000, 9000, (4000, 8))
    near = codes.Approximation(entries)
    exact = ((q[:, None] - entries[None]) ** 2).sum(2)
    best, dist = near.assign(q)
    assert (best == exact.argmin(1)).all() and (dist == exact.min(1)).all()
    left = near.candidates(q)
    assert left[np.arange(len(q)), exact.argmin(1)].all() and left.mean() < 0.4


def test_clashing_columns(spark):
    rows = [r + ("x", 1, "y") for r in _rows(5, 60)]
    out = codes.compress(spark.createDataFrame(rows, SCHEMA + ", code string, n int, v string"))
    assert sorted((tuple(r)[:5] for r in out.collect()), key=repr) == expected([r[:3] for r in rows])


def test_whole_table_equals_sql(spark, folder):
    assert differences(codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet")), folder, codes.compress_sql()) == []
