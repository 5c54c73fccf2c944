"""Noise over the grid of cells and genes."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from rowloom.functions import hashes
from rowloom.operators import transforms as tr
from rowloom.plans import catalogue
from rowloom.sources import virtual
from tests.oracle import differences


def test_draws_are_md5(monkeypatch):
    monkeypatch.setattr(hashes, "BLOCK", 7)
    columns = [b"", b"|1", b"|22", b"|999999", b"|-5", b"|Supplier#000000009", b"|" + b"x" * 40]
    rows = [b"8|1", b"9|2", b"10|12345", b"10|67890", b"10", b"9|" + b"y" * 70, b"9|abcdefghijkl", b"7|" + b"z" * 11, b"7|" + b"z" * 12]
    got = hashes.GridDraws(columns)(rows)
    want = [[int(hashlib.md5(r + c).hexdigest()[:8], 16) / 2**32 for c in columns] for r in rows]
    assert (got == np.array(want)).all()


def test_the_grid_is_hashed_in_arrays(spark, folder):
    got = catalogue.QUERIES["gaussian_noise_augmented"](spark, folder)
    assert "md5" not in got._jdf.queryExecution().executedPlan().toString()  # the JVM's takes some microseconds a row
    assert differences(got, folder, catalogue.ORACLE_SQL["gaussian_noise_augmented"]) == []


def test_noisy_grid_equals_noise_of_the_dense_rows(spark):
    m = spark.createDataFrame([("a", "g1", 2.0), ("a", None, 3.0), ("é", "g2", -4.5), (None, "g1", 1.0)], "cell_id string, gene_id string, x double")
    cells = spark.createDataFrame([("a",), ("é",), ("none",), (None,), ("w" * 60,)], "cell_id string")
    genes = spark.createDataFrame([("g1",), ("g2",), (None,), ("v" * 30,)], "gene_id string")
    for p in (1.0, 0.5):
        key = lambda r: (str(r["cell_id"]), str(r["gene_id"]))
        want = sorted(tr.gaussian_noise(tr.densify(m, cells, genes), 0.1, 0.4, p, 3).collect(), key=key)
        got = sorted(tr.noisy_grid(m, cells, genes, 0.1, 0.4, p, 3).collect(), key=key)
        assert [key(r) for r in got] == [key(r) for r in want] and np.allclose([r["x"] for r in got], [r["x"] for r in want], rtol=0, atol=1e-12)


def test_rounding_is_half_away_from_zero():
    assert tr._rounded(np.array([0.5, 1.5, -2.5, 0.49999999999999994, -7.0, 2.0**60]), 0).tolist() == [1, 2, -3, 0, -7, 2.0**60]
