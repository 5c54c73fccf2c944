"""Distances from some terms only."""

from pyspark.sql import functions as F

from rowloom.operators import ontology


def test_only_wanted_terms_walk(spark, monkeypatch):
    monkeypatch.setattr(ontology, "WALK_ROWS", 2)
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("x", "y")], "parent string, child string")
    every = {tuple(r) for r in ontology.distances(edges, "u").collect()}
    some = {tuple(r) for r in ontology.distances(edges, "u", F.expr("a in ('d', 'u', 'none')")).collect()}
    assert some == {r for r in every if r[0] in "du"} == {("d", "d", 0), ("d", "c", 1), ("d", "a", 2), ("d", "b", 3), ("u", "u", 0)}
    assert ontology.distances(edges, None, F.lit(False)).collect() == []
