"""Nested rows, metadata tokens, lint, settings: errors and nulls."""

import pytest
from pyspark.sql import functions as F

from rowloom.operators import prompts
from rowloom.sources import fields, sinks


def test_nests_need_the_same_rows(spark):
    leaf = lambda ks: spark.createDataFrame([(k, k * 10) for k in ks], "row long, value long")
    out = fields.nest({"a": {"b": leaf([1, 2]), "c": {"d": leaf([2, 1])}}, "e": leaf([1, 2])})
    assert out.schema["a"].dataType.simpleString() == "struct<b:bigint,c:struct<d:bigint>>"
    assert {r["row"]: (r["a"]["b"], r["a"]["c"]["d"], r["e"]) for r in out.collect()} == {1: (10, 10, 10), 2: (20, 20, 20)}
    for bad in ([1], [1, 1], [1, 3]):
        with pytest.raises(ValueError, match="keys|numbers"):
            fields.nest({"a": leaf([1, 2]), "b": leaf(bad)})


def test_metadata_that_is_not_known_is_neither_prompt_nor_query(spark):
    cells = spark.createDataFrame([(1, "x", "p"), (2, None, "zz"), (3, "y", None)], "cell_id long, a string, b string")
    vocab = {"a": ["x", "y"], "b": ["p", "q", "r"]}
    got = {(r["cell_id"], r["field"]): (r["is_prompt"], r["is_query"], r["token"], r["label"]) for r in prompts.metadata_tokens(cells, vocab, ["a"]).collect()}
    assert got == {(1, "a"): (1, 0, 0, 0), (1, "b"): (0, 1, 3, 0), (2, "a"): (0, 0, 0, 0), (2, "b"): (0, 0, 0, 0), (3, "a"): (1, 0, 1, 1), (3, "b"): (0, 0, 0, 0)}
    got = {(r["cell_id"], r["field"]): (r["is_prompt"], r["is_query"], r["token"]) for r in prompts.metadata_tokens(cells, vocab, predict=True).collect()}
    assert got[2, "a"] == (0, 1, 2) and got[1, "b"] == (1, 0, 0) and got[3, "b"] == (0, 1, 3)
    coarse = spark.createDataFrame([(1, "b", "r"), (3, "a", "no such")], "cell_id long, field string, name string")
    got = {(r["cell_id"], r["field"]): (r["token"], r["label"]) for r in prompts.metadata_tokens(cells, vocab, ["a", "b"], coarse).collect()}
    assert got[1, "b"] == (2, 0) and got[3, "a"] == (1, 1)


def test_attention_of_cells_without_prompts(spark):
    t = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1), (2, 0, 0), (2, 1, 0)], "cell_id long, at int, is_prompt int")
    assert {(r["cell_id"], r["at"]): r["keys"] for r in prompts.attends(t).collect()} == {(1, 0): [0, 2], (1, 1): [0, 1, 2], (1, 2): [0, 2], (2, 0): [0], (2, 1): [1]}


def test_lint_and_settings(spark):
    df = spark.createDataFrame([(["gaussian_noise", "densify", "densify", "filter_genes"],), ([],), (None,)], "t array<string>")
    got = [r[0] for r in df.select(fields.lint(F.col("t"))).collect()]
    assert got == [["error: gaussian_noise at 0 needs densify before it", "warning: densify at 2 does nothing, the matrix is dense", "warning: filter_genes at 3 is cheaper before densify"], [], None]
    a, b = (spark.createDataFrame(r, "setting string, value int") for r in ([("seed", 1), ("same", 2), ("gone", 3)], [("seed", 4), ("same", 2), ("new", None)]))
    assert sorted((r["setting"], r["before"], r["now"]) for r in sinks.resume_problems(a, b).collect()) == [("gone", "3", None), ("seed", "1", "4")]
