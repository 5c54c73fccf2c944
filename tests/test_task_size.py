"""Tasks that group, sort and window values grow in number, not in size."""

import pytest

from rowloom.operators import evaluate
from rowloom.plans import catalogue, wider  # noqa: F401 (wider registers its queries)
from rowloom.sources import virtual
from tests.oracle import differences


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pflogpf", "generate_prompt_tokens", "gpt_predict_tokens", "attention_mask"])
def test_values_meet_in_tasks_of_bounded_size(spark, folder, monkeypatch, name):
    monkeypatch.setattr(virtual, "TASK_ROWS", 250)
    got = catalogue.QUERIES[name](spark, folder)
    lines = virtual.table(spark, folder, "lineitem").count()
    assert got.rdd.getNumPartitions() >= lines / 250
    assert differences(got, folder, catalogue.ORACLE_SQL[name]) == []


def test_weights_go_to_the_values(spark, folder, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = plan(catalogue.QUERIES["softmax_probs"](spark, folder))
        monkeypatch.setattr(evaluate, "MOST_WEIGHTS", 0)
        many = catalogue.QUERIES["softmax_probs"](spark, folder)
        assert "hashpartitioning(gene_id" not in few and "hashpartitioning(gene_id" in plan(many)
        assert differences(many, folder, catalogue.ORACLE_SQL["softmax_probs"]) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
