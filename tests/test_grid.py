"""The grid of cells and genes is made in place."""

from rowloom.operators import transforms as tr
from rowloom.sources import virtual


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_grid_does_not_move(spark, folder, monkeypatch):
    monkeypatch.setattr(tr, "GRID_ROWS", 7)
    monkeypatch.setattr(tr, "TASK_GRID_ROWS", 200)
    m, cells, genes = virtual.matrix(spark, folder), virtual.cells(spark, folder), virtual.genes(spark, folder)
    dense = tr.densify(m, cells, genes)
    assert dense.rdd.getNumPartitions() >= cells.count() * genes.count() / 200
    got = {(r["cell_id"], r["gene_id"]): r["x"] for r in dense.collect()}
    want = {(r["cell_id"], r["gene_id"]): r["x"] for r in m.collect()}
    assert len(got) == cells.count() * genes.count() and all(v == want.get(k, 0.0) for k, v in got.items()) and want.keys() <= got.keys()
