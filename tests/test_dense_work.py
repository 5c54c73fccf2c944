"""Dense products of sparse rows are dealt by their work."""

from rowloom.operators import networks
from rowloom.plans import catalogue, wider  # noqa: F401 (wider registers its queries)
from rowloom.sources import virtual
from tests.oracle import differences


def test_dense_products_are_dealt_by_their_work(spark, folder, monkeypatch):
    for name in ("vae_losses", "vae_reconstruct"):
        monkeypatch.setattr(networks, "TASK_NUMBERS", 1000)
        parts: list = []
        real = networks._dealt
        monkeypatch.setattr(networks, "_dealt", lambda rows, width: parts.append(real(rows, width)) or parts[-1])  # noqa: B023
        got = catalogue.QUERIES[name](spark, folder)
        monkeypatch.setattr(networks, "_dealt", real)
        cells, genes = virtual.cells(spark, folder).count(), virtual.genes(spark, folder).count()
        assert parts and parts[-1].rdd.getNumPartitions() >= cells * genes // 2 / 1000
        assert differences(got, folder, catalogue.ORACLE_SQL[name]) == []
