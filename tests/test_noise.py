from rowloom.plans import catalogue
from rowloom.sources import virtual


def test_noise_reaches_every_cell_and_gene(spark, folder):
    got = catalogue.QUERIES["gaussian_noise_augmented"](spark, folder).select("cell_id", "gene_id", "x")
    n = virtual.cells(spark, folder).count() * virtual.genes(spark, folder).count()
    assert got.count() == got.select("cell_id", "gene_id").distinct().count() == n
    assert got.where("x is null or x = 0").count() == 0
