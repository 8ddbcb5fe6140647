"""Registered queries without SQL run over the whole panel."""

from panelfx.operators.index import treated_cells
from panelfx.queries import QUERIES, panel


def test_queries_cover_the_panel(spark):
    data = "/root/testdata/sf0.01"
    n = panel(spark, data).where("d = 0 AND y IS NOT NULL").count()
    assert [r["n_attempted"] for r in QUERIES["cv_lowrank"](spark, data).collect()] == [n, n]
    assert QUERIES["boot_joint"](spark, data).count() == 200
    assert QUERIES["unconverged"](spark, data).count() == treated_cells(panel(spark, data, "staggered")).count()


def test_panels_read_their_tables_once(spark, data):
    """What a query asks of its cells later doesn't go back to orders and customers."""
    assert panel(spark, data).inputFiles() == [] and panel(spark, data, "staggered", "month").inputFiles() == []
