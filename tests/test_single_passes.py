"""What is costly is worked out once, and rows travel without their pages."""

from cropledger.plans import source_queries as sq
from cropledger.sources import ingest as ing

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_grid_is_parsed_once(spark):
    page = "<TABLE><tr><th>Price</th><th>x</th></tr><tr><td>1<br>2</td><td><table><tr><th>Date</th></tr><tr><td>a < b</td></tr></table></td></tr></TABLE>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<table><tr><th>price"), (4, "<table " + page)], "k int, html string")
    cells = ing.harvest_html_tables(df, "html", ["k"])
    assert plan(cells).count("<t[hd]") == 1
    assert sorted((r.k, r.table_no, r.cell) for r in cells.collect() if r.k == 1) == [(1, 0, ""), (1, 0, "12"), (1, 1, "a < b")]


def test_table_rows_travel_without_their_page(spark):
    lines = [x for x in plan(sq.route_header_cells(spark, SF)).splitlines() if "Aggregate [" in x]
    assert lines and not [x for x in lines if "html#" in x.split("], [")[0]]
