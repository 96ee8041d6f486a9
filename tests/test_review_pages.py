"""Pages of ordered rows."""

from listguard.operators import review


def test_pages_part_the_rows_in_order(spark):
    rows = spark.createDataFrame([((i * 7919) % 1003, f"n{i % 5}") for i in range(1003)], "k int, `odd name` string")
    pages = review.Pages(rows, ["k"])
    got = [[r.k for r in pages.page(p, 40).collect()] for p in range(27)]
    assert [k for page in got for k in page] == list(range(1003))
    assert [len(p) for p in got] == [40] * 25 + [3, 0] and pages.page(0).columns == ["k", "odd name"]
    plan = pages.page(20, 40)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "_place" in plan and "Offset" not in plan
    assert review.Pages(rows.where("false"), ["k"]).page(0).collect() == []
