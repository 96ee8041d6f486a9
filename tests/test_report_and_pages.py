"""The scored report, page extraction and category decisions on hand-written rows."""

from pyspark.sql import functions as F

from listguard.market import Market
from listguard.operators import audit, matching as M, pages as P, report
from tests.test_checks import book, rows


def test_score_floor_and_message_dedup(spark):
    df = rows(spark, {}, {}).withColumn("_issues", F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit("critical").alias("severity"), F.lit("f").alias("flag"),
                 F.lit(f"m{i}").alias("message")) for i in range(5)]))
    got = report.quality_report(df, "KE").select("Quality Score", "Total Issues", "Top Issues").head()
    assert (got[0], got[1]) == (0, 5) and got[2].startswith("[critical] m0 | [critical] m1")
    assert len(report.quality_report(df, "KE").columns) == 41


def test_issues_of_one_row(spark):
    df = rows(spark, {"NAME": "acme", "BRAND": "Acme"}).withColumns({
        "DESCRIPTION": F.lit("short"), "OLD_PRICE": F.lit("1001"), "No. of Images": F.lit("4")})
    issues = [(r.severity, r.flag, r.message) for r in report.issue_rows(
        report.find_issues(df, book(spark))).orderBy("issue_order").collect()]
    assert issues == [
        ("medium", "Naming Issue", "Product name is a single word"),
        ("medium", "Naming Issue", "Brand name repeated in product name"),
        ("high", "Suspicious Price", "Old price 1,001 is 10× current 100"),
        ("medium", "Few Images (<5)", "Product has only 4 image(s), minimum recommended is 5"),
        ("medium", "Thin Description", "Product description is too short"),
        ("medium", "Missing Images in Desc", "Product description does not contain any images")]


HTML = """<html><head><title>T</title></head><body><nav class="breadcrumb"><span>Home</span><span>Audio</span></nav>
<h1>Midnight  Blue speaker</h1><div class="-prc-w"><span>KSh 99</span></div><span class="prc">KSh 1,234</span>
<form id="product_addtocart_form"><select><option value="">Pick</option><option value="1">XL</option><option value="2">Teal</option></select></form>
<a href="/c?page=3">3</a><b data-page="7"></b><ol class="breadcrumb"><a>Home</a><a>Audio</a><a>Speakers</a></ol>
<a href="/good-shop-cod/">Good Shop</a><div class="seller-info"><a href="/x">View store</a></div>
<p>12-month guarantee</p><table><tr><td>x</td></tr></table><a href="?tag=MALLX">m</a></body></html>"""


def test_product_page(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>broken <b>x")], "page_id int, html string")
    market = Market(official_tag="MALLX")
    got = {r.page_id: r for r in P.product_fields(pages, ["page_id"], "", market).collect()}
    r = got[1]
    assert (r.PRICE, r.SIZES_AVAILABLE, r.COLOR, r.COUNT_VARIATIONS) == ("1234", "XL", "Teal", "1")
    assert (r.COLOR_IN_TITLE, r.CATEGORY_PATH, r.SELLER_NAME) == ("Midnight  Blue", "Audio > Speakers", "Good Shop")
    assert (r.IS_OFFICIAL_STORE, r.PRODUCT_WARRANTY, r.WARRANTY_DURATION) == ("Yes", "Yes", "12-month guarantee")
    assert got[2].COLOR_IN_TITLE == "None" and got[3].STOCK_STATUS == "In Stock"
    nodes = P.page_nodes(pages, ["page_id"]).where("page_id = 1")
    one = nodes.select(P.page_count(F.col("nodes")).alias("n"), P.breadcrumb(F.col("nodes")).alias("b")).head()
    assert (one.n, one.b) == (7, "Audio")


def test_enrichment_fills_empty_cells_only(spark):
    df = spark.createDataFrame([("A-1", "", "x"), ("B", "keep", None)], "PRODUCT_SET_SID string, COLOR string, RATING string")
    pages = spark.createDataFrame([("A", "red", "5"), ("B", "blue", "4")], "sku string, COLOR string, RATING string")
    assert "COLOR" not in audit.fields_to_fill(df, ["COLOR", "RATING"]) and "GTIN" in audit.fields_to_fill(df)
    for hot in (0, 1_000_000):
        out = audit.enrich(df, pages, ["COLOR", "RATING"], hot).collect()
        assert {r.PRODUCT_SET_SID: (r.COLOR, r.RATING) for r in out} == {"A-1": ("red", "x"), "B": ("keep", "4")}


def test_category_decisions(spark):
    paths = spark.createDataFrame([("electronics / audio / speakers", "7", 1), ("fashion / men / shirts", "8", 2)],
                                  "path string, code string, _pos int")
    cases = [("Speakers", "7", "Electronics > Audio > Speakers", None),             # leaf inside the suggestion
             ("Shirts", "8", "Grocery > Food > Rice", None),                        # blocked across domains
             ("Shirts", "8", "Toys > Games > Puzzles", "Wrong Category. Suggested: Toys > Games > Puzzles"),
             ("Audio / Old", "", "Audio / Old / New", None), ("nan", "", "Toys > A > B", None),
             ("Miscellaneous", "9", None, "Category is 'Miscellaneous'"), ("", "8", "Fashion / Men / Ties", None)]
    df = spark.createDataFrame([(str(i), *c[:3]) for i, c in enumerate(cases)],
                               "PRODUCT_SET_SID string, CATEGORY string, CATEGORY_CODE string, suggested string")
    got = {int(r.PRODUCT_SET_SID): r._category_detail for r in M.decide(df, paths).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_learning_round_trip(spark, tmp_path):
    path = str(tmp_path / "corrections")
    M.learn(spark, spark.createDataFrame([("Red  Ring!", "A"), ("", "B")], "name string, category string"), path)
    M.learn(spark, spark.createDataFrame([("red ring", "C")], "name string, category string"), path)
    names = spark.createDataFrame([("RED ring", 1)], "name string, n int")
    assert [r.suggested for r in M.learned(names, spark.read.parquet(path)).collect()] == ["C"]


def test_resolve_category_by_containment(spark):
    cmap = spark.createDataFrame([("Phones", "11", "Electronics / Phones", 1), ("Rice", "12", "Grocery / Rice", 2)],
                                 "name string, code string, path string, _pos int")
    df = spark.createDataFrame([("electronics > phones", ""), ("x / RICE", ""), ("Smart-Phones & more", "77"), ("zz", " 5 "), (None, "6")],
                               "CATEGORY string, CATEGORY_CODE string")
    got = {r.CATEGORY: r.CATEGORY_CODE for r in audit.resolve_category(df, cmap).collect()}
    assert got == {"electronics > phones": "11", "x / RICE": "12", "Smart-Phones & more": "11", "zz": "5", None: "6"}
