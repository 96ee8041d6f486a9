"""Large numbers, long values and long lists pass whole."""

from pyspark.sql import functions as F

from listguard.functions.prices import discount_text, price_text
from listguard.market import Market
from listguard.operators import analytics, audit, checks as C, keywords as K, matching as M, pages as P
from tests.test_checks import book, found, rows


def test_large_prices_and_counts(spark):
    df = spark.createDataFrame([("KSh 12,500,000",), ("12500000.55",), ("0.0004",), ("0",), ("x",), (None,)], "p string")
    got = [r[0] for r in df.select(price_text(F.col("p"))).collect()]
    assert got == ["12500000.0", "12500000.55", "0.0004", "", "", ""]
    far = spark.range(1).select(discount_text(F.lit(""), F.lit("1"), F.lit("-1e30")).alias("d")).head().d
    assert far is None or far == ""
    df = rows(spark, {"COUNT_VARIATIONS": "1e12"}, {"COUNT_VARIATIONS": "1e40"}, {"COUNT_VARIATIONS": "3"})
    hits = found(df, book(spark, category_role=[("7", "variation")]), "Wrong Variation")
    assert set(hits) == {"s0", "s2"} and "1000000000000" in hits["s0"]


def test_two_pages_of_a_sku_fill_one_listing(spark):
    df = spark.createDataFrame([("A-1", "")], "PRODUCT_SET_SID string, COLOR string")
    pages = spark.createDataFrame([("A", "red", 1), ("A", "blue", 2)], "sku string, COLOR string, captured_at int")
    assert [r.COLOR for r in audit.enrich(df, pages, ["COLOR"]).collect()] == ["blue"]
    inputs = spark.createDataFrame([("A", "A", None, None)], "sku string, input string, url string, country_hint string")
    assert [r.COLOR for r in audit.lookup_results(inputs, pages, "KE").collect()] == ["blue"]


def test_last_correction_of_a_batch_wins(spark, tmp_path):
    path = str(tmp_path / "c")
    batch = spark.createDataFrame([("red ring", "A"), ("red ring", "B")], "name string, category string").coalesce(1)
    M.learn(spark, batch, path)
    names = spark.createDataFrame([("red ring", 1)], "name string, n int")
    assert [r.suggested for r in M.learned(names, spark.read.parquet(path)).collect()] == ["B"]


def test_more_than_a_hundred_statuses(spark):
    df = spark.range(101).select(F.lit("Monday").alias("Day"), F.concat(F.lit("s"), F.col("id")).alias("status"))
    week = analytics.daily_summary(df).where("Day = 'Weekly Total'").head()
    assert week["Daily Total"] == 101 and week["s100"] == 1


def test_long_lists_on_a_page(spark):
    options = "".join(f"<option value='{i}'>Tone{i}</option>" for i in range(31))
    crumbs = "<a>Home</a>" + "".join(f"<a>C{i}</a>" for i in range(1001))
    links = "".join(f"<a href='/cart-{i}/'>x{i}</a>" for i in range(70))
    html = (f"<html><body><form id='product_addtocart_form'><select>{options}</select></form><ol class='breadcrumb'>{crumbs}"
            f"</ol><span class='prc'>9</span>{links}<a href='/good-shop/'>Good Shop</a></body></html>")
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    r = P.product_fields(pages, ["page_id"], "", Market(official_tag="T")).head()
    assert r.COUNT_VARIATIONS == "31" and r.CATEGORY_PATH.endswith("C1000") and r.CATEGORY_PATH.startswith("C0 > ")
    assert r.SELLER_NAME == "Good Shop"


def test_contained_titles_of_any_length(spark):
    names = spark.createDataFrame([(1, "a red ring, small"), (2, "xy"), (3, None), (4, "")], "id int, text string")
    rules = spark.createDataFrame([("red ring",), ("y",), ("ed",), ("",), ("red rings",), (None,)], "title string")
    got = {(r.id, r.title) for r in K.containing(names, rules, "title").collect()}
    assert got == {(1, "red ring"), (1, "ed"), (2, "y")}
    assert K.containing(names, rules.limit(0), "title").count() == 0


def test_long_titles_stay_whole_in_details(spark):
    title = "very long title of a book " * 5
    df = rows(spark, {"NAME": "the " + title})
    books = spark.createDataFrame([(1, title.strip(), None)], "rule_order int, title string, seller string")
    assert [r.detail for r in C.book_hits(df, books).collect()] == [f"No seller authorised for book: '{title.strip()}'"]
