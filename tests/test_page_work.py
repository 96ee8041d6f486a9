"""Page extraction: ancestors by bits, and work in proportion to the page."""

import time

from pyspark.sql import functions as F

from listguard.operators import pages as P


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")


def test_ancestors_follow_the_open_elements(spark):
    html = ("<body><header><nav class='breadcrumb x'><span>a</span></nav></header><ul><li class='my-color'><b>c<i>d</i></b></ul><p>e"
            "<div class='size-box'><img class='stars'><span>f</span></p></div><span>g</span><section class='seller'>h</span>i")
    rows = P.page_nodes(frame(spark, html), ["page_id"]).select(F.explode("nodes").alias("n")).where("n.tag = '#text'").select("n.*").collect()
    names = {r.text: {k for k, bit in P._BIT.items() if r.up & bit} for r in rows}
    assert names == {
        "a": {"body", "page head", "crumb bar"}, "c": {"body", "list", "swatch"}, "d": {"body", "list", "swatch"}, "e": {"body"},
        "f": {"body", "variant box"},  # an element without content is no ancestor
        "g": {"body"}, "h": {"body", "seller section"}, "i": {"body", "seller section"}}


def test_texts_below_a_node_inside_a_card(spark):
    html = "<p>x<article class='prd'><h3 class='name'>A <b>B</b></h3><div class='brand'>C</div></article><article class='prd'><h3 class='name'>D"
    got = [(r.Name, r.Brand) for r in P.listing_cards(frame(spark, html, None, "")).orderBy("SKU").collect()]
    assert got == [("AB", "C"), ("D", "")]


def test_work_grows_with_the_page(spark):
    def cards(n):
        return "<body>" + "".join(f"<article class='prd'><a class='core' href='/p{i}.html'><h3 class='name'>N{i}</h3>"
                                  f"<div class='prc'>KSh {i}</div></a></article>" for i in range(n))

    def seconds(n):
        start = time.time()
        assert P.listing_cards(frame(spark, *[cards(n)] * 4)).where("Name <> ''").count() == 4 * n
        return time.time() - start

    seconds(10)
    small, large = seconds(600), seconds(6000)
    assert large < 12 * max(small, 0.5)


def test_ends_of_elements_that_were_never_opened_cost_nothing(spark):
    start = time.time()
    nodes = P._nodes_of("<div>" * 20_000 + "</p>" * 20_000 + "x")
    assert time.time() - start < 5 and len(nodes) == 20_001 and nodes[-1]["depth"] == 20_000
