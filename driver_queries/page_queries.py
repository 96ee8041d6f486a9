"""Page extraction: over the captured pages, and over product pages written from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.views import MARKET, table
from listguard.operators import pages as P

QUERIES, SQL = {}, {}


def add(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


# One listing page per 20 parts, its cards written from the parts.
_CARD = """concat('<article class="prd _fb" data-seller="S', CAST(p_size AS string), '"', CASE p_partkey % 3 WHEN 0 THEN concat(' data-id="D', CAST(p_partkey AS string), '"') ELSE '' END,
 '><a class="core" href="/', replace(p_name, ' ', '-'), '-', CAST(1000000 + p_partkey AS string), '.html"><img data-src="//img.example.com/', CAST(p_partkey AS string), '.jpg"/><div class="info"><h3 class="name"> ',
 p_name, ' &amp; more</h3><div class="brand">', p_brand, '</div><div class="prc">KSh 1,', CAST(100 + p_size AS string), '</div><div class="old">KSh 2,', CAST(200 + p_size AS string), '</div><div class="bdg _dsct">',
 CAST(p_size AS string), '%</div><div class="stars _s" style="width:', CAST(p_size * 2 AS string), '%">x</div><span class="rev">(', CAST(p_size AS string), ' ratings)</span>',
 CASE WHEN p_size % 2 = 0 THEN '<svg class="xpr"></svg>' ELSE '' END, '<p class="tags"><b>hot</b> <i>new</i></p></div></a></article>')"""


def listing_pages(spark, sf):
    cards = spark.sql(f"SELECT p_partkey, {_CARD} AS card FROM {{part}}", part=table(spark, sf, "part"))
    page = F.floor(F.col("p_partkey") / 20).alias("page_id")
    return cards.groupBy(page).agg(F.concat(
        F.lit('<html><body><section class="card"><p>unclosed'),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x.card), ""),
        F.lit("</section></body></html>")).alias("html"))


@add("p01_listing_cards", """SELECT CAST(floor(p_partkey / 20) AS bigint) AS page_id, CASE p_partkey % 3 WHEN 0 THEN concat('D', p_partkey) ELSE CAST(1000000 + p_partkey AS varchar) END AS "SKU",
 concat(p_name, ' & more') AS "Name", p_brand AS "Brand", '' AS "Category", concat('1', 100 + p_size) AS "Price", concat('2', 200 + p_size) AS "Old Price", concat(p_size, '%') AS "Discount",
 CAST(round_even(p_size * 2 / 20.0, 1) AS varchar) AS "Rating", CAST(p_size AS varchar) AS "Total Ratings", concat('S', p_size) AS "Seller", CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS "Express", 'No' AS "Shop Global",
 concat('https://img.example.com/', p_partkey, '.jpg') AS "Image URL", concat('https://x.example.com/', replace(p_name, ' ', '-'), '-', 1000000 + p_partkey, '.html') AS "Product URL", 'In Stock' AS "Stock", 'hot new' AS "Tags" FROM part""")
def p01(spark, sf):
    return P.listing_cards(listing_pages(spark, sf), "https://x.example.com")


@add("p02_page_count", """SELECT page_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(html, 'href="[^"]*page=(\\d+)', 1), lambda x: CAST(x AS integer))), 1) AS integer) AS pages FROM pages""")
def p02(spark, sf):
    return P.page_nodes(table(spark, sf, "pages"), ["page_id"]).select("page_id", P.page_count(F.col("nodes")).alias("pages"))


@add("p03_breadcrumb")
def p03(spark, sf):
    return P.page_nodes(table(spark, sf, "pages"), ["page_id"]).select("page_id", P.breadcrumb(F.col("nodes")).alias("crumb"))


# The text of a page's heading: a link list, a heading and paragraphs of the captured pages.
@add("p_nodes_links", """SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<li>')) AS items FROM pages""")
def p_nodes(spark, sf):
    nodes = F.col("nodes")
    return P.page_nodes(table(spark, sf, "pages"), ["page_id"]).select(
        "page_id", F.size(F.filter(nodes, lambda n: (n.tag == "a") & P.attr(n, "href").isNotNull())).alias("links"),
        F.size(F.filter(nodes, lambda n: n.tag == "li")).alias("items"))


# One product page per part.  Odd parts carry linked data, even ones plain markup only.
_PRODUCT = """concat('<html><head><title>', p_name, '</title>',
 CASE WHEN p_partkey % 2 = 1 THEN concat('<script type="application/ld+json">', CASE WHEN p_partkey % 4 = 1 THEN '[{{"@type":"Other"}},' ELSE '' END, '{{"@type":"Product","image":["http://i/', CAST(p_partkey AS string),
   '.jpg"],"description":"A fine ', p_name, ' for every workshop","brand":{{"name":" ', p_brand, ' "}},"model":"M', CAST(p_size AS string), '","gtin13":"', CAST(1000000000000 + p_partkey AS string),
   '","offers":{{"price":"1,', CAST(100 + p_size AS string), '","availability":"https://schema.org/OutOfStock"}},"aggregateRating":{{"ratingValue":"4.', CAST(p_size % 10 AS string), '","reviewCount":', CAST(p_size AS string), '}},"seller":{{"name":"', p_type, ' Ltd"}}}}',
   CASE WHEN p_partkey % 4 = 1 THEN ']' ELSE '' END, '</script>') ELSE concat('<script>var s=1; dataLayer = [{{"ecommerce":{{"detail":{{"products":[{{"price":"2,', CAST(100 + p_size AS string), '","brand":"', p_brand, '"}}]}}}}}}]; // padding padding padding</script>') END,
 '</head><body><header><a href="/x">Official Store</a></header><nav aria-label="breadcrumb"><a>Home</a><a>Tools</a><a>', p_type, '</a></nav><h1>Rose  Gold ', p_name, '</h1>',
 CASE WHEN p_partkey % 3 = 0 THEN concat('<span class="-b -ltr -tal -fs24">KSh 3,', CAST(100 + p_size AS string), '.50</span><span class="bdg _dsct _sm">', CAST(p_size AS string), '%</span>') ELSE '' END,
 '<ul class="-pvs -mvs"><li><span>EU ', CAST(30 + p_size % 10 AS string), '</span><span>Selected</span></li><li>', upper(split_part(p_name, ' ', 1)), '</li><li>Share</li><li>ColourRed</li><li>Cart</li></ul>',
 CASE WHEN p_partkey % 5 = 0 THEN '<p>Official Store</p>' ELSE '' END, '<div class="stars _s">', '3.', CAST(p_size % 10 AS string), ' out of 5</div><p>', CAST(p_size AS string), ' verified ratings</p><p>Only ', CAST(p_size AS string), ' left</p>',
 '<h2>Seller Information</h2><div class="seller-info"><a href="/s">Shop ', p_type, '</a></div>',
 '<h2>Key Features</h2><ul><li>One ', p_name, '</li><li>Two &lt;b&gt;</li></ul><h3>What&#39;s in the box</h3><ul><li>1 x ', p_name, '</li></ul>',
 '<h2>Product details</h2><p>Made of steel.</p><p>Made of steel.</p><div class="promo">no</div><p>Size ', CAST(p_size AS string), '</p><h2>Specifications</h2>',
 '<div class="spec-box"><ul><li>Model: X', CAST(p_size AS string), '</li><li>Weight (kg): ', CAST(p_size AS string), '</li><li>Main Material: Steel</li></ul></div><p>2 year warranty</p></body></html>')"""
_PROD_SQL = _PRODUCT.replace("{{", "{").replace("}}", "}")


def products(spark, sf):
    html = spark.sql(f"SELECT p_partkey, {_PRODUCT} AS html FROM {{part}}", part=table(spark, sf, "part"))
    return P.product_fields(html, ["p_partkey"], "https://x.example.com", MARKET)


_ODD = "p_partkey % 2 = 1"


@add("p04_p06_offer_fields", f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('3', 100 + p_size, '.50') WHEN {_ODD} THEN concat('1', 100 + p_size) ELSE concat('2', 100 + p_size) END AS "PRICE",
 CASE WHEN p_partkey % 3 = 0 THEN concat(p_size, '%') END AS "DISCOUNT", concat('Only ', p_size, ' left') AS "STOCK_STATUS", p_brand AS "BRAND",
 CASE WHEN {_ODD} THEN concat('4.', p_size % 10) ELSE concat('3.', p_size % 10) END AS "RATING", CAST(p_size AS varchar) AS "REVIEW_COUNT", CASE WHEN {_ODD} THEN concat('http://i/', p_partkey, '.jpg') END AS "MAIN_IMAGE" FROM part""")
def p04(spark, sf):
    return products(spark, sf).select("p_partkey", "PRICE", "DISCOUNT", "STOCK_STATUS", "BRAND", "RATING", "REVIEW_COUNT", "MAIN_IMAGE")


_WORD = "upper(split_part(p_name, ' ', 1))"
_TITLE = "concat('Rose Gold', CASE split_part(p_name, ' ', 1) WHEN 'red' THEN ', Red' WHEN 'blue' THEN ', Blue' ELSE '' END)"


@add("p07_p08_variants", f"""SELECT p_partkey, concat('EU ', 30 + p_size % 10) AS "SIZES_AVAILABLE", CASE WHEN {_WORD} IN ('NEW', 'HOT') THEN NULL ELSE {_WORD} END AS "COLOR", '1' AS "COUNT_VARIATIONS",
 replace({_TITLE}, 'Rose Gold', 'Rose  Gold') AS "COLOR_IN_TITLE" FROM part""")
def p07(spark, sf):
    return products(spark, sf).select("p_partkey", "SIZES_AVAILABLE", "COLOR", "COUNT_VARIATIONS", "COLOR_IN_TITLE")


@add("p09_p15_specifications", f"""SELECT p_partkey, CASE WHEN {_ODD} THEN concat('M', p_size) ELSE concat('X', p_size) END AS "MODEL", CASE WHEN {_ODD} THEN CAST(1000000000000 + p_partkey AS varchar) END AS "GTIN", CAST(p_size AS varchar) AS "WEIGHT",
 concat('Model: X', p_size, ' | Weight (kg): ', p_size, ' | Main Material: Steel | SKU: ', CASE WHEN {_ODD} THEN 'M' ELSE 'X' END, p_size) AS "SPECIFICATIONS",
 concat('SKU: ', CASE WHEN {_ODD} THEN 'M' ELSE 'X' END, p_size, ' | Weight: ', p_size, ' | Material: Steel') AS "KEY_SPECS" FROM part""")
def p09(spark, sf):
    return products(spark, sf).select("p_partkey", "MODEL", "GTIN", "WEIGHT", "SPECIFICATIONS", "KEY_SPECS")


@add("p11_p14_page_facts", """SELECT p_partkey, concat('Tools > ', p_type) AS "CATEGORY_PATH", CASE WHEN p_partkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS "IS_OFFICIAL_STORE",
 concat('Shop ', p_type) AS "SELLER_NAME", 'Yes' AS "PRODUCT_WARRANTY", '2 year warranty' AS "WARRANTY_DURATION" FROM part""")
def p11(spark, sf):
    return products(spark, sf).select("p_partkey", "CATEGORY_PATH", "IS_OFFICIAL_STORE", "SELLER_NAME", "PRODUCT_WARRANTY", "WARRANTY_DURATION")


@add("p16_p17_texts", f"""SELECT p_partkey, CASE WHEN {_ODD} THEN concat('A fine ', p_name, ' for every workshop') ELSE concat('Made of steel.', chr(10), 'Size ', p_size) END AS "DESCRIPTION",
 concat('One ', p_name, ' | Two <b>') AS "KEY_FEATURES", concat('1 x ', p_name) AS "WHATS_IN_BOX" FROM part""")
def p16(spark, sf):
    return products(spark, sf).select("p_partkey", "DESCRIPTION", "KEY_FEATURES", "WHATS_IN_BOX")


# A second page per part: what the first one has in the first place looked for stands in a later place here. Which one
# depends on the part: seven for the variants, six for the price, five for the seller, four for the stock and the breadcrumbs.
_SIZE = "CAST(30 + p_size % 10 AS string)"
_VARIED = f"""concat('<html><head><title>', CASE WHEN p_partkey % 7 = 6 THEN 'Teal gold thing' ELSE 'Thing' END, '</title>', CASE p_partkey % 6
 WHEN 4 THEN concat('<script>window.__STORES__ = {{{{"pdp":{{{{"product":{{{{"price":"4,', CAST(100 + p_size AS string), '","image":"http://s/', CAST(p_partkey AS string), '.png"}}}}}}}}}}}}; var after = 1;</script>')
 WHEN 5 THEN concat('<script>dataLayer.push({{{{"ecommerce":{{{{"detail":{{{{"price":"5,', CAST(100 + p_size AS string), '"}}}}}}}}}}}}) // more</script>')
 ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN concat('<meta property="og:image" content="http://o/', CAST(p_partkey AS string), '.jpg">') ELSE '' END, '</head><body>',
 CASE p_partkey % 4 WHEN 0 THEN concat('<ol class="breadcrumb"><li>Home</li><li>', p_type, '</li></ol>') WHEN 1 THEN concat('<div class="-fdr"><span>', p_type, '</span><span> home </span></div>')
  WHEN 2 THEN concat('<nav class="x breadcrumb"><a>no</a><span></span><span>Tools</span><p><span>', p_type, '</span></p></nav>') ELSE '<nav><span>none</span></nav>' END,
 '<h1>Thing</h1>',
 CASE p_partkey % 6 WHEN 0 THEN concat('<p><span class="prc">KSh 3,', CAST(100 + p_size AS string), '</span></p>') WHEN 1 THEN concat('<p><span data-price="x">KSh 3,', CAST(100 + p_size AS string), '</span></p>')
  WHEN 2 THEN concat('<p><span class="-ltr -tal -b">KSh 3,', CAST(100 + p_size AS string), '</span></p>') WHEN 3 THEN concat('<div class="-prc-w"><p><span>KSh 3,', CAST(100 + p_size AS string), '</span></p></div>') ELSE '' END,
 CASE WHEN p_partkey % 2 = 0 THEN concat('<span class="x _dsct">', CAST(p_size AS string), '%</span>') ELSE concat('<p class="my-discount">', CAST(p_size AS string), '% off</p>') END,
 CASE WHEN p_partkey % 2 = 1 THEN concat('<img class="-fw -fh" data-src="" src="http://a.png"><img class="-fh -fw" data-src="http://x/product/', CAST(p_partkey AS string), '.jpg">') ELSE '' END,
 CASE p_partkey % 3 WHEN 0 THEN '<div class="my-stars"><p><span>4.5 of 5</span></p></div><a href="/p#reviews">12 reviews</a>' WHEN 1 THEN '<div data-rating="3.9"></div><span class="revw-x">13 said</span>' ELSE '<p>No ratings yet</p>' END,
 CASE p_partkey % 7 WHEN 0 THEN concat('<p data-type="color"><span>Ash</span></p><p data-type="size"><span>EU ', {_SIZE}, '</span></p>') WHEN 1 THEN concat('<label class="my-color">Ash</label><li class="size-x"><b><span>EU ', {_SIZE}, '</span></b></li>')
  WHEN 2 THEN concat('<form action="/checkout/now"><select><option value="">Pick</option><option value="1">Ash</option><option disabled>Gone</option><option>EU ', {_SIZE}, '</option></select></form><select><option>No</option></select>')
  WHEN 3 THEN concat('<div class="size-row"><p><button>Ash</button></p><button>EU ', {_SIZE}, '</button><button>Share</button></div>') WHEN 4 THEN '<span class="color-selector">AshPlum</span>'
  WHEN 5 THEN concat('<section class="a -pvs">Variation available <b>Ash</b> EU', {_SIZE}, '</section>') ELSE '' END,
 CASE p_partkey % 4 WHEN 0 THEN '<span class="my-stock">FEW left</span>' WHEN 1 THEN '<p class="stock">low supply</p>' WHEN 2 THEN '<p>hurry, only 5 of them</p>' ELSE '<div class="out-of-stock"></div>' END,
 CASE p_partkey % 5 WHEN 0 THEN concat('<section class="my-seller"><a href="/s">Shop ', p_type, '</a></section>') WHEN 1 THEN concat('<a class="x-seller-name">Shop ', p_type, '</a>')
  WHEN 2 THEN concat('<h3>Seller Information</h3><p><a href="/f">Follow us</a><a href="/z">Shop ', p_type, '</a></p>') WHEN 3 THEN concat('<a href="/home/">Home</a><a href="/good-mart/">Mart ', CAST(p_size AS string), '</a>')
  ELSE '<b>Seller information</b><p> </p><p>Fine Goods</p>' END, '</body></html>')"""


def varied(spark, sf):
    return spark.sql(f"SELECT p_partkey, {_VARIED} AS html FROM {{part}}", part=table(spark, sf, "part"))


def varied_fields(spark, sf):
    return P.product_fields(varied(spark, sf), ["p_partkey"], "https://x.example.com", MARKET)


@add("p03_breadcrumb_branches", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_type END AS crumb FROM part""")
def p03_branches(spark, sf):
    return P.page_nodes(varied(spark, sf), ["p_partkey"]).select("p_partkey", P.breadcrumb(F.col("nodes")).alias("crumb"))


@add("p05_p06_later_selectors", """SELECT p_partkey, concat(CASE p_partkey % 6 WHEN 4 THEN '4' WHEN 5 THEN '5' ELSE '3' END, 100 + p_size) AS "PRICE", concat(p_size, CASE WHEN p_partkey % 2 = 0 THEN '%' ELSE '% off' END) AS "DISCOUNT",
 CASE p_partkey % 4 WHEN 0 THEN 'Few left' WHEN 1 THEN 'Low supply' WHEN 2 THEN 'Hurry, only 5' ELSE 'Out of Stock' END AS "STOCK_STATUS", CASE p_partkey % 3 WHEN 0 THEN '4.5' WHEN 1 THEN '3.9' ELSE '0' END AS "RATING",
 CASE p_partkey % 3 WHEN 0 THEN '12' WHEN 1 THEN '13' ELSE '0' END AS "REVIEW_COUNT",
 CASE WHEN p_partkey % 6 = 4 THEN concat('http://s/', p_partkey, '.png') WHEN p_partkey % 2 = 0 THEN concat('http://o/', p_partkey, '.jpg') ELSE concat('http://x/product/', p_partkey, '.jpg') END AS "MAIN_IMAGE" FROM part""")
def p05(spark, sf):
    return varied_fields(spark, sf).select("p_partkey", "PRICE", "DISCOUNT", "STOCK_STATUS", "RATING", "REVIEW_COUNT", "MAIN_IMAGE")


@add("p07_later_strategies", """SELECT p_partkey, CASE WHEN p_partkey % 7 < 4 THEN concat('EU ', 30 + p_size % 10) WHEN p_partkey % 7 = 5 THEN concat('EU', 30 + p_size % 10) END AS "SIZES_AVAILABLE",
 CASE p_partkey % 7 WHEN 4 THEN 'Ash, Plum' WHEN 6 THEN 'Teal, Gold' ELSE 'Ash' END AS "COLOR", CASE WHEN p_partkey % 7 IN (4, 6) THEN '2' ELSE '1' END AS "COUNT_VARIATIONS" FROM part""")
def p07_later(spark, sf):
    return varied_fields(spark, sf).select("p_partkey", "SIZES_AVAILABLE", "COLOR", "COUNT_VARIATIONS")


@add("p13_later_strategies", """SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN concat('Mart ', p_size) WHEN 4 THEN 'Fine Goods' ELSE concat('Shop ', p_type) END AS "SELLER_NAME" FROM part""")
def p13(spark, sf):
    return varied_fields(spark, sf).select("p_partkey", "SELLER_NAME")


@add("p10_captured_pages")
def p10(spark, sf):
    """Every page field of the captured pages."""
    return P.product_fields(table(spark, sf, "pages"), ["page_id"], "", MARKET)
