"""Listings, rules and weekly rows derived from the driver's tables.

Each view is one SQL text that Spark and the comparing engine both read, so a query and its
SQL differ only in the operator under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listguard.market import Market
from listguard.sources import rules as R

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
MARKET = Market(name="the shop", shop_prefix="SHOP-", official_tag="OFFI",
                domains={"example.com": "KE", "example.net": "NG", "example.org": "GH"})
POS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

VIEWS = {
    "listings": """
SELECT concat(CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string)) AS PRODUCT_SET_SID,
  CASE (l_orderkey + l_suppkey) % 16
    WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' 500ml') WHEN 2 THEN concat(p_name, ' 64GB')
    WHEN 3 THEN concat(p_name, ' 20,000mAh') WHEN 4 THEN concat('Refurbished ', p_name)
    WHEN 5 THEN concat(p_name, ' pack of 3') WHEN 6 THEN split_part(p_name, ' ', 2)
    WHEN 7 THEN concat('Tester-', p_name) WHEN 8 THEN concat('  ', upper(p_name), ' new ')
    WHEN 9 THEN concat(p_brand, '-', p_name) WHEN 10 THEN concat(p_name, ' case ', lower(p_brand))
    WHEN 11 THEN NULL WHEN 12 THEN concat('<b>', p_name, '</b>')
    WHEN 13 THEN concat(p_name, ' BUY NOW best') WHEN 14 THEN concat(p_name, '  ', p_name)
    ELSE concat('Hot ', p_name, ', 9000 mAh') END AS NAME,
  CASE l_partkey % 8 WHEN 0 THEN 'Generic' WHEN 1 THEN 'Fashion' WHEN 2 THEN upper(split_part(p_name, ' ', 2))
    WHEN 3 THEN ' HP ' WHEN 4 THEN 'Apple' WHEN 5 THEN NULL ELSE p_brand END AS BRAND,
  CASE l_suppkey % 4 WHEN 0 THEN concat('Hardware / ', p_type, ' / size ', CAST(p_size AS string))
    WHEN 1 THEN concat(p_type, ' > size ', CAST(p_size AS string)) WHEN 2 THEN 'Miscellaneous'
    ELSE concat('Fashion cover / ', p_type) END AS CATEGORY,
  concat(' ', CAST(1000000 + p_size AS string), CASE WHEN l_linenumber % 2 = 0 THEN '.0' ELSE '' END) AS CATEGORY_CODE,
  CASE WHEN l_orderkey % 11 = 0 THEN 'Multiple' ELSE CASE s_nationkey % 5 WHEN 0 THEN 'shop-ke'
    WHEN 1 THEN ' UG ' WHEN 2 THEN 'NG' WHEN 3 THEN 'gh' ELSE 'SHOP-MA' END END AS ACTIVE_STATUS_COUNTRY,
  s_name AS SELLER_NAME, concat('P', CAST(l_partkey AS string)) AS PARENTSKU,
  concat('SKU', CAST(l_suppkey AS string), '-', CAST(l_partkey AS string)) AS SELLER_SKU,
  CASE l_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN NULL ELSE '' END AS COLOR,
  CASE l_suppkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) ELSE NULL END AS COLOR_FAMILY,
  CAST(p_retailprice AS string) AS GLOBAL_PRICE,
  CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN '12d' WHEN 2 THEN '0'
    ELSE CAST(floor(l_extendedprice / l_quantity * 100) / 100 AS string) END AS GLOBAL_SALE_PRICE,
  CASE l_suppkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '3.7' WHEN 2 THEN NULL WHEN 3 THEN 'x' ELSE '1' END
    AS COUNT_VARIATIONS,
  CASE l_partkey % 4 WHEN 0 THEN '1 Year' WHEN 1 THEN 'n/a' ELSE NULL END AS PRODUCT_WARRANTY,
  CASE l_partkey % 6 WHEN 0 THEN '12 months' WHEN 1 THEN ' none ' ELSE NULL END AS WARRANTY_DURATION,
  CASE l_suppkey % 7 WHEN 0 THEN s_name ELSE NULL END AS WARRANTY_ADDRESS,
  CASE l_suppkey % 6 WHEN 0 THEN 'Seller' ELSE NULL END AS WARRANTY_TYPE,
  CASE l_partkey % 5 WHEN 0 THEN 'S | M' ELSE NULL END AS LIST_VARIATIONS,
  CASE l_suppkey % 3 WHEN 0 THEN concat('http://img.example.com/', CAST(l_partkey AS string), '.jpg')
    WHEN 1 THEN '' ELSE concat('https://img.example.com/', CAST(l_partkey AS string), '.jpg') END AS MAIN_IMAGE,
  CASE WHEN l_returnflag = 'A' THEN 'a.csv' WHEN l_returnflag = 'N' THEN 'b.csv' ELSE 'c.csv' END AS _file,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "published": """
SELECT concat('SKU', CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string)) AS PRODUCT_SET_SID,
  CASE l_orderkey % 4 WHEN 0 THEN concat(p_brand, ' ', p_name, ' ', lower(p_brand)) ELSE p_name END AS NAME,
  CASE l_partkey % 5 WHEN 0 THEN 'Generic' WHEN 1 THEN 'Fashion' ELSE p_brand END AS BRAND,
  CASE l_suppkey % 3 WHEN 0 THEN concat('Hardware / ', p_type, ' / size ', CAST(p_size AS string))
    WHEN 1 THEN concat('Fashion / ', p_type) ELSE concat('unknown ', p_type) END AS CATEGORY,
  CASE l_suppkey % 3 WHEN 0 THEN CAST(1000000 + p_size AS string) ELSE concat(' ', lower(p_type)) END AS CATEGORY_CODE,
  CAST(CASE l_linenumber % 4 WHEN 0 THEN p_retailprice * 600 ELSE p_retailprice END AS string) AS GLOBAL_PRICE,
  CAST(floor(l_extendedprice / l_quantity * 100) / 100 AS string) AS GLOBAL_SALE_PRICE,
  CAST(CASE WHEN l_partkey % 9 = 0 THEN p_retailprice * 20 ELSE p_retailprice END AS string) AS OLD_PRICE,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(CAST(l_discount * 100 AS integer) AS string), '%')
    ELSE '' END AS DISCOUNT,
  CASE l_suppkey % 4 WHEN 0 THEN NULL ELSE CAST(l_tax * 50 AS string) END AS RATING,
  CASE l_suppkey % 5 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE CAST(l_linenumber AS string) END AS REVIEW_COUNT,
  CASE l_suppkey % 2 WHEN 0 THEN 'offi,sale' ELSE NULL END AS TAGS,
  CASE l_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN 'None' ELSE NULL END AS COLOR_IN_TITLE,
  CASE l_partkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN '' ELSE NULL END AS COLOR,
  CASE l_suppkey % 3 WHEN 0 THEN 'S, M' ELSE NULL END AS SIZES_AVAILABLE,
  s_name AS SELLER_NAME, CAST(l_linenumber AS string) AS n_images,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "weekly": """
SELECT CAST(o_orderdate AS date) AS Date,
  CASE o_orderstatus WHEN 'F' THEN 'Rejected' WHEN 'O' THEN 'Approved' ELSE 'Pending' END AS status,
  o_orderpriority AS flag, c_name AS seller, c_mktsegment AS category, o_orderkey
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "category_role": """
SELECT CAST(1000000 + p_size AS string) AS code, role FROM (SELECT DISTINCT p_size FROM {part}) p
JOIN (VALUES ('fashion', 5, 0), ('sneaker', 4, 1), ('weight', 3, 0), ('warranty', 7, 1), ('variation', 2, 0),
  ('smartphone', 6, 2), ('duplicate_exempt', 9, 0), ('color', 2, 1), ('book', 8, 3), ('perfume', 4, 2),
  ('jersey', 5, 1), ('phone', 6, 1), ('laptop', 6, 3), ('ng_gift', 10, 4), ('ng_tv', 3, 1), ('ng_hp', 2, 0),
  ('ng_power', 2, 1)) AS t(role, m, r) ON p_size % m = r""",
    "approved_seller": """
SELECT kind, country, lower(s_name) AS seller FROM {supplier}
JOIN (VALUES ('phone', 3, 0), ('laptop', 3, 1), ('book', 2, 0), ('perfume', 4, 0), ('jersey_exempt', 5, 0),
  ('ng_gift', 2, 1), ('ng_hp', 3, 2), ('ng_apple', 4, 1), ('ng_xmas', 5, 2)) AS t(kind, m, r) ON s_suppkey % m = r
CROSS JOIN (VALUES ('KE'), ('NG')) AS c(country)""",
    "price_floor": """
SELECT c.country AS country, lower(p_brand) AS brand, CAST(1000000 + p_size AS string) AS category_code,
  max(p_retailprice) AS threshold
FROM {part} CROSS JOIN (SELECT 'KE' AS country UNION ALL SELECT 'NG' AS country) c GROUP BY 1, 2, 3""",
    "brand_sheet": """
SELECT c.country AS country, concat(' ', brand) AS brand,
  CASE WHEN n % 3 = 0 THEN '' ELSE concat('Supplier#00000000', CAST(n % 10 AS string), ', Supplier#000000011') END
    AS approved_sellers,
  CASE WHEN n % 4 = 0 THEN concat(CAST(1000000 + n AS string), '.0,', CAST(1000001 + n AS string)) ELSE NULL END
    AS categories,
  CASE WHEN n % 5 = 0 THEN 'Anvil, hot rod' WHEN n % 5 = 1 THEN 'bolt' ELSE NULL END AS variations, n AS _pos
FROM (SELECT DISTINCT p_brand AS brand, CAST(split_part(p_brand, '#', 2) AS integer) AS n FROM {part}) b
CROSS JOIN (SELECT 'KE' AS country UNION ALL SELECT 'NG' AS country) c""",
    "prohibited_sheet": """
SELECT c.country AS country, word AS keyword,
  CASE WHEN n % 3 = 0 THEN concat(CAST(1000000 + n AS string), ',', CAST(1000010 + n AS string)) ELSE '' END
    AS categories, n AS _pos
FROM (SELECT DISTINCT p_name AS word, length(p_name) AS n FROM {part}
  UNION SELECT DISTINCT split_part(p_name, ' ', 2) AS word, 20 + length(p_name) AS n FROM {part}) w
CROSS JOIN (SELECT 'KE' AS country UNION ALL SELECT 'NG' AS country) c""",
    "word_list": """
SELECT list, word FROM (VALUES ('unnecessary', 'BUY NOW'), ('unnecessary', 'best'), ('unnecessary', 'new'),
  ('color', 'red'), ('color', 'blue'), ('sneaker_brand', 'anvil'), ('sneaker_brand', 'ld r'),
  ('known_brand', 'Hot'), ('known_brand', 'small ring'), ('known_brand', 'refurbished'), ('known_brand', 'old-bolt'),
  ('blacklist', 'plate'), ('blacklist', 'cold'), ('blacklist', 'cold plate')) AS t(list, word)""",
    "keyword_rule": """
SELECT kind, country, keyword FROM (VALUES ('refurb', 'KE', 'refurbished'), ('refurb', 'KE', 'old'),
  ('perfume', 'KE', 'ring'), ('perfume', 'KE', 'hp'), ('perfume', 'KE', 'blue bolt'),
  ('jersey', 'KE', 'anvil'), ('jersey', 'NG', 'anvil'), ('jersey', 'KE', 'hot rod'),
  ('xmas', 'KE', 'gear'), ('xmas', 'KE', 'red ring')) AS t(kind, country, keyword)""",
    "book_sheet": """
SELECT DISTINCT p_name AS title, CASE WHEN length(p_name) % 2 = 0 THEN NULL ELSE 'Supplier#000000003' END AS seller,
  length(p_name) * 1000 + ascii(p_name) * 3 + ascii(split_part(p_name, ' ', 2)) AS _pos
FROM {part}
UNION SELECT DISTINCT 'rod' AS title, NULL AS seller, 1 AS _pos FROM {part}""",
    "tv_seller": """
SELECT DISTINCT lower(p_brand) AS brand, lower(s_name) AS seller FROM {part} JOIN {supplier}
ON p_size = s_suppkey % 50""",
    "rice_sheet": """
SELECT DISTINCT p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN 'Supplier#000000001, Supplier#000000002' ELSE '' END
  AS sellers, CASE WHEN p_brand LIKE '%2' THEN NULL ELSE CAST(1000000 + p_size AS string) END AS category
FROM {part}""",
    "category_sheet": """
SELECT concat(p_type, ' size ', CAST(p_size AS string)) AS name, CAST(1000000 + p_size AS string) AS code,
  concat(CASE p_size % 3 WHEN 0 THEN 'Fashion' ELSE 'Hardware' END, ' / ', p_type, ' / size ', CAST(p_size AS string)) AS path,
  min(p_partkey) AS _pos
FROM {part} GROUP BY p_type, p_size""",
    "name_categories": """
SELECT concat('Hardware > ', split_part(p_name, ' ', 2), ' goods > ', p_name) AS category, min(p_partkey) AS _pos
FROM {part} GROUP BY p_name""",
    "keyword_weights": """
SELECT lower(concat('Hardware > ', split_part(p_name, ' ', 2), ' goods > ', p_name)) AS category,
  split_part(p_name, ' ', 2) AS keyword, 0.5 + length(p_name) / 100.0 AS weight
FROM {part} GROUP BY p_name
UNION ALL SELECT 'hot rod' AS category, 'refurbished' AS keyword, 2.0 AS weight""",
}


_OPENED: dict = {}
# Tables whose rows carry work worth spreading when their one small file is one split.
_SPREAD = {"lineitem", "orders", "documents", "pages", "part"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a plan; its schema and split count are read once per session.

    A file with fewer splits than there are cores is spread over them.  Real inputs have many
    more splits than cores and are left as they are.
    """
    owner, df = _OPENED.get((sf, name), (None, None))
    if owner is not spark:
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        cores = spark.sparkContext.defaultParallelism
        if name in _SPREAD and df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
        _OPENED[(sf, name)] = (spark, df)
    return df


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def tv_sellers(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the view ``tv_seller``: repeats go before the join as well, which else pairs every part with every supplier of its size."""
    brands = table(spark, sf, "part").selectExpr("lower(p_brand) AS brand", "CAST(p_size AS bigint) AS _size").distinct()
    sellers = table(spark, sf, "supplier").selectExpr("lower(s_name) AS seller", "CAST(s_suppkey AS bigint) % 50 AS _size").distinct()
    return brands.join(sellers, "_size").select("brand", "seller").distinct()


def cte(name: str) -> str:
    return f"{name} AS ({VIEWS[name].format(**{t: t for t in TABLES})})"


def listings(spark: SparkSession, sf: str, name: str = "listings") -> DataFrame:
    """The listing view with its order as one struct."""
    df = view(spark, sf, name)
    return df.withColumn("_pos", F.struct(*POS)).drop("l_orderkey", "l_linenumber", "l_suppkey",
                                                      "l_extendedprice", "l_shipdate")


def rule_book(spark: SparkSession, sf: str, country: str = "KE", *names: str) -> R.RuleBook:
    """Rule tables from the views; only the named ones when names are given."""
    makers = {
        "category_role": lambda: view(spark, sf, "category_role"),
        "approved_seller": lambda: view(spark, sf, "approved_seller"),
        "price_floor": lambda: view(spark, sf, "price_floor"),
        "restricted_brand": lambda: R.restricted_brands(view(spark, sf, "brand_sheet")),
        "prohibited": lambda: R.prohibited_rules(view(spark, sf, "prohibited_sheet")),
        "word_list": lambda: view(spark, sf, "word_list"),
        "keyword_rule": lambda: view(spark, sf, "keyword_rule"),
        "ng_book": lambda: R.nigeria_books(view(spark, sf, "book_sheet")),
        "ng_tv": lambda: tv_sellers(spark, sf),
        "ng_rice": lambda: R.nigeria_rice(view(spark, sf, "rice_sheet")),
        "ng_power_brand": lambda: spark.createDataFrame([("hp",), ("brand#7",)], "brand string"),
        "category_map": lambda: view(spark, sf, "category_sheet"),
    }
    chosen = names or makers
    return R.RuleBook(spark, {n: makers[n] for n in chosen}, MARKET, country)
