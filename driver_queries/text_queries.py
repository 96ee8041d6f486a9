"""Normalisation and scalar functions over listings, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import sql as S
from driver_queries.views import MARKET, VIEWS, cte, listings, table, view
from listguard.functions import prices, text as tx, urls
from listguard.operators import audit, ingest
from listguard.operators.keywords import bounded_word
from listguard.operators.review import category_paths
from listguard.sources.rules import codes_to_paths

QUERIES, SQL = {}, {}


def add(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


ID = "PRODUCT_SET_SID, l_partkey"


@add("n01_standardise_columns", S.with_("listings") + """SELECT PRODUCT_SET_SID, NAME, BRAND, CATEGORY_CODE, SELLER_NAME, PARENTSKU,
 coalesce(COLOR, COLOR_FAMILY) AS COLOR, '' AS MAIN_IMAGE, l_partkey AS "TAX_CLASS" FROM listings""")
def n01(spark, sf):
    df = listings(spark, sf)
    raw = df.select(F.col("PRODUCT_SET_SID").alias(" cod_productset_sid"), F.col("NAME").alias("dsc_name"),
                    F.col("BRAND").alias("DSC_Brand_Name"), F.col("CATEGORY_CODE").alias("cod_category_code"),
                    F.col("SELLER_NAME").alias("dsc_shop_seller_name"), F.col("PARENTSKU").alias("cod_parent_sku"),
                    F.col("COLOR").alias("color"), F.col("COLOR_FAMILY").alias("Colour"),
                    F.col("l_partkey").alias("tax_class"))
    return ingest.standardise_listings(raw)


# Texts with the broken sequences a wrong decoding leaves behind, made from part names.
_BROKEN = """concat(' ', p_name, CASE p_partkey % 7 WHEN 0 THEN ' â€“ x' WHEN 1 THEN 'â€™s' WHEN 2 THEN ' caf' || 'Ã©' WHEN 3 THEN ' Â5'
  WHEN 4 THEN ' â„¢' WHEN 5 THEN ' â€¦' ELSE ' â€œq' END)"""


def _replace(c, pairs):
    for broken, fixed in pairs:
        c = "replace(%s, '%s', '%s')" % (c, broken, fixed.replace("'", "''"))
    return c


@add("n02_fix_mojibake", f"SELECT p_partkey, trim({_replace(_BROKEN, tx.MOJIBAKE)}) AS NAME FROM part")
def n02(spark, sf):
    df = spark.sql(f"SELECT p_partkey, {_BROKEN} AS NAME FROM {{part}}", part=table(spark, sf, "part"))
    return ingest.fix_encoding_artifacts(df)


@add("n03_repair_encoding", f"""SELECT doc_id, text FROM documents""")
def n03(spark, sf):
    """Texts damaged by reading UTF-8 as Latin-1 or Windows-1252 come back unchanged."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    plain = docs.withColumn("text", tx.drop_control(F.col("text")))
    # Decoding the bytes as Latin-1 is what the damage is; ISO-8859-1 maps every byte.
    broken = plain.withColumn("text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    # Every second text was read as Windows-1252 instead; it has no character for five of the bytes.
    as_windows = F.translate("text", ingest._TO, ingest._FROM)
    read = F.when((F.col("doc_id") % 2 == 0) & ~F.col("text").rlike("[\x81\x8d\x8f\x90\x9d]"), as_windows).otherwise(F.col("text"))
    return ingest.repair_encoding(broken.withColumn("text", read), ["text"])


SQL["n03_repair_encoding"] = "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS text FROM documents"


@add("n04_audit_columns", S.with_("published") + """SELECT PRODUCT_SET_SID, NAME, GLOBAL_SALE_PRICE, GLOBAL_PRICE, COLOR,
 n_images AS "EXPRESS", l_partkey AS "Other" FROM published""")
def n04(spark, sf):
    p = view(spark, sf, "published")
    return ingest.standardise_audit(p.select(
        F.col("PRODUCT_SET_SID").alias("SKU"), F.col("NAME").alias("Name "), F.col("GLOBAL_SALE_PRICE").alias("newPrice"),
        F.col("GLOBAL_PRICE").alias("Old Price"), F.col("COLOR").alias("Colour"),
        F.col("n_images").alias("Shop Express"), F.col("l_partkey").alias("Other")))


@add("n05_report_columns", S.with_("published") + """SELECT PRODUCT_SET_SID, NAME, GLOBAL_PRICE, OLD_PRICE, 'UNKNOWN' AS ACTIVE_STATUS_COUNTRY,
 false AS "_IS_MULTI_COUNTRY", PRODUCT_SET_SID AS PARENTSKU, '' AS COLOR, '' AS COLOR_FAMILY, GLOBAL_PRICE AS GLOBAL_SALE_PRICE, '1' AS COUNT_VARIATIONS, l_partkey FROM published""")
def n05(spark, sf):
    p = view(spark, sf, "published")
    return ingest.standardise_report_input(p.select(
        F.col("PRODUCT_SET_SID").alias("SKU"), F.col("NAME").alias("Name"), F.col("GLOBAL_PRICE").alias("Price"),
        F.col("OLD_PRICE").alias("Old Price"), "l_partkey"))


@add("n06_n07_file_kind", S.with_("published") + "SELECT count(*) AS n, 'post_qc' AS kind, 'Missing: CATEGORY_CODE,Missing: ACTIVE_STATUS_COUNTRY' AS errors FROM published")
def n06(spark, sf):
    p = view(spark, sf, "published").select(
        F.col("PRODUCT_SET_SID").alias("SKU"), "NAME", "BRAND", F.col("CATEGORY").alias("category"),
        F.col("GLOBAL_PRICE").alias("Price"), F.col("SELLER_NAME").alias("Seller"))
    kind = ingest.file_kind(p.columns)
    errors = ingest.schema_errors(ingest.standardise_audit(p).columns)
    return p.agg(F.count("*").alias("n")).select("n", F.lit(kind).alias("kind"), F.lit(",".join(errors)).alias("errors"))


@add("n08_n09_clean_keys", S.with_("listings") + f"""SELECT {ID}, {S.code('CATEGORY_CODE')} AS code, {S.norm('NAME')} AS name_key FROM listings""")
def n08(spark, sf):
    return listings(spark, sf).select("PRODUCT_SET_SID", "l_partkey", tx.clean_code(F.col("CATEGORY_CODE")).alias("code"),
                                      tx.normalize_text(F.col("NAME")).alias("name_key"))


@add("n10_match_key", S.with_("listings") + f"""SELECT {ID}, concat({S.norm('BRAND')}, '|', {S.norm('NAME')}, '|', {S.norm('COLOR')}) AS k FROM listings""")
def n10(spark, sf):
    return listings(spark, sf).select("PRODUCT_SET_SID", "l_partkey",
                                      tx.match_key(F.col("BRAND"), F.col("NAME"), F.col("COLOR")).alias("k"))


def _colors_sql(text="text", explicit="source"):
    parts = []
    for base, variants in tx.COLOR_VARIANTS.items():
        words = "|".join(variants)
        parts.append(rf"CASE WHEN regexp_matches(lower(coalesce({text}, '')), '\b({words})\b') OR coalesce(regexp_matches(lower({explicit}), '({words})'), false) THEN '{base}' END")
    return "array_to_string(list_sort(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)), ',')"


@add("n11_colors", f"SELECT doc_id, {_colors_sql()} AS colors FROM documents")
def n11(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(tx.extract_colors(F.col("text"), F.col("source")), ",").alias("colors"))


_ALLCOL = "|".join(sorted((v for vs in tx.COLOR_VARIANTS.values() for v in vs), key=len, reverse=True))


def _plain_name(c):
    x = rf"regexp_replace(lower(coalesce({c}, '')), '\b({_ALLCOL})\b', '', 'g')"
    x = rf"regexp_replace({x}, '\b(?:xxs|xs|small|medium|large|xl|xxl|xxxl)\b', '', 'g')"
    x = rf"""regexp_replace({x}, '\b\d+\s*(?:gb|tb|inch|inches|"|ram|memory|ddr|pack|piece|pcs)\b', '', 'g')"""
    x = rf"regexp_replace({x}, '\b(?:new|original|genuine|authentic|official|premium|quality|best|hot|sale|promo|deal)\b', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@add("n12_remove_attributes", S.with_("listings") + f"SELECT {ID}, {_plain_name('NAME')} AS base FROM listings")
def n12(spark, sf):
    return listings(spark, sf).select("PRODUCT_SET_SID", "l_partkey", tx.remove_attributes(F.col("NAME")).alias("base"))


_b = "lower(trim(BRAND))"


@add("n13_product_attributes", S.with_("listings") + f"""SELECT {ID}, trim(CASE WHEN coalesce({_b} <> '' AND NOT contains({_plain_name(S.strip('NAME'))}, {_b})
 AND {_b} NOT IN ('generic', 'fashion'), false) THEN concat({_b}, ' ', {_plain_name(S.strip('NAME'))}) ELSE {_plain_name(S.strip('NAME'))} END) AS base_name,
 {_colors_sql(S.strip('NAME'), 'COLOR')} AS colors, '' AS sizes, '' AS storage, '' AS memory, '' AS quantities, coalesce({S.strip('NAME')}, '') AS raw_name FROM listings""")
def n13(spark, sf):
    found = listings(spark, sf).select("PRODUCT_SET_SID", "l_partkey", tx.product_attributes(
        F.col("NAME"), F.col("COLOR"), F.col("BRAND")).alias("a")).select("PRODUCT_SET_SID", "l_partkey", "a.*")
    return found.withColumns({c: F.array_join(c, ",") for c in ("colors", "sizes", "storage", "memory", "quantities")})


@add("n14_matcher_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def n14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.matcher_text(F.col("text")).alias("clean"))


_seg = "string_split(CATEGORY, CASE WHEN contains(CATEGORY, '/') THEN '/' ELSE '>' END)"


@add("n15_path_segments", S.with_("listings") + f"""SELECT DISTINCT CATEGORY, lower(trim({_seg}[1])) AS top, lower(trim({_seg}[-1])) AS leaf,
 len({_seg}) AS n FROM listings""")
def n15(spark, sf):
    c = F.col("CATEGORY")
    return listings(spark, sf).select("CATEGORY").distinct().select(
        "CATEGORY", tx.path_top(c).alias("top"), tx.path_leaf(c).alias("leaf"), F.size(tx.path_segments(c)).alias("n"))


_USD = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN 'x' WHEN 3 THEN '-5' ELSE CAST(o_totalprice AS string) END"


def _local(symbol, rate, decimals):
    value = f"CAST(o_totalprice AS double) * {rate}"
    return f"CASE WHEN o_orderkey % 7 > 3 AND o_totalprice > 0 THEN concat('{symbol} ', format('{{:,.{decimals}f}}', {value})) ELSE '' END"


@add("n26_local_price", f"""SELECT o_orderkey, {_local('KSh', 128.0, 0)} AS kenya, {_local('USh', 3750.0, 0)} AS uganda, {_local('₦', 1550.0, 0)} AS nigeria,
 {_local('GH₵', 15.5, 2)} AS ghana, {_local('MAD', 10.1, 2)} AS morocco, {_local('$', 1.0, 2)} AS elsewhere FROM orders""")
def n26(spark, sf):
    usd = spark.sql(f"SELECT o_orderkey, {_USD} AS usd FROM {{orders}}", orders=table(spark, sf, "orders"))
    return usd.select("o_orderkey", *[prices.local_price(F.col("usd"), c).alias(c.lower()) for c in (
        "Kenya", "Uganda", "Nigeria", "Ghana", "Morocco", "Elsewhere")])


# Product addresses made from listings: a stock code, a long number, or neither.
_URL = """concat('https://www.example.', CASE l_suppkey % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'net' ELSE 'org' END, '/', replace(p_name, ' ', '-'), '-',
  CASE l_orderkey % 4 WHEN 0 THEN concat('GE', CAST(100000 + l_orderkey % 800000 AS string), 'C6NAFAMZ-500ml') WHEN 1 THEN concat('ab', CAST(10000000000 + l_orderkey AS string))
  WHEN 2 THEN CAST(1000000 + l_partkey AS string) ELSE 'plain-long-name-here' END, CASE WHEN l_linenumber % 2 = 0 THEN '.html?x=1' ELSE '.html' END)"""
_LINES = f"""SELECT CASE WHEN l_linenumber % 3 = 0 THEN concat('  SKU', CAST(l_partkey AS string), '-', CAST(l_suppkey AS string)) ELSE {_URL} END AS line,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
_SLUG = r"regexp_replace(regexp_replace(regexp_replace(u, '/+$', ''), '^.*/', ''), '\.html.*$', '')"
_CODES = (r"list_filter(list_reverse(string_split({s}, '-')), lambda p: length(p) BETWEEN 12 AND 30 AND regexp_matches(p, '[A-Za-z]') AND regexp_matches(p, '[0-9]')"
          r" AND NOT regexp_matches(p, '(?i)^[\dA-Z]*(ML|KG|GB|TB|CM|MM|GM|MG|PC|PCS|L)+[\dA-Z]*$'))").replace("{s}", _SLUG)
_SKU = f"upper(coalesce(list_filter({_CODES}, lambda p: regexp_matches(p, '(?i)NAFAMZ$'))[1], {_CODES}[1]))"


def lines(spark, sf):
    df = spark.sql(_LINES, lineitem=table(spark, sf, "lineitem"), part=table(spark, sf, "part"))
    return df.withColumn("_pos", F.struct(*[F.col(c) for c in S.ORDER.split(", ")]))


_LINES_SQL = _LINES.format(lineitem="lineitem", part="part")


@add("n27_n28_url_sku", f"""WITH x AS (SELECT *, line AS u FROM ({_LINES_SQL}) WHERE line LIKE 'http%')
SELECT l_orderkey, l_partkey, l_suppkey, {_SKU} AS sku, CASE WHEN contains(u, 'example.com') THEN 'KE' WHEN contains(u, 'example.net') THEN 'NG' ELSE 'GH' END AS country FROM x""")
def n27(spark, sf):
    u = F.col("line")
    return lines(spark, sf).where(u.startswith("http")).select(
        "l_orderkey", "l_partkey", "l_suppkey", urls.sku_from_url(u).alias("sku"),
        urls.country_from_url(u, MARKET.domains).alias("country"))


@add("n29_lookup_inputs", f"""WITH x AS (SELECT *, trim(line) AS u FROM ({_LINES_SQL})),
y AS (SELECT *, CASE WHEN u LIKE 'http%' THEN coalesce({_SKU}, CASE WHEN regexp_extract({_SLUG}, '(\\d{{6,}})$', 1) <> '' THEN regexp_extract({_SLUG}, '(\\d{{6,}})$', 1)
  ELSE {_SLUG} END) ELSE trim(split_part(u, '-', 1)) END AS sku FROM x)
SELECT sku, u AS input, CASE WHEN u LIKE 'http%' THEN u END AS url, CASE WHEN u NOT LIKE 'http%' THEN NULL WHEN contains(u, 'example.com') THEN 'KE' WHEN contains(u, 'example.net') THEN 'NG' ELSE 'GH' END AS country_hint
FROM y QUALIFY row_number() OVER (PARTITION BY sku ORDER BY {S.ORDER}) = 1""")
def n29(spark, sf):
    return audit.lookup_inputs(lines(spark, sf), MARKET)


@add("n30_base_sku", S.with_("listings") + "SELECT SELLER_SKU, trim(split_part(SELLER_SKU, '-', 1)) AS base FROM listings")
def n30(spark, sf):
    return listings(spark, sf).select("SELLER_SKU", urls.base_sku(F.col("SELLER_SKU")).alias("base"))


@add("n31_strip_tags", "SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS text FROM pages")
def n31(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@add("n32_display_category", S.with_("listings", "category_sheet") + f"""SELECT {ID}, coalesce(p.path, {S.strip('CATEGORY_CODE')}) AS CATEGORY
FROM listings LEFT JOIN (SELECT code, lower(arg_max(path, _pos)) AS path FROM category_sheet GROUP BY 1) p ON p.code = {S.strip('CATEGORY_CODE')}""")
def n32(spark, sf):
    paths = codes_to_paths(view(spark, sf, "category_sheet"))
    return category_paths(listings(spark, sf), paths).select("PRODUCT_SET_SID", "l_partkey", "CATEGORY")


@add("n33_word_pattern", r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:buy now|the|of|and)\b')) AS hits FROM documents")
def n33(spark, sf):
    pattern = tx.word_pattern(["the", "of", "BUY NOW", "and"])
    return table(spark, sf, "documents").select(
        "doc_id", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hits"))


# Words held by ASCII borders on one side, Unicode on the other: texts outside ASCII differ.
SQL["n33_word_pattern"] = r"""SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '(?i)\b(?:buy now|the|of|and)\b')) AS hits FROM documents"""


@add("n34_secure_image", S.with_("listings") + f"""SELECT {ID}, CASE WHEN MAIN_IMAGE LIKE 'http://%' THEN replace(MAIN_IMAGE, 'http://', 'https://')
 WHEN MAIN_IMAGE LIKE 'http%' THEN MAIN_IMAGE ELSE 'none.png' END AS image FROM listings""")
def n34(spark, sf):
    return listings(spark, sf).select("PRODUCT_SET_SID", "l_partkey",
                                      urls.secure_image(F.col("MAIN_IMAGE"), "none.png").alias("image"))


_VAR = "concat(CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', ', ') WHEN 1 THEN p_name ELSE concat('Red', upper(substring(p_type, 1, 2)), CAST(p_size AS string)) END)"


@add("n35_variant_tokens", f"""WITH x AS (SELECT p_partkey, p_size, {_VAR} AS v FROM part)
SELECT p_partkey, CASE WHEN contains(v, ',') THEN replace(v, ', ', '|') WHEN contains(v, ' ') THEN replace(v, ' ', '|')
 ELSE concat('Red|', upper(substring(v, 4, 2)), '|', p_size) END AS tokens,
 CASE WHEN contains(v, ',') OR contains(v, ' ') THEN 0 ELSE 1 + CASE WHEN upper(substring(v, 4, 2)) IN ('XS', 'XL') THEN 1 ELSE 0 END END AS sizes FROM x""")
def n35(spark, sf):
    x = spark.sql(f"SELECT p_partkey, {_VAR} AS v FROM {{part}}", part=table(spark, sf, "part"))
    t = tx.variant_tokens(F.col("v"))
    return x.select("p_partkey", F.array_join(t, "|").alias("tokens"), F.size(F.filter(t, tx.is_size)).alias("sizes"))


# The repeated-character trap: a keyword beside a letter outside ASCII is no hit.
@add("t04_bounded_keyword", r"""SELECT doc_id, regexp_matches(regexp_replace(lower(text), '[^\x00-\x7F]', 'x', 'g'), '(^|[^0-9A-Za-z_])de($|[^0-9A-Za-z_])') AS found FROM documents""")
def t04(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.rlike(F.lower("text"), bounded_word(F.lit("de"))).alias("found"))


__all__ = ["QUERIES", "SQL", "VIEWS", "cte"]
