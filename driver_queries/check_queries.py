"""Preparation, the thirty checks and the verdict family."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import sql as S
from driver_queries.views import MARKET, listings, rule_book, view
from listguard.operators import checks as C
from listguard.operators import ingest, keywords, verdict as V
from listguard.functions import text as tx
from listguard.operators.skew import exploded
from listguard.plans import flows
from listguard.session import stage
from listguard.sources import rules as R

QUERIES, SQL = {}, {}

SLUGS = {
    "Restricted brands": "c02_restricted_brands", "Suspected Fake product": "c03_suspected_fake",
    "Seller Not approved to sell Refurb": "c04_refurb_seller", "Product Warranty": "c05_product_warranty",
    "Seller Approve to sell books": "c06_books_seller", "Seller Approved to Sell Perfume": "c07_perfume_seller",
    "Perfume Tester": "c08_perfume_tester", "Counterfeit Sneakers": "c09_counterfeit_sneakers",
    "Suspected counterfeit Jerseys": "c10_counterfeit_jerseys", "Prohibited products": "c11_prohibited",
    "Unnecessary words in NAME": "c12_unnecessary_words", "Single-word NAME": "c13_single_word_name",
    "Generic BRAND Issues": "c14_generic_brand", "Fashion brand issues": "c15_fashion_brand",
    "BRAND name repeated in NAME": "c16_brand_in_name", "Wrong Variation": "c17_wrong_variation",
    "Generic branded products with genuine brands": "c18_generic_with_real_brand",
    "Missing COLOR": "c19_missing_color", "Missing Weight/Volume": "c20_missing_weight",
    "Incomplete Smartphone Name": "c21_incomplete_smartphone", "Duplicate product": "c22_duplicate_product",
    "NG - Gift Card Seller": "c23_ng_gift_card", "NG - Books Seller": "c24_ng_books",
    "NG - TV Brand Seller": "c25_ng_tv_brand", "NG - HP Toners Seller": "c26_ng_hp_toners",
    "NG - Apple Seller": "c27_ng_apple", "NG - Xmas Tree Seller": "c28_ng_xmas_tree",
    "NG - Rice Brand Seller": "c29_ng_rice", "NG - Powerbank Capacity": "c30_ng_powerbank",
}


def add(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def prepared(spark, sf, code=None, columns=None):
    """Products of the listing view; every country when ``code`` is None."""
    return ingest.prepare(listings(spark, sf), code, MARKET, columns=columns)


def _check(flag):
    country = "NG" if flag.startswith("NG - ") else "KE"
    return lambda spark, sf: C.check(prepared(spark, sf, columns=C.columns_read([flag])), rule_book(spark, sf, country), flag)


for _flag, _slug in SLUGS.items():
    add(_slug, S.check_sql(_flag, "NG" if _flag.startswith("NG - ") else "KE"))(_check(_flag))


@add("c01_simple_category", S.check_sql("Wrong Category"))
def c01(spark, sf):
    return C.check(prepared(spark, sf, columns=C.columns_read(["Wrong Category"])), rule_book(spark, sf, "KE", "category_role"), "Wrong Category")


# The last keyword found is marked in the name: marks around every non-word character keep
# neighbouring hits apart without look-around.
_MARKED = r"concat(chr(1), regexp_replace({x}, '(\W)', concat(chr(1), '\1', chr(1)), 'g'), chr(1))"


@add("c11_highlight", S.with_("d", "prohibited_sheet") + f"""SELECT PRODUCT_SET_SID, replace(regexp_replace({_MARKED.format(x='name_raw')},
  concat('(?i)', chr(1), '(', regexp_replace(kw, '(\\W)', concat(chr(1), '\\1', chr(1)), 'g'), ')', chr(1)), concat(chr(1), '[!]\\1[!]', chr(1)), 'g'), chr(1), '') AS highlighted
FROM (SELECT d.PRODUCT_SET_SID, any_value(name_raw) AS name_raw, arg_max(kw, (p._pos, kw)) AS kw
  FROM d JOIN (SELECT *, lower(trim(keyword)) AS kw FROM prohibited_sheet) p ON p.country = 'KE'
   AND (p.categories = '' OR list_contains(string_split(p.categories, ','), d.code)) AND regexp_matches(lower(name_raw), {S.bounded("kw")})
  GROUP BY 1)""")
def c11_highlight(spark, sf):
    rules = rule_book(spark, sf, "KE", "prohibited").for_country("prohibited")
    return keywords.prohibited_hits(prepared(spark, sf, columns=["PRODUCT_SET_SID", "NAME", "CATEGORY_CODE"]), rules).select("PRODUCT_SET_SID", "highlighted")


@add("c12_highlight", S.with_("d") + f"""SELECT PRODUCT_SET_SID,
  regexp_replace(NAME, '(?i)(\\bbuy now\\b|\\bbest\\b|\\bnew\\b)', '[*]\\1[*]', 'g') AS NAME FROM d
  WHERE regexp_matches(name_l, {S.WORD_UNN})""")
def c12_highlight(spark, sf):
    return C.highlighted_words(prepared(spark, sf, columns=["PRODUCT_SET_SID", "NAME"]), rule_book(spark, sf, "KE", "word_list"))


@add("f03_miscellaneous", S.with_("listings") + f"""SELECT PRODUCT_SET_SID, CATEGORY, l_partkey FROM listings
WHERE contains(lower({S.txt('CATEGORY')}), 'miscellaneous')""")
def f03(spark, sf):
    return C.contains_miscellaneous(listings(spark, sf)).select("PRODUCT_SET_SID", "CATEGORY", "l_partkey")


# ---- preparation ---------------------------------------------------------------------------

@add("f01_country_filter", S.with_("listings") + f"""SELECT PRODUCT_SET_SID, l_partkey, {S.country()} AS ACTIVE_STATUS_COUNTRY,
  {S.country()} IN ('MULTIPLE', 'MULTI') AS multi FROM listings WHERE {S.country()} IN ('NG', 'MULTIPLE', 'MULTI')""")
def f01(spark, sf):
    out = ingest.filter_country(listings(spark, sf), "NG", MARKET)
    return out.select("PRODUCT_SET_SID", "l_partkey", "ACTIVE_STATUS_COUNTRY", F.col("_IS_MULTI_COUNTRY").alias("multi"))


@add("f01_detected_countries", S.with_("listings") + f"""SELECT DISTINCT CASE {S.country()} WHEN 'KE' THEN 'Kenya'
  WHEN 'UG' THEN 'Uganda' WHEN 'NG' THEN 'Nigeria' WHEN 'GH' THEN 'Ghana' WHEN 'MA' THEN 'Morocco'
  ELSE concat('''', {S.country()}, '''') END AS country FROM listings""")
def f01_detected(spark, sf):
    return ingest.detected_countries(listings(spark, sf), MARKET)


_SPREAD = ", ".join(ingest.SPREAD_COLUMNS)


@add("f02_propagate_metadata", S.with_("filled") + f"SELECT PRODUCT_SET_SID, l_partkey, l_suppkey, {_SPREAD} FROM filled")
def f02(spark, sf):
    df = view(spark, sf, "listings").withColumn("_pos", F.struct(*[F.col(c) for c in S.ORDER.split(", ")]))
    # Inside a product the order is by part, so the part number is a coarse position.
    return ingest.propagate_metadata(df, block="l_partkey").select(
        "PRODUCT_SET_SID", "l_partkey", "l_suppkey", *ingest.SPREAD_COLUMNS)


@add("f04_variation_count", S.with_("prepared") + "SELECT PRODUCT_SET_SID, COUNT_VARIATIONS FROM prepared")
def f04(spark, sf):
    return prepared(spark, sf, columns=["PRODUCT_SET_SID", "COUNT_VARIATIONS"])


@add("f05_first_row", S.with_("pos") + """SELECT PRODUCT_SET_SID, l_partkey, SELLER_NAME FROM pos
QUALIFY row_number() OVER (PARTITION BY PRODUCT_SET_SID ORDER BY _pos) = 1""")
def f05(spark, sf):
    return ingest.first_rows(listings(spark, sf)).select("PRODUCT_SET_SID", "l_partkey", "SELLER_NAME")


@add("f06_common_products", S.with_("listings") + """SELECT PRODUCT_SET_SID FROM listings GROUP BY 1
HAVING count(DISTINCT _file) = (SELECT count(DISTINCT _file) FROM listings)""")
def f06(spark, sf):
    return ingest.common_products(listings(spark, sf))


@add("f06_common_count", S.with_("listings") + """SELECT count(*) AS common FROM (SELECT PRODUCT_SET_SID FROM listings GROUP BY 1
HAVING count(DISTINCT _file) = (SELECT count(DISTINCT _file) FROM listings))""")
def f06_count(spark, sf):
    return ingest.common_products(listings(spark, sf)).agg(F.count("*").alias("common"))


_DK = ", '\x01', ".join(S.low(x) for x in ("NAME", "BRAND", "SELLER_NAME", "COLOR"))


@add("f07_duplicate_groups", S.with_("d") + f"SELECT concat({_DK}) AS dup_key, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1")
def f07(spark, sf):
    return V.duplicate_groups(prepared(spark, sf, columns=["PRODUCT_SET_SID", "NAME", "BRAND", "SELLER_NAME", "COLOR"]))


def found_rows(checked):
    """(sid, ord) of every flag found."""
    return exploded(checked.select(F.col("PRODUCT_SET_SID").alias("sid"), "_found"), "_found").select("sid", "x.ord")


@add("f08_flagged_rows", S.verdict_parts("KE", "d") + "SELECT DISTINCT sid, ord FROM own")
def f08(spark, sf):
    out = C.run_checks(stage(prepared(spark, sf, columns=C.columns_read()), "prepared"), rule_book(spark, sf))
    return found_rows(out)


@add("f09_approved", S.verdict_parts("KE", "d") + "SELECT PRODUCT_SET_SID FROM d WHERE PRODUCT_SET_SID NOT IN (SELECT sid FROM own)")
def f09(spark, sf):
    out = C.run_checks(stage(prepared(spark, sf, columns=C.columns_read()), "prepared"), rule_book(spark, sf))
    out = stage(out.select("PRODUCT_SET_SID", "_mask"), "checked")
    return V.approved(out, out.where("_mask <> 0")).select("PRODUCT_SET_SID")


_SKIP = ("Counterfeit Sneakers", "Product Warranty", "Generic BRAND Issues")


@add("f10_country_skips", S.verdict_parts("KE", "d", _SKIP) + "SELECT DISTINCT sid, ord FROM own WHERE ord NOT IN (2, 3, 4, 6, 7, 10, 11)")
def f10(spark, sf):
    # Uganda leaves out three checks; without rules of its own only shared checks remain.
    out = C.run_checks(stage(prepared(spark, sf, columns=C.columns_read()), "prepared"), rule_book(spark, sf, "UG"))
    rows = found_rows(out)
    return rows.where(~F.col("ord").isin(2, 3, 4, 6, 7, 10, 11))


@add("f10_skip_table", S.verdict_parts("KE", "d", _SKIP) + "SELECT DISTINCT sid, ord FROM own")
def f10_table(spark, sf):
    """All flags but those that the country's rows of the skip table, repeated and foreign ones among them, leave out."""
    skips = spark.createDataFrame([("NG", "Missing COLOR"), *[("KE", f) for f in _SKIP for _ in range(40)], ("KE", "no flag")],
                                  "country string, flag string")
    rules = rule_book(spark, sf)
    rules = R.RuleBook(spark, {**rules.tables, "country_skip": skips}, MARKET, "KE")
    out = C.run_checks(stage(prepared(spark, sf, columns=C.columns_read()), "prepared"), rules)
    return found_rows(out)


# ---- verdicts ------------------------------------------------------------------------------

def flagged(spark, sf, code):
    return flows.flagged_listings(listings(spark, sf), rule_book(spark, sf, code))


@add("v01_duplicate_expansion", S.verdict_parts("KE", "d_ke") + """SELECT DISTINCT k2.sid, o.ord FROM own o JOIN keys k1 ON o.sid = k1.sid
JOIN keys k2 ON k1.dk = k2.dk WHERE (k2.sid, o.ord) NOT IN (SELECT (sid, ord) FROM own)""")
def v01(spark, sf):
    checked = flows.listing_tables(listings(spark, sf), rule_book(spark, sf))[1]
    extra = F.col("_dm").bitwiseAND(F.bitwise_not(F.col("_mask")))
    out = V.duplicate_mask(checked).where("_dm IS NOT NULL")
    return out.select(F.col("PRODUCT_SET_SID").alias("sid"), F.explode(V.flags_of(extra)).alias("ord"))


@add("v02_match_key_expansion", S.verdict_parts("KE", "d_ke") + """SELECT DISTINCT k2.sid, o.ord FROM own o JOIN keys k1 ON o.sid = k1.sid
JOIN keys k2 ON k1.mk = k2.mk WHERE o.ord IN (2, 4, 6, 7, 9)""")
def v02(spark, sf):
    checked = flows.listing_tables(listings(spark, sf), rule_book(spark, sf))[1]
    out = V.shared_mask(checked).where("_mm IS NOT NULL")
    return out.select(F.col("PRODUCT_SET_SID").alias("sid"), F.explode(V.flags_of(F.col("_mm"))).alias("ord"))


@add("v03_first_flag", S.verdict_parts("KE", "d_ke") + 'SELECT "ProductSetSid", "FLAG" FROM verdict WHERE "Status" = \'Rejected\'')
def v03(spark, sf):
    return flows.validate(listings(spark, sf), rule_book(spark, sf)).where("Status = 'Rejected'").select("ProductSetSid", "FLAG")


@add("v04_verdict_kenya", S.verdict_parts("KE", "d_ke") + "SELECT * FROM verdict")
def v04(spark, sf):
    return flows.validate(listings(spark, sf), rule_book(spark, sf))


@add("v04_verdict_nigeria", S.verdict_parts("NG", "d_ng") + "SELECT * FROM verdict")
def v04_ng(spark, sf):
    return flows.validate(listings(spark, sf), rule_book(spark, sf, "NG"))


@add("v05_approved_rows", S.verdict_parts("KE", "d_ke") + "SELECT * FROM verdict WHERE \"Status\" = 'Approved'")
def v05(spark, sf):
    return flows.validate(listings(spark, sf), rule_book(spark, sf)).where("Status = 'Approved'")


@add("v06_full_merge", S.verdict_parts("KE", "d_ke") + """SELECT d.PRODUCT_SET_SID, d.NAME, d.BRAND, d.GLOBAL_PRICE, v."Status", v."Reason", v."FLAG", v."SellerName"
FROM d LEFT JOIN verdict v ON v."ProductSetSid" = d.PRODUCT_SET_SID""")
def v06(spark, sf):
    rules = rule_book(spark, sf)
    rows, flagged_rows = flows.listing_tables(listings(spark, sf), rules)
    return V.merge_full(rows.drop("SELLER_NAME"), V.verdict(V.expand(flagged_rows), rules)).select(
        "PRODUCT_SET_SID", "NAME", "BRAND", "GLOBAL_PRICE", "Status", "Reason", "FLAG", "SellerName")


DECISIONS = """SELECT concat(CAST(o_orderkey AS string), '-1') AS sid,
  CASE WHEN o_custkey % 3 = 0 THEN 'restore' ELSE 'reject' END AS action,
  CASE o_custkey % 4 WHEN 0 THEN 'REJECT_POOR_IMAGE' WHEN 1 THEN 'REJECT_COLOR' WHEN 2 THEN 'NO_SUCH' ELSE 'OTHER_CUSTOM' END AS reason_key,
  CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority END AS comment, CAST(o_orderdate AS timestamp) AS ts
FROM {orders}"""


def decisions(spark, sf):
    from driver_queries.views import table
    return spark.sql(DECISIONS, orders=table(spark, sf, "orders"))


@add("v07_v08_decisions", S.verdict_parts("KE", "d_ke") + f""", dec AS ({DECISIONS.format(orders='orders')}),
named AS (SELECT *, CASE reason_key WHEN 'REJECT_POOR_IMAGE' THEN 'Poor images' WHEN 'REJECT_COLOR' THEN 'Missing COLOR' ELSE 'Other Reason (Custom)' END AS nf FROM dec)
SELECT v."ProductSetSid", v."ParentSKU", CASE action WHEN 'reject' THEN 'Rejected' WHEN 'restore' THEN 'Approved' ELSE v."Status" END AS "Status",
 CASE action WHEN 'reject' THEN coalesce(m.reason, '1000007 - Other Reason') WHEN 'restore' THEN '' ELSE v."Reason" END AS "Reason",
 CASE action WHEN 'reject' THEN coalesce(n.comment, m.comment, 'Manual rejection') WHEN 'restore' THEN '' ELSE v."Comment" END AS "Comment",
 CASE action WHEN 'reject' THEN nf WHEN 'restore' THEN 'Approved by User' ELSE v."FLAG" END AS "FLAG", v."SellerName"
FROM verdict v LEFT JOIN named n ON n.sid = v."ProductSetSid" LEFT JOIN {S.flag_values()} m ON m.flag = n.nf""")
def v07(spark, sf):
    rules = rule_book(spark, sf)
    return V.apply_decisions(flows.validate(listings(spark, sf), rules), decisions(spark, sf), rules)


_V09 = S.verdict_parts("KE", "d_ke") + """, nextflag AS (SELECT f.sid, (SELECT min(s.ord) FROM shared s WHERE s.sid = f.sid AND s.ord <> 16) AS ord
 FROM final f WHERE f.ord = 16) """


@add("v09_bulk_approve", _V09 + f"""SELECT n.sid AS "ProductSetSid", CASE WHEN n.ord IS NULL THEN 'Approved' ELSE 'Rejected' END AS "Status",
 coalesce(m.flag, 'Approved by User') AS "FLAG" FROM nextflag n LEFT JOIN {S.flag_values()} m ON m.ord = n.ord""")
def v09(spark, sf):
    out = V.bulk_approve(flagged(spark, sf, "KE"), rule_book(spark, sf), "BRAND name repeated in NAME")
    return out.select("ProductSetSid", "Status", "FLAG")


@add("v09_bulk_approve_counts", _V09 + f"""SELECT coalesce(m.flag, 'Approved by User') AS "FLAG", count(*) AS n
 FROM nextflag x LEFT JOIN {S.flag_values()} m ON m.ord = x.ord GROUP BY 1""")
def v09_counts(spark, sf):
    return V.bulk_approve_counts(V.bulk_approve(flagged(spark, sf, "KE"), rule_book(spark, sf), "BRAND name repeated in NAME"))


# The user approves the flag for every second product only.
@add("v09_bulk_approve_ids", _V09 + f"""SELECT n.sid AS "ProductSetSid", CASE WHEN n.ord IS NULL THEN 'Approved' ELSE 'Rejected' END AS "Status",
 coalesce(m.flag, 'Approved by User') AS "FLAG" FROM nextflag n LEFT JOIN {S.flag_values()} m ON m.ord = n.ord
 WHERE n.sid IN (SELECT concat(l_orderkey, '-', l_linenumber) FROM lineitem WHERE l_orderkey % 4 < 2)""")
def v09_ids(spark, sf):
    from driver_queries.views import table
    ids = spark.sql("SELECT concat(CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string)) AS PRODUCT_SET_SID FROM {lineitem} "
                    "WHERE l_orderkey % 4 < 2", lineitem=table(spark, sf, "lineitem"))
    out = V.bulk_approve(flagged(spark, sf, "KE"), rule_book(spark, sf), "BRAND name repeated in NAME", ids)
    return out.select("ProductSetSid", "Status", "FLAG")


_PAYLOAD = """SELECT concat('{{"action":"', CASE o_custkey % 3 WHEN 0 THEN 'undo' WHEN 1 THEN 'reject' ELSE 'restore' END, '","payload":{{"',
 CAST(o_orderkey AS string), '-1":"', o_orderpriority, '","', CAST(o_orderkey AS string), '-2":"REJECT_COLOR"}}}}') AS payload,
 CAST(o_orderdate AS timestamp) AS ts FROM {orders}"""


@add("v08_payload_decisions", """SELECT concat(o_orderkey, '-', n) AS sid, CASE o_custkey % 3 WHEN 1 THEN 'reject' ELSE 'restore' END AS action,
 CASE n WHEN 1 THEN o_orderpriority ELSE 'REJECT_COLOR' END AS reason_key, CAST(NULL AS varchar) AS comment, CAST(o_orderdate AS timestamp) AS ts
FROM orders, (VALUES (1), (2)) v(n)""")
def v08_payload(spark, sf):
    from driver_queries.views import table
    return V.decisions_from_payload(spark.sql(_PAYLOAD, orders=table(spark, sf, "orders")))


@add("v10_audit_export", S.verdict_parts("KE", "d_ke") + """SELECT d.PRODUCT_SET_SID, d.NAME, CASE WHEN coalesce(v."Status", 'Approved') = 'Approved' THEN 'ok' ELSE v."FLAG" END AS "FINAL_FLAG",
 CASE WHEN coalesce(v."Status", 'Approved') = 'Approved' THEN 'ok' ELSE v."Comment" END AS "FLAG_REASON"
FROM d LEFT JOIN verdict v ON v."ProductSetSid" = d.PRODUCT_SET_SID""")
def v10(spark, sf):
    rules = rule_book(spark, sf)
    rows, flagged_rows = flows.listing_tables(listings(spark, sf), rules)
    return V.audit_export(rows.select("PRODUCT_SET_SID", "NAME"), V.verdict(V.expand(flagged_rows), rules))


# ---- validation KPIs -----------------------------------------------------------------------
from listguard.operators import analytics as A  # noqa: E402


@add("a16_validation_kpis", S.verdict_parts("NG", "d_ng") + """SELECT count(*) AS total, count(*) FILTER ("Status" = 'Approved') AS approved,
 count(*) FILTER ("Status" = 'Rejected') AS rejected, count(*) FILTER ("Status" = 'Rejected') / count(*) * 100 AS rejection_rate,
 (SELECT count(*) FROM d WHERE """ + S.country() + """ IN ('MULTIPLE', 'MULTI')) AS multi_country FROM verdict""")
def a16(spark, sf):
    rules = rule_book(spark, sf, "NG")
    rows, flagged_rows = flows.listing_tables(listings(spark, sf), rules)
    return A.validation_kpis(V.verdict(V.expand(flagged_rows), rules), rows)


@add("a17_flag_counts", S.verdict_parts("KE", "d_ke") + """SELECT "FLAG", count(*) AS n FROM verdict WHERE "Status" = 'Rejected' GROUP BY 1""")
def a17(spark, sf):
    return A.flag_counts(flows.validate(listings(spark, sf), rule_book(spark, sf)))


@add("a17_top_flag", S.verdict_parts("KE", "d_ke") + """SELECT "FLAG", count(*) AS n FROM verdict WHERE "Status" = 'Rejected' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""")
def a17_top(spark, sf):
    return A.top_flag(flows.validate(listings(spark, sf), rule_book(spark, sf)))


@add("a18_seller_summary", S.verdict_parts("KE", "d_ke") + """SELECT CAST(row_number() OVER (ORDER BY "Rejected" DESC, SELLER_NAME) AS integer) AS "Rank", * FROM (
 SELECT "SellerName" AS SELLER_NAME, count(*) FILTER ("Status" = 'Rejected') AS "Rejected", count(*) FILTER ("Status" = 'Approved') AS "Approved"
 FROM verdict GROUP BY 1)""")
def a18(spark, sf):
    return A.seller_summary(flows.validate(listings(spark, sf), rule_book(spark, sf)))


# ---- rule loaders --------------------------------------------------------------------------

@add("s11_prohibited_rules", S.with_("prohibited_sheet") + """SELECT country, CAST(_pos AS integer) AS rule_order, lower(trim(keyword)) AS keyword,
 CASE WHEN categories = '' THEN '' ELSE categories END AS categories FROM prohibited_sheet""")
def s11(spark, sf):
    return R.prohibited_rules(view(spark, sf, "prohibited_sheet")).withColumn("categories", F.array_join("categories", ","))


@add("s12_restricted_brands", S.with_("brand_sheet") + """SELECT country, CAST(_pos AS integer) AS rule_order, lower(trim(brand)) AS brand, trim(brand) AS brand_raw,
 CASE WHEN approved_sellers = '' THEN '' ELSE array_to_string(list_sort(string_split(lower(approved_sellers), ', ')), ',') END AS sellers,
 coalesce(replace(categories, '.0', ''), '') AS categories,
 coalesce(array_to_string(list_sort(string_split(lower(variations), ', ')), ','), '') AS variations FROM brand_sheet""")
def s12(spark, sf):
    out = R.restricted_brands(view(spark, sf, "brand_sheet"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("sellers", "categories", "variations")})


_SHEET = "SELECT 'KE' AS country, concat(' ', s_name) AS seller_name, CASE WHEN s_suppkey % 4 = 0 THEN 'Seller' ELSE upper(s_name) END AS phones FROM {supplier}"


@add("s13_s16_seller_sheets", f"""WITH x AS ({_SHEET.format(supplier='supplier')})
SELECT DISTINCT 'book' AS kind, country, lower(trim(seller_name)) AS seller FROM x
UNION SELECT DISTINCT 'phone', country, lower(phones) FROM x WHERE phones <> 'Seller'""")
def s13(spark, sf):
    from driver_queries.views import table
    sheet = spark.sql(_SHEET, supplier=table(spark, sf, "supplier"))
    return R.seller_sheet(sheet, "book", "seller_name").unionByName(R.seller_sheet(sheet, "phone", "phones"))


_KEYS = "SELECT concat(upper(split_part(p_name, ' ', 1)), ' ') AS word, concat(CAST(1000000 + p_size AS string), '.0') AS cat FROM {part}"


@add("s13_s16_keyword_and_category_sheets", f"""WITH x AS ({_KEYS.format(part='part')})
SELECT DISTINCT 'keyword' AS what, lower(trim(word)) AS value FROM x UNION SELECT DISTINCT 'category', split_part(cat, '.', 1) FROM x""")
def s14(spark, sf):
    from driver_queries.views import table
    sheet = spark.sql(_KEYS, part=table(spark, sf, "part"))
    words = R.keyword_sheet(sheet, "perfume", "word").select(F.lit("keyword").alias("what"), F.col("keyword").alias("value"))
    return words.unionByName(R.category_sheet(sheet, "perfume", "cat").select(F.lit("category").alias("what"), F.col("code").alias("value")))


# A wide sheet: one column per size class, price in the first row, codes below.
_WIDE = """SELECT p_partkey AS _pos, CASE WHEN p_partkey = 0 THEN '500' ELSE CASE WHEN p_size % 2 = 0 THEN concat(CAST(1000000 + p_size AS string), '.0') END END AS `Acme `,
 CASE WHEN p_partkey = 0 THEN '700.5' ELSE CAST(1000000 + p_size AS string) END AS acme, CASE WHEN p_partkey = 0 THEN 'n/a' ELSE '1' END AS Nil,
 CASE WHEN p_partkey = 0 THEN '90' ELSE CASE WHEN p_size % 5 = 0 THEN CAST(1000000 + p_size AS string) ELSE '' END END AS Zed FROM {part}"""


@add("s17_price_floors", """WITH w AS (SELECT DISTINCT p_size FROM part WHERE p_partkey > 0)
SELECT 'KE' AS country, 'acme' AS brand, CAST(1000000 + p_size AS varchar) AS category_code, 700.5 :: double AS threshold FROM w
UNION ALL SELECT 'KE', 'zed', CAST(1000000 + p_size AS varchar), 90.0 FROM w WHERE p_size % 5 = 0""")
def s17(spark, sf):
    from driver_queries.views import table
    return R.price_floors(spark.sql(_WIDE.replace("`Acme `", "`Acme `"), part=table(spark, sf, "part")), "KE")


@add("s18_nigeria_books", S.with_("book_sheet") + """SELECT CAST(min(_pos) AS integer) AS rule_order, lower(title) AS title, lower(min(seller)) AS seller
FROM book_sheet GROUP BY lower(title)""")
def s18_books(spark, sf):
    return R.nigeria_books(view(spark, sf, "book_sheet"))


@add("s18_nigeria_rice", S.with_("rice_sheet") + """SELECT lower(trim(brand)) AS brand,
 CASE WHEN max(sellers) = '' THEN '' ELSE 'supplier#000000001,supplier#000000002' END AS sellers,
 coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), ','), '') AS categories FROM rice_sheet GROUP BY 1""")
def s18_rice(spark, sf):
    out = R.nigeria_rice(view(spark, sf, "rice_sheet"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("sellers", "categories")})


_TV = """SELECT CAST(1000000 + p_size AS string) AS Category, CASE WHEN p_size % 2 = 0 THEN concat('S', CAST(p_size AS string)) END AS Sony,
 CASE WHEN p_size % 3 = 0 THEN 'LG' ELSE concat(' s', CAST(p_size AS string)) END AS LG FROM {part}"""


@add("s18_nigeria_tvs", f"""WITH x AS ({_TV.format(part='part')}) SELECT DISTINCT 'sony' AS brand, lower(trim(Sony)) AS seller FROM x WHERE Sony IS NOT NULL
UNION SELECT DISTINCT 'lg', lower(trim(LG)) FROM x WHERE LG <> 'LG'""")
def s18_tvs(spark, sf):
    from driver_queries.views import table
    return R.nigeria_tvs(spark.sql(_TV, part=table(spark, sf, "part")), "Category")[0]


_REASONS = "SELECT DISTINCT concat(' ', p_type) AS Flag, p_type AS Reason, lower(p_type) AS Comment, CASE WHEN p_type LIKE 'S%' THEN 'fr' ELSE '' END AS French FROM {part}"


@add("s19_flag_map", f"""WITH x AS ({_REASONS.format(part='part')}) SELECT trim(Flag) AS flag, Reason AS reason, Comment AS comment_en,
 CASE WHEN French = '' THEN Comment ELSE French END AS comment_fr, Comment AS comment_ar FROM x
UNION ALL SELECT flag, reason, comment, comment, comment FROM {S.flag_values()} WHERE flag LIKE 'NG - %'""")
def s19(spark, sf):
    from driver_queries.views import table
    custom = spark.sql(_REASONS, part=table(spark, sf, "part"))
    return R.flag_dimension(spark, MARKET, custom)
