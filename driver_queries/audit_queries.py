"""Audit of published listings: codes, repair, advisory flags, checks, enrichment, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import sql as S
from driver_queries.views import MARKET, listings, rule_book, table, view
from listguard.operators import analytics, audit, checks as C, ingest, report, review
from listguard.plans import flows
from listguard.session import stage
from listguard.sources import rules as R

QUERIES, SQL = {}, {}


def add(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def published(spark, sf):
    return listings(spark, sf, "published")


ID = "PRODUCT_SET_SID, l_partkey"
KEY = ["PRODUCT_SET_SID", "l_partkey"]
n = S.num
OP, SP = f"({n('GLOBAL_PRICE')})", f"({n('GLOBAL_SALE_PRICE')})"
PUB = S.with_("pub")

# ---- category maps and codes ---------------------------------------------------------------

BYNAME = """byname AS (SELECT lower(name) AS key, arg_max(code, _pos) AS code FROM category_sheet GROUP BY 1),
bynameseg AS (SELECT key, coalesce(max(code) FILTER (src = 0), max(code) FILTER (src = 1)) AS code FROM (SELECT key, code, 0 AS src FROM byname
 UNION ALL SELECT lower(trim(string_split(path, '/')[-1])), arg_min(code, _pos), 1 FROM category_sheet GROUP BY 1) GROUP BY 1)"""


@add("s08_category_codes_by_name", S.with_("category_sheet") + f", {BYNAME} SELECT key, code FROM bynameseg")
def s08(spark, sf):
    return R.category_codes_by_name(view(spark, sf, "category_sheet"))


@add("s09_paths_to_codes", S.with_("category_sheet") + "SELECT lower(path) AS path, arg_max(code, _pos) AS code FROM category_sheet GROUP BY 1")
def s09(spark, sf):
    return R.paths_to_codes(view(spark, sf, "category_sheet")).select("path", "code")


@add("s09_codes_to_paths", S.with_("category_sheet") + "SELECT code, lower(arg_max(path, _pos)) AS path FROM category_sheet GROUP BY 1")
def s09_back(spark, sf):
    return R.codes_to_paths(view(spark, sf, "category_sheet"))


_SEGS = r"list_filter(list_transform(string_split_regex(CATEGORY, '{p}'), lambda s: trim(s)), lambda s: s <> '')"


@add("n16_resolve_by_name", S.with_("pub", "category_sheet") + f""", {BYNAME},
cats AS (SELECT DISTINCT CATEGORY FROM pub), segs AS (SELECT CATEGORY, unnest({_SEGS.replace('{p}', '[>/]')}) AS seg, generate_subscripts({_SEGS.replace('{p}', '[>/]')}, 1) AS i FROM cats),
hit AS (SELECT CATEGORY, arg_max(code, i) AS code FROM segs JOIN bynameseg ON lower(seg) = key GROUP BY 1)
SELECT {ID}, coalesce(hit.code, regexp_replace(lower({_SEGS.replace('{p}', '[>/]').replace('CATEGORY', 'pub.CATEGORY')}[-1]), '[^a-z0-9]', '_', 'g')) AS CATEGORY_CODE FROM pub LEFT JOIN hit USING (CATEGORY)""")
def n16(spark, sf):
    codes = R.category_codes_by_name(view(spark, sf, "category_sheet"))
    return audit.resolve_by_name(published(spark, sf), codes).select(*KEY, "CATEGORY_CODE")


_NK = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
_PK = r"lower(regexp_replace(trim({x}), '\s*[>/|\\]\s*', ' / ', 'g'))"
N17 = S.with_("pub", "category_sheet") + f""", bypath AS (SELECT {_PK.format(x='path')} AS key, arg_max(code, _pos) AS code FROM category_sheet GROUP BY 1),
byname AS (SELECT lower(name) AS key, arg_max(code, _pos) AS code FROM category_sheet GROUP BY 1),
parts AS (SELECT lower(trim(p)) AS key, code, _pos, i FROM (SELECT code, _pos, unnest(list_prepend(name, string_split(path, ' / '))) AS p, generate_subscripts(list_prepend(name, string_split(path, ' / ')), 1) AS i FROM category_sheet)),
bypart AS (SELECT key, arg_min(code, (_pos, i)) AS code, min((_pos, i)) AS first FROM parts GROUP BY 1),
kn AS (SELECT {_NK.format(x='key')} AS kn, key, code, first FROM bypart WHERE length({_NK.format(x='key')}) >= 3),
cats AS (SELECT DISTINCT CATEGORY FROM pub),
segs AS (SELECT CATEGORY, unnest({_SEGS.replace('{p}', '[>/|]')}) AS seg, generate_subscripts({_SEGS.replace('{p}', '[>/|]')}, 1) AS i FROM cats),
c2 AS (SELECT CATEGORY, arg_max(code, i) AS code FROM segs JOIN byname ON lower(seg) = key GROUP BY 1),
c3 AS (SELECT CATEGORY, arg_max(code, i) AS code FROM (SELECT CATEGORY, i, code, row_number() OVER (PARTITION BY CATEGORY, i ORDER BY length(kn) DESC, length(key) DESC, first) AS rn
  FROM segs JOIN kn ON {_NK.format(x='seg')} <> '' AND (contains({_NK.format(x='seg')}, kn) OR contains(kn, {_NK.format(x='seg')}))) WHERE rn = 1 GROUP BY 1),
res AS (SELECT {ID}, pub.CATEGORY, coalesce(bypath.code, c2.code, c3.code, {S.strip('CATEGORY_CODE')}) AS CATEGORY_CODE FROM pub
 LEFT JOIN bypath ON bypath.key = {_PK.format(x='pub.CATEGORY')} LEFT JOIN c2 ON c2.CATEGORY = pub.CATEGORY LEFT JOIN c3 ON c3.CATEGORY = pub.CATEGORY) """


@add("n17_resolve_category", N17 + f"SELECT {ID}, CATEGORY_CODE FROM res")
def n17(spark, sf):
    return audit.resolve_category(published(spark, sf), view(spark, sf, "category_sheet")).select(*KEY, "CATEGORY_CODE")


@add("n18_unresolved_categories", PUB + r"SELECT DISTINCT CATEGORY FROM pub WHERE NOT regexp_matches(CATEGORY_CODE, '^\d+$') ORDER BY 1 LIMIT 10")
def n18(spark, sf):
    return audit.unresolved_categories(published(spark, sf))


@add("a21_resolved_codes", PUB + r"SELECT count(*) FILTER (regexp_matches(CATEGORY_CODE, '^\d+$')) AS resolved FROM pub")
def a21(spark, sf):
    return analytics.resolved_codes(published(spark, sf))


# ---- column repair -------------------------------------------------------------------------

@add("n19_price_text", r"""SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN CAST(o_totalprice AS varchar) ELSE '' END AS price FROM orders""")
def n19(spark, sf):
    from listguard.functions.prices import price_text
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", price_text(F.concat(F.lit("KSh "), F.col("o_totalprice").cast("string"))).alias("price"))


@add("n20_price_fallbacks", PUB + f"SELECT {ID}, GLOBAL_PRICE, CASE WHEN ({n('GLOBAL_PRICE')}) > 0 THEN GLOBAL_PRICE ELSE '' END AS GLOBAL_SALE_PRICE FROM pub")
def n20(spark, sf):
    p = published(spark, sf).drop("GLOBAL_SALE_PRICE")
    return audit.price_fallbacks(p, audit.blank_columns(p, ["GLOBAL_PRICE"])).select(*KEY, "GLOBAL_PRICE", "GLOBAL_SALE_PRICE")


@add("n21_list_variations", PUB + f"""SELECT {ID}, CASE WHEN {S.blank('COLOR')} AND {S.blank('SIZES_AVAILABLE')} THEN NULL WHEN {S.blank('COLOR')} THEN trim(SIZES_AVAILABLE)
 WHEN {S.blank('SIZES_AVAILABLE')} THEN trim(COLOR) ELSE concat(trim(COLOR), ' | ', trim(SIZES_AVAILABLE)) END AS LIST_VARIATIONS FROM pub""")
def n21(spark, sf):
    p = published(spark, sf)
    return audit.build_variations(p, audit.blank_columns(p, ["LIST_VARIATIONS"])).select(*KEY, "LIST_VARIATIONS")


DISC = f"""CASE WHEN {S.blank('DISCOUNT')} THEN CASE WHEN {OP} > 0 AND {SP} < {OP} THEN concat(CAST(CAST(round_even(({OP} - {SP}) / {OP} * 100, 0) AS integer) AS varchar), '%')
 ELSE coalesce(DISCOUNT, '') END ELSE DISCOUNT END"""


@add("n22_fill_discount", PUB + f"SELECT {ID}, {DISC} AS DISCOUNT FROM pub")
def n22(spark, sf):
    return audit.fill_discount(published(spark, sf)).select(*KEY, "DISCOUNT")


@add("n23_official_store", PUB + f"SELECT {ID}, CASE WHEN contains(upper(coalesce(TAGS, '')), 'OFFI') THEN 'Yes' ELSE 'No' END AS IS_OFFICIAL_STORE FROM pub")
def n23(spark, sf):
    p = published(spark, sf)
    return audit.official_store(p, audit.blank_columns(p, ["IS_OFFICIAL_STORE"]), MARKET).select(*KEY, "IS_OFFICIAL_STORE")


@add("n24_color_from_title", PUB + f"SELECT {ID}, CASE WHEN COLOR_IN_TITLE IS NULL OR COLOR_IN_TITLE = 'None' THEN 'None' ELSE COLOR_IN_TITLE END AS COLOR FROM pub")
def n24(spark, sf):
    return audit.color_from_title(published(spark, sf)).select(*KEY, "COLOR")


@add("n25_category_from_path", PUB + f"SELECT {ID}, CASE WHEN DISCOUNT = '' THEN CATEGORY ELSE DISCOUNT END AS CATEGORY FROM pub")
def n25(spark, sf):
    p = published(spark, sf).withColumn("CATEGORY_PATH", F.col("CATEGORY")).withColumn("CATEGORY", F.col("DISCOUNT"))
    return audit.category_from_path(p).select(*KEY, "CATEGORY")


# ---- audit checks and advisory flags -------------------------------------------------------

def _audit_check(flag):
    def run(spark, sf):
        rows = published(spark, sf)
        out = C.run_checks(rows, rule_book(spark, sf, "KE", "category_role"), [flag], published=True)
        return out.where("_mask <> 0").select(*KEY, "SELLER_NAME")
    return run


_FAS = f"({S.code('CATEGORY_CODE')} IN (SELECT code FROM category_role WHERE role = 'fashion'))"
_FW = r"regexp_matches(CATEGORY, '(?i)\bfashion\b')"
_ROLE = S.with_("pub", "category_role")
add("c31_audit_fashion_brand", _ROLE + f"SELECT {ID}, SELLER_NAME FROM pub WHERE {S.low('BRAND')} = 'fashion' AND NOT {_FAS} AND NOT {_FW}")(
    _audit_check("Fashion brand issues"))
add("c32_audit_generic_brand", _ROLE + f"SELECT {ID}, SELLER_NAME FROM pub WHERE lower(BRAND) = 'generic' AND ({_FAS} OR {_FW})")(
    _audit_check("Generic BRAND Issues"))

OLD, GP = f"({n('OLD_PRICE')})", OP
FAKE = f"{GP} > 0 AND {OLD} > {GP} * 10"
FAKE_TEXT = f"""concat('Old price ', format('{{:,.0f}}', {OLD}), ' is ', format('{{:,.0f}}', {OLD} / {GP}), '× current ', format('{{:,.0f}}', {GP}))"""


@add("c33_fake_discount", PUB + f"SELECT {ID}, {FAKE_TEXT} AS detail FROM pub WHERE {FAKE}")
def c33(spark, sf):
    p = published(spark, sf)
    return p.select(*KEY, audit.fake_discount_detail(p).alias("detail")).where("detail IS NOT NULL")


@add("c34_low_rating", PUB + f"""SELECT PRODUCT_SET_SID, concat('Rating ', CAST(round_even({n('RATING')}, 1) AS varchar), ' < 3.0') AS "DETAIL" FROM pub WHERE ({n('RATING')}) < 3""")
def c34(spark, sf):
    return audit.low_rating(published(spark, sf))


@add("c35_no_ratings", PUB + f"""SELECT PRODUCT_SET_SID, 'No customer ratings' AS "DETAIL" FROM pub WHERE ({n('RATING')}) IS NULL""")
def c35(spark, sf):
    return audit.no_ratings(published(spark, sf))


CORR = f"coalesce({OP} > 0 AND {SP} > 0 AND {OP} > {SP} * 500, false)"
STATED = "TRY_CAST(replace(DISCOUNT, '%', '') AS double)"
MIS = f"coalesce(NOT {CORR} AND {OP} > 0 AND {SP} < {OP} AND abs(({OP} - {SP}) / {OP} * 100 - {STATED}) > 5, false)"
_LB, _LN = S.low("BRAND"), f"lower({S.txt('NAME')})"
TWICE = f"(length({_LN}) - length(replace({_LN}, {_LB}, ''))) / length({_LB}) >= 2"
RNR = f"(coalesce(({n('RATING')}) > 0, false) AND coalesce(({n('REVIEW_COUNT')}) = 0, true))"


@add("c41_c44_advisory_flags", PUB + f"""SELECT {ID}, {CORR} AS corrupted, {MIS} AS mismatch, {TWICE} AS brand_in_title, {RNR} AS unreviewed FROM pub""")
def c41(spark, sf):
    return audit.advisory_flags(published(spark, sf)).select(
        *KEY, F.col("_OLD_PRICE_CORRUPTED").alias("corrupted"), F.col("_DISCOUNT_MISMATCH").alias("mismatch"),
        F.col("_BRAND_IN_TITLE").alias("brand_in_title"), F.col("_RATING_NO_REVIEWS").alias("unreviewed"))


@add("c45_advisory_breakdown", PUB + f"""SELECT * FROM (SELECT 'Corrupted original price' AS flag, count(*) FILTER ({CORR}) AS n FROM pub
 UNION ALL SELECT 'Discount / price mismatch', count(*) FILTER ({MIS}) FROM pub UNION ALL SELECT 'Brand duplicated in title', count(*) FILTER ({TWICE}) FROM pub
 UNION ALL SELECT 'Rating present, review count missing', count(*) FILTER ({RNR}) FROM pub) WHERE n > 0""")
def c45(spark, sf):
    return audit.advisory_breakdown(audit.advisory_flags(published(spark, sf)))


@add("c36_repeated_description", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS repeated FROM documents")
def c36(spark, sf):
    return audit.repeated_description(table(spark, sf, "documents"), "text").select("doc_id", F.col("_repeated").alias("repeated"))


_W = "CAST(l_partkey % 40 * 25 AS integer)"
_H = "CAST(l_suppkey % 37 * 30 AS integer)"


@add("c46_image_warnings", PUB + f"""SELECT {ID}, l_suppkey, array_to_string(list_filter([CASE WHEN {_W} < 300 OR {_H} < 300 THEN 'Low Resolution' END,
 CASE WHEN {_W} > 0 AND {_H} / {_W} > 1.5 THEN 'Tall (Screenshot?)' WHEN {_W} > 0 AND {_H} / {_W} < 0.6 THEN 'Wide Aspect' END], lambda x: x IS NOT NULL), ',') AS warnings FROM pub""")
def c46(spark, sf):
    p = view(spark, sf, "published")
    return p.select(*KEY, "l_suppkey", F.array_join(audit.image_warnings(F.expr(_W), F.expr(_H)), ",").alias("warnings"))


# ---- enrichment ----------------------------------------------------------------------------

FIELDS = ["COLOR", "SIZES_AVAILABLE", "DISCOUNT", "RATING", "MODEL"]


def found_pages(spark, sf):
    """One captured row per base SKU, made from orders."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("SKU"), F.col("o_orderkey").cast("string")).alias("sku"),
        F.col("o_orderpriority").alias("MODEL"), F.col("o_orderstatus").alias("COLOR"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("S, XL")).alias("SIZES_AVAILABLE"))


_EMPTY = "(lower(coalesce(trim({c}), '')) IN ('', 'nan', 'none'))"
_FILLED = PUB + f""", e AS (SELECT pub.*, coalesce(o.o_orderpriority, '') AS MODEL, CASE WHEN {_EMPTY.format(c='COLOR')} THEN coalesce(o.o_orderstatus, COLOR) ELSE COLOR END AS c2,
 CASE WHEN {_EMPTY.format(c='SIZES_AVAILABLE')} THEN coalesce(CASE WHEN o.o_custkey % 2 = 0 THEN 'S, XL' END, SIZES_AVAILABLE) ELSE SIZES_AVAILABLE END AS s2
 FROM pub LEFT JOIN orders o ON concat('SKU', o.o_orderkey) = split_part(PRODUCT_SET_SID, '-', 1))"""


@add("p18_filled_shares", PUB + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (NOT {S.blank(f)}) AS filled, count(*) AS total FROM pub" for f in FIELDS[:4]) + ")")
def p18(spark, sf):
    return audit.filled_shares(published(spark, sf), FIELDS)


@add("p19_p20_enrich", _FILLED + f"SELECT {ID}, c2 AS COLOR, s2 AS SIZES_AVAILABLE, MODEL FROM e")
def p19(spark, sf):
    p = published(spark, sf)
    assert set(audit.fields_to_fill(p, ["COLOR", "SIZES_AVAILABLE", "MODEL"])) == {"COLOR", "SIZES_AVAILABLE", "MODEL"}
    out = audit.enrich(p, found_pages(spark, sf), ["COLOR", "SIZES_AVAILABLE", "MODEL"])
    return out.select(*KEY, "COLOR", "SIZES_AVAILABLE", "MODEL")


_SUM = _FILLED + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS field, count(*) FILTER (NOT {S.blank(b)}) AS before, count(*) FILTER (NOT {S.blank(a)}) AS after,
 greatest(0, count(*) FILTER (NOT {S.blank(a)}) - count(*) FILTER (NOT {S.blank(b)})) AS filled FROM e"""
    for f, b, a in [("COLOR", "COLOR", "c2"), ("SIZES_AVAILABLE", "SIZES_AVAILABLE", "s2"), ("DISCOUNT", "DISCOUNT", "DISCOUNT"),
                    ("RATING", "RATING", "RATING"), ("MODEL", "''", "MODEL")]) + ")"


def _summary(spark, sf):
    p = published(spark, sf)
    after = audit.enrich(p, found_pages(spark, sf), ["COLOR", "SIZES_AVAILABLE", "MODEL"])
    return analytics.enrichment_summary(p, after, FIELDS)


add("a19_enrichment_summary", _SUM)(_summary)
add("a20_enrichment_totals", f"SELECT count(*) FILTER (filled > 0) AS fields_enriched, sum(filled) AS cells_filled FROM ({_SUM})")(
    lambda spark, sf: analytics.enrichment_totals(_summary(spark, sf)))


@add("p21_lookup_results", PUB + """SELECT DISTINCT s.sku AS PRODUCT_SET_SID, s.sku AS "Input", 'SKU' AS "Type", 'KE' AS "Country", CASE WHEN o.o_orderkey IS NULL THEN 'No' ELSE 'Yes' END AS "Found", o.o_orderpriority AS MODEL
FROM (SELECT DISTINCT concat('SKU', l_partkey) AS sku FROM pub) s LEFT JOIN orders o ON concat('SKU', o.o_orderkey) = s.sku""")
def p21(spark, sf):
    skus = published(spark, sf).select(F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("line"),
                                       F.col("_pos"))
    return audit.lookup_results(audit.lookup_inputs(skus, MARKET), found_pages(spark, sf).select("sku", "MODEL"), "KE")


@add("p22_fill_images", PUB + f"""SELECT {ID}, coalesce(i.img, '') AS MAIN_IMAGE FROM pub LEFT JOIN (SELECT DISTINCT PRODUCT_SET_SID AS s, concat('img', split_part(PRODUCT_SET_SID, '-', 2)) AS img FROM pub) i ON i.s = PRODUCT_SET_SID""")
def p22(spark, sf):
    p = published(spark, sf)
    images = p.select("PRODUCT_SET_SID", F.concat(F.lit("img"), F.split_part("PRODUCT_SET_SID", F.lit("-"), F.lit(2))).alias("MAIN_IMAGE"))
    return audit.fill_images(p, images).select(*KEY, "MAIN_IMAGE")


@add("audit_flow")
def audit_flow(spark, sf):
    """Published listings to repaired rows and verdicts, with enrichment."""
    rules = rule_book(spark, sf)
    _, verdicts = flows.audit_verdicts(published(spark, sf), rules, found_pages(spark, sf))
    return verdicts


# ---- quality report ------------------------------------------------------------------------

#: Columns of the listing view that checks, report and the texts made below read.
REPORTED = [*C.columns_read(report.LISTING_FLAGS), "MAIN_IMAGE", "l_partkey"]


def reported(spark, sf, code="KE"):
    """Prepared listings with the columns the report reads besides."""
    rows = ingest.prepare(listings(spark, sf), None, MARKET, columns=REPORTED)
    docs = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("short text"),
                                F.concat(F.lit("long "), F.repeat(F.coalesce("NAME", F.lit("x")), 30)),
                                F.concat(F.lit("<IMG src=x>"), F.repeat(F.coalesce("NAME", F.lit("x")), 30))),
                        (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = rows.withColumns({"DESCRIPTION": docs, "OLD_PRICE": F.when(
        F.col("l_partkey") % 9 == 0, (F.col("GLOBAL_PRICE").cast("double") * 20).cast("string")),
        "No. of Images": (F.col("l_partkey") % 8).cast("string")})
    return report.find_issues(stage(rows, "reported"), rule_book(spark, sf, code))


def _issue_sql(code):
    every = S.checks(code)
    desc = """CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'short text' WHEN 3 THEN concat('long ', repeat(coalesce(NAME, 'x'), 30)) ELSE concat('<IMG src=x>', repeat(coalesce(NAME, 'x'), 30)) END"""
    rep = S.with_("d", *sorted({v for f, *_ in report.REGISTRATIONS if f in every for v in every[f][1]})) + f""",
r AS (SELECT *, {desc} AS descr, l_partkey % 9 = 0 AS fake, l_partkey % 8 AS img FROM d)"""
    fashion = S.sel(f"brand_l = 'fashion' AND NOT {S.role('fashion')}", f"concat('Brand ''Fashion'' used outside Fashion category: ', {S.txt('CATEGORY_CODE')})")
    black = r"'(?i)\b(?:cold plate|plate|cold)\b'"
    special = {
        "#blacklist": S.sel(f"regexp_matches(name_l, {black})", f"concat('Unnecessary: ', array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(name_raw, {black}), lambda x: lower(x)))), ', '))"),
        "#discount": S.sel("fake", "concat('Old price ', format('{:,.0f}', CAST(GLOBAL_PRICE AS double) * 20), ' is 20× current ', format('{:,.0f}', CAST(GLOBAL_PRICE AS double)))", "r"),
        "#repeated": "(SELECT PRODUCT_SET_SID, 'Description appears in multiple products' AS DETAIL FROM (SELECT PRODUCT_SET_SID, descr, count(*) OVER (PARTITION BY descr) AS c FROM r) WHERE c > 1 AND descr <> '')",
        "#few_images": S.sel("img < 5", "concat('Product has only ', img, ' image(s), minimum recommended is 5')", "r"),
        "#empty": S.sel("coalesce(descr, '') = ''", "'Product has no description'", "r"),
        "#thin": S.sel("descr <> '' AND length(descr) < 100", "'Product description is too short'", "r"),
        "#no_img": S.sel("descr IS NOT NULL AND NOT contains(lower(descr), '<img')", "'Product description does not contain any images'", "r"),
        "Fashion brand issues": fashion,
    }
    parts = []
    for i, (flag, severity, col, msg) in enumerate(report.REGISTRATIONS):
        if flag.startswith("NG - ") and code != "NG":
            continue
        source = special.get(flag) or every[flag][0]
        default = (msg or col).replace("'", "''")
        parts.append(f"SELECT PRODUCT_SET_SID AS sid, {i} AS issue_order, '{severity}' AS severity, '{col}' AS flag, coalesce(nullif(trim(DETAIL), ''), '{default}') AS message FROM {source}")
    return rep + ", every_issue AS (" + " UNION ALL ".join(parts) + """),
issue AS (SELECT * FROM every_issue QUALIFY row_number() OVER (PARTITION BY sid, flag, message ORDER BY issue_order, message) = 1),
score AS (SELECT d.PRODUCT_SET_SID AS sid, any_value(d.name_raw) AS nm, any_value(d.seller_raw) AS sl, any_value(d.brand_raw) AS br, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m,
 count(*) FILTER (severity = 'low') AS l, count(issue_order) AS t, greatest(0, 100 - 25 * c - 12 * h - 6 * m - 2 * l) AS q,
 coalesce(string_agg(concat('[', severity, '] ', message), ' | ' ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), issue_order), '') AS top,
 list(DISTINCT flag) FILTER (flag IS NOT NULL) AS flags FROM d LEFT JOIN issue ON issue.sid = d.PRODUCT_SET_SID GROUP BY 1)
"""


KE_ISSUES = _issue_sql("KE")
add("q01_q02_issues", KE_ISSUES + "SELECT * FROM issue")(lambda spark, sf: report.issue_rows(reported(spark, sf)))
add("q01_q02_issues_nigeria", _issue_sql("NG") + "SELECT * FROM issue")(
    lambda spark, sf: report.issue_rows(reported(spark, sf, "NG")))


def quality(spark, sf):
    return report.quality_report(reported(spark, sf), "KE")


_YN = ", ".join(f"""CASE WHEN list_contains(coalesce(flags, []), '{f}') THEN 'YES' ELSE 'NO' END AS "{f}" """ for f in report.YES_NO)


@add("q03_q04_scores", KE_ISSUES + """SELECT sid AS "SKU", q AS "Quality Score", c AS "Critical Issues", h AS "High Issues", m AS "Medium Issues", l AS "Low Issues", t AS "Total Issues" FROM score""")
def q03(spark, sf):
    return quality(spark, sf).select("SKU", "Quality Score", "Critical Issues", "High Issues", "Medium Issues", "Low Issues", "Total Issues")


@add("q05_yes_no_flags", KE_ISSUES + f'SELECT sid AS "SKU", {_YN} FROM score')
def q05(spark, sf):
    return quality(spark, sf).select("SKU", *[F.col(f"`{f}`") for f in report.YES_NO])


@add("q06_top_issues", KE_ISSUES + 'SELECT sid AS "SKU", top AS "Top Issues" FROM score')
def q06(spark, sf):
    return quality(spark, sf).select("SKU", "Top Issues")


@add("q07_quality_report", KE_ISSUES + f"""SELECT s.sid AS "SKU", d.name_raw AS "Name", d.brand_raw AS "Brand", {S.txt('d.CATEGORY')} AS "Category", d.GLOBAL_PRICE AS "Price",
 CASE WHEN l_partkey % 9 = 0 THEN CAST(CAST(d.GLOBAL_PRICE AS double) * 20 AS varchar) END AS "Old Price", '' AS "Discount", '' AS "Rating", '' AS "Total Ratings", d.seller_raw AS "Seller",
 'No' AS "Express", 'No' AS "Shop Global", d.MAIN_IMAGE AS "Image URL", '' AS "Product URL", 'In Stock' AS "Stock", '' AS "Tags", 'KE' AS "Country", q AS "Quality Score",
 c AS "Critical Issues", h AS "High Issues", m AS "Medium Issues", l AS "Low Issues", t AS "Total Issues", top AS "Top Issues", CAST(l_partkey % 8 AS varchar) AS "No. of Images", {_YN}
FROM score s JOIN d ON d.PRODUCT_SET_SID = s.sid""")
def q07(spark, sf):
    return quality(spark, sf)


@add("q08_report_kpis", KE_ISSUES + """SELECT count(*) AS products, avg(q) AS avg_score, count(*) FILTER (t > 0) AS with_issues, count(*) FILTER (c > 0) AS critical,
 count(*) FILTER (t = 0) AS clean, count(*) FILTER (t > 0) / greatest(count(*), 1) * 100 AS issue_rate FROM score""")
def q08(spark, sf):
    return report.report_kpis(quality(spark, sf))


@add("q09_flag_breakdown", KE_ISSUES + f"""SELECT flag, count(DISTINCT sid) AS n FROM issue WHERE flag IN ({', '.join(repr(f) for f in report.BREAKDOWN)}) GROUP BY 1""")
def q09(spark, sf):
    return report.flag_breakdown(quality(spark, sf))


@add("f11_report_filter", KE_ISSUES + """SELECT sid AS "SKU", q AS "Quality Score" FROM score WHERE t > 0 AND list_contains(flags, 'Naming Issue') AND q BETWEEN 10 AND 60
 AND (contains(lower(sid), 'ring') OR contains(lower(nm), 'ring') OR contains(lower(br), 'ring') OR contains(lower(sl), 'ring'))""")
def f11(spark, sf):
    return report.filter_report(quality(spark, sf), "Issues Only", "Naming Issue", 10, 60, " Ring ").select("SKU", "Quality Score")


# ---- review screens ------------------------------------------------------------------------

def simple_verdicts(spark, sf, written=False):
    """Verdicts decided by one cheap check, for the review filters; rows read by several jobs are ``written``."""
    rows = ingest.first_rows(listings(spark, sf))
    if written:
        rows = stage(rows.drop("_pos"), "first")
    from listguard.operators.verdict import verdict
    rules = rule_book(spark, sf, "KE", "category_role")
    out = C.run_checks(rows, rules, ["BRAND name repeated in NAME"]).withColumn("_final", F.col("_mask"))
    return rows, verdict(out, rules)


_FIRST = S.with_("pos") + f""", first AS (SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY PRODUCT_SET_SID ORDER BY _pos) = 1),
v AS (SELECT *, {S.low('BRAND')} NOT IN ('', 'nan') AND contains({S.low('NAME')}, {S.low('BRAND')}) AS bad FROM first)"""


@add("f12_review_rows", _FIRST + f"""SELECT PRODUCT_SET_SID, NAME, SELLER_NAME FROM v WHERE (NOT bad OR l_partkey % 10 = 3) AND contains(lower({S.txt('NAME')}), 'ring')
 AND (contains(lower(SELLER_NAME), 'size 1') OR contains(lower(CATEGORY), 'size 1'))""")
def f12(spark, sf):
    rows, verdicts = simple_verdicts(spark, sf)
    just = rows.where(F.col("l_partkey") % 10 == 3).select(F.col("PRODUCT_SET_SID").alias("sid"))
    return review.review_rows(verdicts, rows, just, None, "Ring", "size 1").select("PRODUCT_SET_SID", "NAME", "SELLER_NAME")


_LISTED = ["PRODUCT_SET_SID", "NAME", "BRAND", "CATEGORY", "CATEGORY_CODE", "ACTIVE_STATUS_COUNTRY", "SELLER_NAME", "PARENTSKU", "SELLER_SKU",
           "COLOR", "COLOR_FAMILY", "GLOBAL_PRICE", "GLOBAL_SALE_PRICE", "COUNT_VARIATIONS", "PRODUCT_WARRANTY", "WARRANTY_DURATION",
           "WARRANTY_ADDRESS", "WARRANTY_TYPE", "LIST_VARIATIONS", "MAIN_IMAGE", "_file", "l_partkey"]


@add("f13_search_rows", S.with_("listings") + f"""SELECT {ID}, NAME FROM listings WHERE SELLER_NAME IN ('Supplier#000000001', 'Supplier#000000002')
 AND ({" OR ".join(f"contains(lower(CAST({c} AS varchar)), '12')" for c in _LISTED)})""")
def f13(spark, sf):
    """The term in any of the listing's columns, numbers among them."""
    df = listings(spark, sf).select(*_LISTED)
    return review.search_rows(df, "12", ["Supplier#000000001", "Supplier#000000002"]).select(*KEY, "NAME")


@add("f15_page", _FIRST + "SELECT PRODUCT_SET_SID, NAME FROM first ORDER BY _pos LIMIT 40 OFFSET 80")
def f15(spark, sf):
    rows = ingest.first_rows(listings(spark, sf)).select("PRODUCT_SET_SID", "NAME", "_pos")
    return review.page(rows, ["_pos"], 2).select("PRODUCT_SET_SID", "NAME")


@add("f15_last_page", _FIRST + """SELECT PRODUCT_SET_SID, NAME FROM (SELECT *, row_number() OVER (ORDER BY _pos) AS n, count(*) OVER () AS total FROM first)
WHERE n > (total - 1) // 40 * 40""")
def f15_last(spark, sf):
    rows = ingest.first_rows(listings(spark, sf)).select("PRODUCT_SET_SID", "NAME", "_pos")
    pages = review.Pages(rows, ["_pos"])
    return pages.page(review.page_count(rows).head().pages - 1).select("PRODUCT_SET_SID", "NAME")


@add("f15_page_count", _FIRST + "SELECT CAST(ceil(count(*) / 40) AS bigint) AS pages FROM first")
def f15_count(spark, sf):
    return review.page_count(listings(spark, sf).select("PRODUCT_SET_SID").distinct())
