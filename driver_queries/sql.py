"""Pieces of comparison SQL: cleaned columns, prepared listings, one SELECT per check."""

from __future__ import annotations

from driver_queries.views import VIEWS, cte
from listguard.operators.checks import CAPACITY_LIMIT
from listguard.operators.ingest import SPREAD_COLUMNS
from listguard.sources.rules import FLAG_ORDER, FLAGS, MANUAL_FLAGS

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
NOISE = "new|sale|original|genuine|authentic|official|premium|quality|best|hot|2024|2025"


def txt(c):
    return f"coalesce(CAST({c} AS varchar), 'nan')"


def strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def low(c):
    return f"lower({strip(txt(c))})"


def num(c):
    return f"CASE WHEN regexp_matches({c}, {NUM}) THEN TRY_CAST({strip(c)} AS double) END"


def code(c):
    return f"coalesce(split_part({strip(f'CAST({c} AS varchar)')}, '.', 1), '')"


def norm(c):
    x = rf"regexp_replace({strip(f'lower({c})')}, '\b({NOISE})\b', '', 'g')"
    return rf"coalesce(regexp_replace(regexp_replace({x}, '[^\w\s]', '', 'g'), '\s+', '', 'g'), '')"


def blank(c):
    return f"(coalesce({strip(f'CAST({c} AS varchar)')}, '') IN ('', 'nan', 'None', 'NaN'))"


def bounded(word):
    """Occurrence of a word (a SQL text) with no word character beside it."""
    quoted = rf"regexp_replace({word}, '([\.\[\]()*+?^$|#-])', '\\\1', 'g')"
    return f"concat('(^|[^0-9A-Za-z_])', {quoted}, '($|[^0-9A-Za-z_])')"


def country(c="ACTIVE_STATUS_COUNTRY"):
    return f"regexp_replace(upper({strip(txt(c))}), '^SHOP-', '')"


_FILL = ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER back, first_value({c} IGNORE NULLS) OVER ahead) AS {c}"
    for c in SPREAD_COLUMNS)


def _prepared(name, where):
    return f"""{name} AS (SELECT * REPLACE (CAST(greatest(_rows, coalesce({num('COUNT_VARIATIONS')}, 1)) AS double)
  AS COUNT_VARIATIONS) FROM (SELECT *, row_number() OVER (PARTITION BY PRODUCT_SET_SID ORDER BY _pos) AS _rn,
  CAST(count(*) OVER (PARTITION BY PRODUCT_SET_SID) AS double) AS _rows FROM filled {where}) WHERE _rn = 1)"""


def _clean(name, source):
    return f"""{name} AS (SELECT *, {code('CATEGORY_CODE')} AS code, {low('NAME')} AS name_l, {txt('NAME')} AS name_raw,
  {strip(txt('NAME'))} AS name_s, {low('BRAND')} AS brand_l, {txt('BRAND')} AS brand_raw,
  {low('SELLER_NAME')} AS seller_l, {txt('SELLER_NAME')} AS seller_raw FROM {source})"""


PARTS = {
    "pos": (f"pos AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS _pos FROM listings)", ["listings"]),
    "filled": (f"""filled AS (SELECT * REPLACE ({_FILL}) FROM pos WINDOW
  back AS (PARTITION BY PRODUCT_SET_SID ORDER BY _pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  ahead AS (PARTITION BY PRODUCT_SET_SID ORDER BY _pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", ["pos"]),
    "prepared": (_prepared("prepared", ""), ["filled"]),
    "prepared_ke": (_prepared("prepared_ke", f"WHERE {country()} = 'KE'"), ["filled"]),
    "prepared_ng": (_prepared("prepared_ng", f"WHERE {country()} IN ('NG', 'MULTIPLE', 'MULTI')"), ["filled"]),
    "d": (_clean("d", "prepared"), ["prepared"]),
    "d_ke": (_clean("d", "prepared_ke"), ["prepared_ke"]),
    "d_ng": (_clean("d", "prepared_ng"), ["prepared_ng"]),
    "pub": (f"pub AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS _pos FROM published)", ["published"]),
}


def with_(*names: str) -> str:
    """WITH clause of the named parts and views and all they need."""
    done, texts = set(), []

    def add(n):
        if n in done:
            return
        done.add(n)
        if n in PARTS:
            text, needs = PARTS[n]
            for x in needs:
                add(x)
            texts.append(text)
        else:
            texts.append(cte(n))
    for n in names:
        add(n)
    return "WITH " + ",\n".join(texts) + "\n"


def role(r):
    return f"(code IN (SELECT code FROM category_role WHERE role = '{r}'))"


def ok(kind, c):
    return f"(seller_l IN (SELECT seller FROM approved_seller WHERE kind = '{kind}' AND country = '{c}'))"


NO = "CAST(NULL AS varchar)"
PRICE = f"""coalesce(CASE WHEN ({num('GLOBAL_SALE_PRICE')}) > 0 THEN {num('GLOBAL_SALE_PRICE')}
  ELSE {num('GLOBAL_PRICE')} END, 0)"""
WORD_UNN = r"'(?i)\b(?:buy now|best|new)\b'"
QUANTITY = (r"(?i)\b\d+(?:\.\d+)?\s*(?:kg|kgs|g|gm|gms|grams|mg|mcg|ml|l|ltr|liter|litres|litre|cl|oz|ounces|lb|lbs"
            r"|tablets?|tabs?|capsules?|caps?|sachets?|count|ct|sticks?|iu|tea\s*bags?|teabags?|bags?|pieces?|pcs|pack|packs"
            r"|dozens?|pairs?|rolls?|sheets?|wipes?|pods?|softgels?|lozenges?|gummies|gummy|units?|serves?|servings?|vegan\s+pieces?)"
            r"|\b\d+[''’]?s\b|\b(?:a\s+)?dozen\b|\b(?:pack|box|set|bundle|lot)\s+of\s+\d+\b"
            r"|\bper\s+(?:kg|kgs?|g|gm|grams?|mg|mcg|ml|l|ltr|oz|lb)\b|\d+\s*(?:µg|μg|mcg)")
SINGLE = r"len(list_filter(regexp_split_to_array(name_raw, '\s+'), lambda x: x <> '')) = 1"


def title(x):
    """Title case of a single lower-case word with digits or signs inside."""
    words = rf"regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)')"
    return f"array_to_string(list_transform({words}, lambda w: concat(upper(w[1]), lower(w[2:]))), '')"


RESTRICTED = """(SELECT PRODUCT_SET_SID, arg_max(detail, rule_order) AS DETAIL FROM (
  SELECT PRODUCT_SET_SID, rule_order, rejects, concat('Restricted Brand: ', coalesce(
      last_value(CASE WHEN main THEN label END IGNORE NULLS) OVER w, first_value(label) OVER w),
      CASE WHEN has_sellers THEN ' - Seller not in approved list' ELSE ' - No sellers approved' END) AS detail
  FROM (SELECT PRODUCT_SET_SID, rule_order, main, has_sellers, rejects, CASE WHEN main THEN brand_name
      ELSE concat(brand_name, ' (as ''', CASE WHEN vb1 OR vb2 THEN CASE WHEN contains(brand_l, v1) THEN v1 ELSE v2 END
        ELSE CASE WHEN contains(name_low, v1) THEN v1 ELSE v2 END END, ''')') END AS label
    FROM (SELECT d.PRODUCT_SET_SID, brand_l, lower(name_raw) AS name_low, r.*,
        (brand_l = rb OR regexp_matches(lower(name_raw), {b})) AS main,
        (v1 IS NOT NULL AND regexp_matches(brand_l, {p1})) AS vb1, (v2 IS NOT NULL AND regexp_matches(brand_l, {p2})) AS vb2,
        (v1 IS NOT NULL AND regexp_matches(lower(name_raw), {p1})) AS vn1, (v2 IS NOT NULL AND regexp_matches(lower(name_raw), {p2})) AS vn2,
        (cats IS NULL OR list_contains(cats, code)) AND NOT list_contains(sellers, seller_l) AS rejects
      FROM d CROSS JOIN rules r) WHERE main OR vb1 OR vb2 OR vn1 OR vn2)
  WINDOW w AS (PARTITION BY PRODUCT_SET_SID ORDER BY rule_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE rejects GROUP BY PRODUCT_SET_SID)""".replace("{b}", bounded("rb")).replace("{p1}", bounded("v1")).replace(
      "{p2}", bounded("v2"))


def restricted(c):
    """The restricted-brand check; variations of a rule are at most two in the view."""
    rules = f"""SELECT lower(trim(brand)) AS rb, trim(brand) AS brand_name, _pos AS rule_order,
  CASE WHEN approved_sellers = '' THEN [] ELSE string_split(lower(approved_sellers), ', ') END AS sellers,
  approved_sellers <> '' AS has_sellers,
  CASE WHEN categories IS NULL THEN NULL ELSE [split_part(string_split(categories, ',')[1], '.', 1), string_split(categories, ',')[2]] END AS cats,
  CASE WHEN variations LIKE '%,%' THEN 'hot rod' ELSE lower(variations) END AS v1,
  CASE WHEN variations LIKE '%,%' THEN 'anvil' END AS v2 FROM brand_sheet WHERE country = '{c}'"""
    return RESTRICTED.replace("CROSS JOIN rules r", f"CROSS JOIN ({rules}) r")


def prohibited(c):
    """The prohibited check; the fold is spelled out with a list reduction."""
    return f"""(SELECT PRODUCT_SET_SID, regexp_replace(list_reduce(list_prepend('Prohibited:', list(kw ORDER BY _pos, kw)),
      lambda a, k: CASE WHEN contains(a, k) THEN a ELSE concat(a, ' ', k, ',') END), ',+$', '') AS DETAIL
    FROM (SELECT d.PRODUCT_SET_SID, lower(trim(p.keyword)) AS kw, p._pos FROM d JOIN prohibited_sheet p
      ON p.country = '{c}' AND (p.categories = '' OR list_contains(string_split(p.categories, ','), d.code))
      AND regexp_matches(lower(name_raw), {bounded("lower(trim(p.keyword))")}))
    GROUP BY PRODUCT_SET_SID)"""


KNOWN = r"""(SELECT PRODUCT_SET_SID, concat('Detected Brand: ', {t}) AS DETAIL FROM (
  SELECT PRODUCT_SET_SID, arg_max(b, length(b)) AS kb FROM (
    SELECT PRODUCT_SET_SID, lower(trim(word)) AS b, {n} AS nc, {k} AS bc
    FROM d JOIN word_list ON list = 'known_brand' WHERE brand_l = 'generic'
      AND NOT regexp_matches(lower({cat}), '\b(case|cases|cover|covers)\b'))
  WHERE starts_with(nc, bc) AND (length(nc) = length(bc) OR NOT regexp_matches(nc[length(bc)+1], '[a-z0-9]'))
  GROUP BY PRODUCT_SET_SID))"""


def _plain(x):
    return strip(rf"regexp_replace(regexp_replace(lower({x}), '[''.\-]', ' ', 'g'), '\s+', ' ', 'g')")


KNOWN = (KNOWN.replace("{t}", title("kb")).replace("{n}", _plain("name_raw")).replace("{k}", _plain("trim(word)"))
         .replace("{cat}", txt("CATEGORY")))


def duplicates():
    key = f"concat(seller_l, '|', brand_l, '|', {norm('name_raw')})"
    return f"""(SELECT PRODUCT_SET_SID, concat('Duplicate: ''', first_name, '''') AS DETAIL FROM (
    SELECT PRODUCT_SET_SID, _pos, min(_pos) OVER w AS first_pos, first_value(name_raw) OVER w AS first_name
    FROM d WHERE NOT {role('duplicate_exempt')} WINDOW w AS (PARTITION BY {key} ORDER BY _pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE _pos > first_pos)"""


def books(c):
    return f"""(SELECT PRODUCT_SET_SID, CASE WHEN seller IS NULL THEN concat('No seller authorised for book: ''', title, '''')
      ELSE concat('Only ''', seller, ''' may sell ''', title, '''') END AS DETAIL
    FROM (SELECT d.PRODUCT_SET_SID, seller_l, r.title, r.seller, row_number() OVER (PARTITION BY d.PRODUCT_SET_SID ORDER BY r._pos, r.title) AS rn
      FROM d JOIN (SELECT lower(trim(title)) AS title, lower(trim(min(seller))) AS seller, min(_pos) AS _pos FROM book_sheet GROUP BY 1) r
      ON contains(d.name_l, r.title)) WHERE rn = 1 AND (seller IS NULL OR seller_l <> seller))"""


def sel(where, detail=NO, source="d"):
    return f"(SELECT PRODUCT_SET_SID, {detail} AS DETAIL FROM {source} WHERE {where})"


def checks(c: str = "KE") -> dict[str, tuple[str, list[str]]]:
    """flag -> (SELECT, views it needs) for a rule country."""
    kw_ref = r"'(?i)\b(refurbished|old)\b'"
    kw_perf = r"'(?i)\b(blue bolt|ring|hp)\b'"
    kw_jer = "anvil|hot rod" if c == "KE" else "anvil"
    placeholders = "('designers collection', 'smart collection', 'generic', 'original', 'fashion')"
    absent = "('nan', '', 'none', 'nat', 'n/a')"
    cap = r"'(?i)\b(\d[\d,]*)\s*mah\b'"
    jer_hit = f"regexp_matches(name_s, '(?i)(^|[^0-9A-Za-z_])({kw_jer})($|[^0-9A-Za-z_])')"
    xmas_re = "'(?i)(^|[^0-9A-Za-z_])(red ring|gear)($|[^0-9A-Za-z_])'"
    path = "lower(concat(CASE (CAST(code AS integer) - 1000000) % 3 WHEN 0 THEN 'Fashion' ELSE 'Hardware' END))"
    return {
        "Wrong Category": (sel(f"contains(lower({txt('CATEGORY')}), 'miscellaneous')", "'Category contains ''Miscellaneous'''"), []),
        "Restricted brands": (restricted(c), ["brand_sheet"]),
        "Suspected Fake product": (f"""(SELECT PRODUCT_SET_SID, {NO} AS DETAIL FROM d JOIN price_floor f ON f.country = '{c}'
          AND f.brand = brand_l AND f.category_code = code WHERE {PRICE} < f.threshold)""", ["price_floor"]),
        "Seller Not approved to sell Refurb": (sel(
            f"regexp_matches(name_s, {kw_ref}) AND (({role('phone')} AND NOT {ok('phone', c)}) OR ({role('laptop')} AND NOT {ok('laptop', c)}))",
            f"concat('Unapproved ', CASE WHEN {role('phone')} THEN 'Phone' ELSE 'Laptop' END, ' refurb seller — keyword ''', regexp_extract(name_s, {kw_ref}), ''' in name (cat: ', code, ')')"),
            ["category_role", "approved_seller"]),
        "Product Warranty": (sel(f"{role('warranty')} AND {strip(txt('PRODUCT_WARRANTY'))} IN {absent} AND {strip(txt('WARRANTY_DURATION'))} IN {absent}"),
                             ["category_role"]),
        "Seller Approve to sell books": (sel(f"{role('book')} AND NOT {ok('book', c)}", "concat('Seller not approved to sell books: ', seller_raw)"),
                                         ["category_role", "approved_seller"]),
        "Seller Approved to Sell Perfume": (sel(
            f"{role('perfume')} AND ((brand_l IN {placeholders} AND regexp_matches(name_l, {kw_perf})) OR regexp_matches(brand_l, {kw_perf})) AND NOT {ok('perfume', c)}",
            f"CASE WHEN brand_l IN {placeholders} THEN concat('Sneaky brand in name: ''', name_s, '''') ELSE concat('Sensitive brand ''', {strip('brand_raw')}, ''' — seller not approved') END"),
            ["category_role", "approved_seller"]),
        "Perfume Tester": (sel(rf"{role('perfume')} AND regexp_matches(name_raw, '(?i)\btester\b')",
                               "concat('Perfume tester listed for sale: ', name_raw)"), ["category_role"]),
        "Counterfeit Sneakers": (sel(f"{role('sneaker')} AND brand_l IN ('generic', 'fashion') AND (contains(name_l, 'anvil') OR contains(name_l, 'ld r'))"),
                                 ["category_role"]),
        "Suspected counterfeit Jerseys": (sel(f"{role('jersey')} AND {jer_hit} AND NOT {ok('jersey_exempt', c)}",
            f"concat('Suspected counterfeit jersey — keyword ''', regexp_extract(name_s, '(?i)(^|[^0-9A-Za-z_])({kw_jer})($|[^0-9A-Za-z_])', 2), ''' (cat: ', code, ')')"),
            ["category_role", "approved_seller"]),
        "Prohibited products": (prohibited(c), ["prohibited_sheet"]),
        "Unnecessary words in NAME": (sel(f"regexp_matches(name_l, {WORD_UNN})",
            f"concat('Unnecessary: ', array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(name_raw, {WORD_UNN}), lambda x: lower(x)))), ', '))"), []),
        "Single-word NAME": (sel(f"{SINGLE} AND NOT {role('book')}"), ["category_role"]),
        "Generic BRAND Issues": (sel(f"{role('fashion')} AND lower(brand_raw) = 'generic'"), ["category_role"]),
        "Fashion brand issues": (sel(f"brand_l = 'fashion' AND {path} <> 'fashion'",
            f"concat('Brand ''Fashion'' used outside Fashion category: ', {txt('CATEGORY_CODE')})"), []),
        "BRAND name repeated in NAME": (sel("brand_l NOT IN ('', 'nan') AND contains(name_l, brand_l)"), []),
        "Wrong Variation": (sel(f"CAST(trunc(COUNT_VARIATIONS) AS integer) >= 3 AND NOT {role('variation')} AND NOT {role('fashion')}",
            "concat('Variations: ', CAST(CAST(trunc(COUNT_VARIATIONS) AS integer) AS varchar), ', Category: ', code)"), ["category_role"]),
        "Generic branded products with genuine brands": (KNOWN, ["word_list"]),
        "Missing COLOR": (sel(rf"{role('color')} AND NOT regexp_matches(name_raw, '(?i)\b(red|blue)\b') AND {low('COLOR')} IN ('nan', '', 'none', 'null')"),
                          ["category_role"]),
        "Missing Weight/Volume": (sel(f"{role('weight')} AND NOT regexp_matches(name_raw, '{QUANTITY}')"), ["category_role"]),
        "Incomplete Smartphone Name": (sel(rf"{role('smartphone')} AND NOT regexp_matches(name_raw, '(?i)\b\d+\s*(gb|tb)\b')",
                                           "'Name missing Storage/Memory spec (e.g., 64GB)'"), ["category_role"]),
        "Duplicate product": (duplicates(), ["category_role"]),
        "NG - Gift Card Seller": (sel(f"{role('ng_gift')} AND NOT {ok('ng_gift', c)}", "concat('Seller not authorised for Gift Card categories: ', seller_raw)"),
                                  ["category_role", "approved_seller"]),
        "NG - Books Seller": (books(c), ["book_sheet"]),
        "NG - TV Brand Seller": (sel(f"""{role('ng_tv')} AND brand_l IN (SELECT brand FROM tv_seller)
          AND (brand_l, seller_l) NOT IN (SELECT (brand, seller) FROM tv_seller)""",
            "concat('Seller not authorised for ', upper(brand_l), ' TVs: ', seller_raw)"), ["category_role", "tv_seller"]),
        "NG - HP Toners Seller": (sel(f"{role('ng_hp')} AND brand_l = 'hp' AND NOT {ok('ng_hp', c)}", "concat('Seller not authorised for HP Ink/Toners: ', seller_raw)"),
                                  ["category_role", "approved_seller"]),
        "NG - Apple Seller": (sel(f"brand_l = 'apple' AND NOT {ok('ng_apple', c)}", "concat('Seller not authorised to sell Apple products: ', seller_raw)"),
                              ["approved_seller"]),
        "NG - Xmas Tree Seller": (sel(f"regexp_matches(name_raw, {xmas_re}) AND NOT {ok('ng_xmas', c)}",
            f"concat('Seller not authorised for Xmas Tree products (keyword ''', regexp_extract(name_raw, {xmas_re}, 2), '''): ', seller_raw)"), ["approved_seller"]),
        "NG - Rice Brand Seller": (f"""(SELECT PRODUCT_SET_SID, concat('Seller not authorised to sell ', {title('brand_l')}, ' rice: ', seller_raw) AS DETAIL
          FROM d JOIN (SELECT lower(trim(brand)) AS rb, list(category) FILTER (category IS NOT NULL) AS cats, max(sellers) AS s FROM rice_sheet GROUP BY 1) r ON rb = brand_l
          WHERE (cats IS NULL OR list_contains(cats, code)) AND NOT (s <> '' AND seller_l IN ('supplier#000000001', 'supplier#000000002')))""", ["rice_sheet"]),
        "NG - Powerbank Capacity": (sel(
            f"{role('ng_power')} AND len(list_filter(regexp_extract_all(name_raw, {cap}, 1), lambda x: CAST(replace(x, ',', '') AS bigint) >= {CAPACITY_LIMIT})) > 0 AND brand_l NOT IN ('hp', 'brand#7')",
            f"concat('Brand ''', brand_raw, ''' not approved for ', regexp_extract(name_raw, {cap}), ' powerbanks. Approved: Brand#7, Hp')"), ["category_role"]),
    }


def check_sql(flag: str, c: str = "KE") -> str:
    text, needs = checks(c)[flag]
    return with_("d", *needs) + f"SELECT * FROM {text}"


def flag_values() -> str:
    rows = ", ".join("(%d, '%s', '%s', '%s')" % (FLAG_ORDER.get(f, 0), f, r.format(market="the shop").replace("'", "''"),
                                                m.format(market="the shop").replace("'", "''"))
                     for f, r, m in FLAGS + MANUAL_FLAGS)
    return f"(SELECT * FROM (VALUES {rows}) AS t(ord, flag, reason, comment))"


def verdict_parts(c: str, part: str, skip=()) -> str:
    """WITH clause ending in ``own`` (sid, ord, detail), ``final`` (sid, ord) and ``verdict``."""
    every = checks(c)
    flags = [f for f in FLAG_ORDER if (c == "NG" or not f.startswith("NG - ")) and f not in skip]
    views = sorted({v for f in flags for v in every[f][1]})
    own = " UNION ALL ".join(f"SELECT PRODUCT_SET_SID AS sid, {FLAG_ORDER[f]} AS ord, DETAIL AS detail FROM {every[f][0]}" for f in flags)
    dk = ", '\x01', ".join(low(x) for x in ("NAME", "BRAND", "SELLER_NAME", "COLOR"))
    mk = ", '|', ".join(norm(txt(x)) for x in ("BRAND", "NAME", "COLOR"))
    return with_(part, *views) + f""", own AS ({own}),
keys AS (SELECT PRODUCT_SET_SID AS sid, concat({dk}) AS dk, concat({mk}) AS mk FROM d),
shared AS (SELECT sid, ord FROM own
  UNION SELECT k2.sid, o.ord FROM own o JOIN keys k1 ON o.sid = k1.sid JOIN keys k2 ON k1.dk = k2.dk
  UNION SELECT k2.sid, o.ord FROM own o JOIN keys k1 ON o.sid = k1.sid JOIN keys k2 ON k1.mk = k2.mk WHERE o.ord IN (2, 4, 6, 7, 9)),
final AS (SELECT sid, min(ord) AS ord FROM shared GROUP BY sid),
verdict AS (SELECT d.PRODUCT_SET_SID AS "ProductSetSid", d.PARENTSKU AS "ParentSKU",
  CASE WHEN f.ord IS NULL THEN 'Approved' ELSE 'Rejected' END AS "Status", coalesce(m.reason, '') AS "Reason",
  CASE WHEN f.ord IS NULL THEN '' WHEN coalesce(o.detail, '') <> '' THEN concat(m.comment, ' (', o.detail, ')') ELSE m.comment END AS "Comment",
  coalesce(m.flag, '') AS "FLAG", d.SELLER_NAME AS "SellerName"
  FROM d LEFT JOIN final f ON d.PRODUCT_SET_SID = f.sid LEFT JOIN own o ON o.sid = f.sid AND o.ord = f.ord
  LEFT JOIN {flag_values()} m ON m.ord = f.ord)
"""


__all__ = ["VIEWS", "with_", "check_sql", "verdict_parts"]
