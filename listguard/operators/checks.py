"""The thirty listing checks.

Checks that look at one row become one projection after a fixed set of lookups by category
code, seller and brand; keyword checks too, as long as their rules are few. Those of long rule lists, category and
duplicate checks yield (product, detail) pairs, which are united and joined once.  A row ends up with ``_mask``
(bit per flag in priority order) and ``_found`` (the details).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.functions import text as tx
from listguard.functions.prices import listing_price
from listguard.operators import keywords as kw
from listguard.operators.skew import HOT_ROWS, attach_some, columns, small
from listguard.session import stage
from listguard.sources.rules import FLAG_ORDER, FLAGS, ROLES, SELLER_KINDS, RuleBook

# Placeholder brands of the perfume check.
PERFUME_PLACEHOLDERS = ["designers collection", "smart collection", "generic", "original", "fashion"]

# What counts as a stated quantity in a name.
QUANTITY = (
    r"(?iU)\b\d+(?:\.\d+)?\s*"
    r"(?:kg|kgs|g|gm|gms|grams|mg|mcg|ml|l|ltr|liter|litres|litre|cl|oz|ounces|lb|lbs"
    r"|tablets?|tabs?|capsules?|caps?|sachets?|count|ct|sticks?|iu"
    r"|tea\s*bags?|teabags?|bags?"
    r"|pieces?|pcs|pack|packs"
    r"|dozens?|pairs?|rolls?|sheets?|wipes?|pods?|softgels?|lozenges?|gummies|gummy|units?"
    r"|serves?|servings?|vegan\s+pieces?)"
    r"|\b\d+['’]?s\b"
    r"|\b(?:a\s+)?dozen\b"
    r"|\b(?:pack|box|set|bundle|lot)\s+of\s+\d+\b"
    r"|\bper\s+(?:kg|kgs?|g|gm|grams?|mg|mcg|ml|l|ltr|oz|lb)\b"
    r"|\d+\s*(?:Âµg|Î¼g|µg|μg|mcg)"
)
STORAGE = r"(?iU)\b\d+\s*(gb|tb)\b"
TESTER = r"(?iU)\btester\b"
CAPACITY = r"(?iU)\b(\d[\d,]*)\s*mah\b"
CAPACITY_LIMIT = 20_000
ABSENT_WARRANTY = ["nan", "", "none", "nat", "n/a"]
ABSENT_COLOR = ["nan", "", "none", "null"]
FASHION_WORD = r"(?iU)\bfashion\b"
COVER_WORDS = r"(?U)\b(case|cases|cover|covers)\b"

# Columns without which a check does not run.
NEEDS = {
    "Wrong Category": ["NAME", "CATEGORY"],
    "Restricted brands": ["NAME", "BRAND", "SELLER_NAME", "CATEGORY_CODE"],
    "Suspected Fake product": ["CATEGORY_CODE", "BRAND", "GLOBAL_SALE_PRICE", "GLOBAL_PRICE"],
    "Seller Not approved to sell Refurb": ["CATEGORY_CODE", "SELLER_NAME", "NAME"],
    "Product Warranty": ["CATEGORY_CODE"],
    "Seller Approve to sell books": ["CATEGORY_CODE", "SELLER_NAME"],
    "Seller Approved to Sell Perfume": ["CATEGORY_CODE", "SELLER_NAME", "BRAND", "NAME"],
    "Perfume Tester": ["CATEGORY_CODE", "NAME"],
    "Counterfeit Sneakers": ["CATEGORY_CODE", "NAME", "BRAND"],
    "Suspected counterfeit Jerseys": ["CATEGORY_CODE", "NAME", "SELLER_NAME"],
    "Prohibited products": ["NAME", "CATEGORY_CODE"],
    "Unnecessary words in NAME": ["NAME"],
    "Single-word NAME": ["CATEGORY_CODE", "NAME"],
    "Generic BRAND Issues": ["CATEGORY_CODE", "BRAND"],
    "Fashion brand issues": ["CATEGORY_CODE", "BRAND"],
    "BRAND name repeated in NAME": ["BRAND", "NAME"],
    "Wrong Variation": ["CATEGORY_CODE"],
    "Generic branded products with genuine brands": ["NAME", "BRAND"],
    "Missing COLOR": ["CATEGORY_CODE", "NAME"],
    "Missing Weight/Volume": ["CATEGORY_CODE", "NAME"],
    "Incomplete Smartphone Name": ["CATEGORY_CODE", "NAME"],
    "Duplicate product": ["NAME", "SELLER_NAME", "BRAND"],
    "NG - Gift Card Seller": ["CATEGORY_CODE", "SELLER_NAME"],
    "NG - Books Seller": ["NAME", "SELLER_NAME"],
    "NG - TV Brand Seller": ["CATEGORY_CODE", "BRAND", "SELLER_NAME"],
    "NG - HP Toners Seller": ["CATEGORY_CODE", "BRAND", "SELLER_NAME"],
    "NG - Apple Seller": ["BRAND", "SELLER_NAME"],
    "NG - Xmas Tree Seller": ["NAME", "SELLER_NAME"],
    "NG - Rice Brand Seller": ["BRAND", "SELLER_NAME", "CATEGORY_CODE"],
    "NG - Powerbank Capacity": ["CATEGORY_CODE", "NAME", "BRAND"],
}
# Columns that a check reads where they are at hand.
READS = {"Product Warranty": ["PRODUCT_WARRANTY", "WARRANTY_DURATION"], "Wrong Variation": ["COUNT_VARIATIONS"],
         "Generic branded products with genuine brands": ["CATEGORY"], "Missing COLOR": ["COLOR"], "Duplicate product": ["CATEGORY_CODE"],
         "Fashion brand issues": ["CATEGORY"], "Generic BRAND Issues": ["CATEGORY"], "Wrong Category": ["CATEGORY_CODE"]}
ALL_FLAGS = [flag for flag, _, _ in FLAGS]
NIGERIAN = [flag for flag in ALL_FLAGS if flag.startswith("NG - ")]


def columns_read(flags: list[str] = ALL_FLAGS, pos: str = "_pos") -> list[str]:
    """The product, what the checks of ``flags`` read, and the order if one of them compares products."""
    read = {c for f in flags for c in [*NEEDS[f], *READS.get(f, [])]} - {"PRODUCT_SET_SID"}
    return ["PRODUCT_SET_SID", *sorted(read), *([pos] if "Duplicate product" in flags else [])]


def bitmask(df: DataFrame, key: str, item: str, items: list[str], out: str) -> DataFrame:
    """One row per key with a bit for every item it has."""
    bit = F.coalesce(*[F.when(F.col(item) == v, F.lit(1 << i)) for i, v in enumerate(items)])
    return (df.where(F.col(item).isin(*items)).groupBy(F.col(key).alias(f"_k{out}"))
            .agg(F.bit_or(bit.cast("bigint")).alias(out)))


class Row:
    """Names for the expressions the checks share; ``add`` computes the texts once per row."""

    def __init__(self, rules: RuleBook, columns: list[str]):
        self.rules, self.columns = rules, columns
        self.name, self.name_raw, self.name_strip = F.col("_t_name"), F.col("_t_name_raw"), F.col("_t_name_strip")
        self.brand, self.brand_raw = F.col("_t_brand"), F.col("_t_brand_raw")
        self.seller, self.seller_raw = F.col("_t_seller"), F.col("_t_seller_raw")
        self.code = F.col("_code")
        self.patterns: dict[str, Column | None] = {}

    def add(self, df: DataFrame) -> DataFrame:
        def raw(c):
            return tx.as_text(F.col(c)) if c in self.columns else F.lit("")
        name, brand, seller = raw("NAME"), raw("BRAND"), raw("SELLER_NAME")
        return df.withColumns({
            "_t_name": F.lower(tx.strip_ws(name)), "_t_name_raw": name, "_t_name_strip": tx.strip_ws(name),
            "_t_brand": F.lower(tx.strip_ws(brand)), "_t_brand_raw": brand,
            "_t_seller": F.lower(tx.strip_ws(seller)), "_t_seller_raw": seller})

    def role(self, name: str) -> Column:
        return F.coalesce(F.col("_roles").bitwiseAND(1 << ROLES.index(name)) != 0, F.lit(False))

    def approved(self, kind: str) -> Column:
        return F.coalesce(F.col("_kinds").bitwiseAND(1 << SELLER_KINDS.index(kind)) != 0, F.lit(False))

    def has_role(self, *names: str) -> bool:
        return bool(set(names) & self.rules.roles_present)

    def has_kind(self, name: str) -> bool:
        return name in self.rules.kinds_present


def _fake(r):
    price = listing_price(F.col("GLOBAL_SALE_PRICE"), F.col("GLOBAL_PRICE"))
    # Most rows have no floor, and then no price is parsed.
    return F.when(F.col("_floor").isNotNull(), price < F.col("_floor")).otherwise(F.lit(False)), None


def _refurb(r):
    pattern = r.patterns.get("refurb")
    if pattern is None or not r.has_role("phone", "laptop"):
        return None
    unapproved = ((r.role("phone") & ~r.approved("phone")) | (r.role("laptop") & ~r.approved("laptop")))
    device = F.when(r.role("phone"), F.lit("Phone")).otherwise("Laptop")
    detail = F.concat(F.lit("Unapproved "), device, F.lit(" refurb seller — keyword '"),
                      kw.first_match(r.name_strip, pattern), F.lit("' in name (cat: "), r.code, F.lit(")"))
    return unapproved & kw.hit(r.name_strip, pattern), detail


def _warranty(r):
    if not r.has_role("warranty"):
        return None

    def absent(c):
        return tx.strip_ws(tx.as_text(F.col(c))).isin(*ABSENT_WARRANTY) if c in r.columns else F.lit(True)
    return r.role("warranty") & absent("PRODUCT_WARRANTY") & absent("WARRANTY_DURATION"), None


def _books(r):
    if not r.has_role("book") or not r.has_kind("book"):
        return None
    return (r.role("book") & ~r.approved("book"),
            F.concat(F.lit("Seller not approved to sell books: "), r.seller_raw))


def _perfume(r):
    if not r.has_role("perfume"):
        return None
    pattern = r.patterns.get("perfume")
    brand_pattern = r.patterns.get("perfume_brand")
    if pattern is None:
        return None
    placeholder = r.brand.isin(*PERFUME_PLACEHOLDERS)
    sneaky = placeholder & kw.hit(r.name, pattern)
    cond = ((sneaky | kw.hit(r.brand, brand_pattern)) & ~r.approved("perfume")
            if r.has_kind("perfume") else sneaky)
    detail = F.when(placeholder, F.concat(F.lit("Sneaky brand in name: '"),
                                          r.name_strip, F.lit("'"))
                    ).otherwise(F.concat(F.lit("Sensitive brand '"), tx.strip_ws(r.brand_raw),
                                         F.lit("' — seller not approved")))
    return r.role("perfume") & cond, detail


def _tester(r):
    if not r.has_role("perfume"):
        return None
    return (r.role("perfume") & r.name_raw.rlike(TESTER),
            F.concat(F.lit("Perfume tester listed for sale: "), r.name_raw))


def _jerseys(r):
    pattern = r.patterns.get("jersey")
    if pattern is None or not r.has_role("jersey"):
        return None
    return (r.role("jersey") & kw.hit(r.name_strip, pattern) & ~r.approved("jersey_exempt"),
            F.concat(F.lit("Suspected counterfeit jersey — keyword '"),
                     kw.first_match(r.name_strip, pattern), F.lit("' (cat: "), r.code, F.lit(")")))


def unnecessary_detail(name: Column, pattern: Column) -> Column:
    hits = F.array_sort(F.array_distinct(F.transform(kw.every_match(name, pattern), F.lower)))
    return F.concat(F.lit("Unnecessary: "), F.array_join(hits, ", "))


def _unnecessary(r):
    pattern = r.patterns.get("unnecessary")
    if pattern is None:
        return None
    return kw.hit(r.name, pattern), unnecessary_detail(r.name_raw, pattern)


def _single_word(r):
    words = F.filter(F.split(r.name_raw, r"(?U)\s+"), lambda w: w != "")
    return (F.size(words) == 1) & ~r.role("book"), None


def _generic(r):
    return r.role("fashion") & (F.lower(r.brand_raw) == "generic"), None


def _fashion(r):
    in_domain = F.when(F.col("_path").isNotNull() & (F.col("_path") != ""),
                       F.lower(tx.strip_ws(F.col("_path"))).startswith("fashion")).otherwise(r.role("fashion"))
    return ((r.brand == "fashion") & ~in_domain,
            F.concat(F.lit("Brand 'Fashion' used outside Fashion category: "),
                     tx.as_text(F.col("CATEGORY_CODE"))))


def _category_says_fashion(r) -> Column:
    return (F.coalesce(F.col("CATEGORY").rlike(FASHION_WORD), F.lit(False)) if "CATEGORY" in r.columns
            else F.lit(False))


def _audit_generic(r):
    return (F.lower(r.brand_raw) == "generic") & (r.role("fashion") | _category_says_fashion(r)), None


def _audit_fashion(r):
    return (r.brand == "fashion") & ~r.role("fashion") & ~_category_says_fashion(r), None


def _brand_in_name(r):
    return (r.brand != "") & (r.brand != "nan") & F.contains(r.name, r.brand), None


def _variation(r):
    stated = tx.num(F.col("COUNT_VARIATIONS")) if "COUNT_VARIATIONS" in r.columns else F.lit(None)
    # A count that is no whole number of 64 bits (infinity, 1e30) states no variations.
    n = F.coalesce(F.coalesce(stated, F.lit(1.0)).try_cast("bigint"), F.lit(1))
    return ((n >= 3) & ~(r.role("variation") | r.role("fashion")),
            F.concat(F.lit("Variations: "), n.cast("string"), F.lit(", Category: "), r.code))


def _miscellaneous(r):
    return (F.contains(F.lower(tx.as_text(F.col("CATEGORY"))), F.lit("miscellaneous")),
            F.lit("Category contains 'Miscellaneous'"))


def _color(r):
    pattern = r.patterns.get("color")
    if pattern is None or not r.has_role("color"):
        return None
    empty = (tx.lower_key(F.col("COLOR")).isin(*ABSENT_COLOR) if "COLOR" in r.columns else F.lit(True))
    return r.role("color") & ~kw.hit(r.name_raw, pattern) & empty, None


def _weight(r):
    return (r.role("weight") & ~r.name_raw.rlike(QUANTITY), None) if r.has_role("weight") else None


def _smartphone(r):
    if not r.has_role("smartphone"):
        return None
    return (r.role("smartphone") & ~r.name_raw.rlike(STORAGE),
            F.lit("Name missing Storage/Memory spec (e.g., 64GB)"))


def _gift(r):
    if not r.has_role("ng_gift") or not r.has_kind("ng_gift"):
        return None
    return (r.role("ng_gift") & ~r.approved("ng_gift"),
            F.concat(F.lit("Seller not authorised for Gift Card categories: "), r.seller_raw))


def _ng_tvs(r):
    if not r.has_role("ng_tv"):
        return None
    return (r.role("ng_tv") & F.col("_tv"),
            F.concat(F.lit("Seller not authorised for "), F.upper(r.brand), F.lit(" TVs: "), r.seller_raw))


def _ng_toners(r):
    if not r.has_role("ng_hp") or not r.has_kind("ng_hp"):
        return None
    return (r.role("ng_hp") & (r.brand == "hp") & ~r.approved("ng_hp"),
            F.concat(F.lit("Seller not authorised for HP Ink/Toners: "), r.seller_raw))


def _ng_apple(r):
    if not r.has_kind("ng_apple"):
        return None
    return ((r.brand == "apple") & ~r.approved("ng_apple"),
            F.concat(F.lit("Seller not authorised to sell Apple products: "), r.seller_raw))


def _ng_xmas(r):
    pattern = r.patterns.get("xmas")
    if pattern is None or not r.has_kind("ng_xmas"):
        return None
    return (kw.hit(r.name_raw, pattern) & ~r.approved("ng_xmas"),
            F.concat(F.lit("Seller not authorised for Xmas Tree products (keyword '"),
                     kw.first_match(r.name_raw, pattern), F.lit("'): "), r.seller_raw))


def _ng_rice(r):
    rule = F.col("_rice")
    in_category = (F.size(rule.categories) == 0) | F.array_contains(rule.categories, r.code)
    return (F.coalesce(in_category & ~F.array_contains(rule.sellers, r.seller), F.lit(False)),
            F.concat(F.lit("Seller not authorised to sell "), tx.title_case(r.brand), F.lit(" rice: "),
                     r.seller_raw))


def _ng_power(r):
    brands = sorted({x.brand for x in r.rules.table("ng_power_brand").collect()})  # every detail names them all
    if not brands:
        return None
    sizes = F.regexp_extract_all(r.name_raw, F.lit(CAPACITY), F.lit(1))
    large = F.exists(sizes, lambda s: F.regexp_replace(s, ",", "").try_cast("double") >= CAPACITY_LIMIT)
    scope = r.role("ng_power") if r.has_role("ng_power") else F.lit(True)
    approved = tx.title_case(F.lit(", ".join(brands)))
    return (scope & large & ~r.brand.isin(*brands),
            F.concat(F.lit("Brand '"), r.brand_raw, F.lit("' not approved for "),
                     F.regexp_extract(r.name_raw, CAPACITY, 0), F.lit(" powerbanks. Approved: "), approved))


ROW_CHECKS = {
    "Suspected Fake product": _fake,
    "Seller Not approved to sell Refurb": _refurb,
    "Product Warranty": _warranty,
    "Seller Approve to sell books": _books,
    "Seller Approved to Sell Perfume": _perfume,
    "Perfume Tester": _tester,
    "Suspected counterfeit Jerseys": _jerseys,
    "Unnecessary words in NAME": _unnecessary,
    "Single-word NAME": _single_word,
    "Generic BRAND Issues": _generic,
    "Fashion brand issues": _fashion,
    "BRAND name repeated in NAME": _brand_in_name,
    "Wrong Variation": _variation,
    "Missing COLOR": _color,
    "Missing Weight/Volume": _weight,
    "Incomplete Smartphone Name": _smartphone,
    "NG - Gift Card Seller": _gift,
    "NG - TV Brand Seller": _ng_tvs,
    "NG - HP Toners Seller": _ng_toners,
    "NG - Apple Seller": _ng_apple,
    "NG - Xmas Tree Seller": _ng_xmas,
    "NG - Rice Brand Seller": _ng_rice,
    "NG - Powerbank Capacity": _ng_power,
}

# On published listings the category text counts as well as the code.
AUDIT_CHECKS = {"Generic BRAND Issues": _audit_generic, "Fashion brand issues": _audit_fashion}

# Which lookups and word lists a check reads.
_ROLE_FREE = {"Suspected Fake product", "Unnecessary words in NAME", "BRAND name repeated in NAME",
              "Generic branded products with genuine brands", "NG - Books Seller",
              "NG - Apple Seller", "NG - Xmas Tree Seller", "NG - Rice Brand Seller"}
_SELLER_CHECKS = {"Seller Not approved to sell Refurb", "Seller Approve to sell books",
                  "Seller Approved to Sell Perfume", "Suspected counterfeit Jerseys",
                  "NG - Gift Card Seller", "NG - HP Toners Seller", "NG - Apple Seller",
                  "NG - Xmas Tree Seller"}


def _pattern_specs(rules: RuleBook, wanted: set) -> list:
    name, brand = tx.as_text(F.col("NAME")), tx.as_text(F.col("BRAND"))
    specs = []
    if "Seller Not approved to sell Refurb" in wanted:
        specs.append(("refurb", rules.keywords("refurb"), name, "group"))
    if "Seller Approved to Sell Perfume" in wanted:
        specs.append(("perfume", rules.keywords("perfume"), name, "group"))
        specs.append(("perfume_brand", rules.keywords("perfume"), brand, "group"))
    if "Suspected counterfeit Jerseys" in wanted:
        specs.append(("jersey", rules.keywords("jersey"), name, "bounded"))
    if "Unnecessary words in NAME" in wanted:
        specs.append(("unnecessary", rules.words("unnecessary"), name, "each"))
    if "Missing COLOR" in wanted:
        specs.append(("color", rules.words("color"), name, "each"))
    if "NG - Xmas Tree Seller" in wanted:
        specs.append(("xmas", rules.keywords("xmas"), name, "bounded"))
    return specs


def look_up(df: DataFrame, rules: RuleBook, wanted: set, use_paths: bool = True) -> DataFrame:
    """Add the columns the wanted checks read from the rule tables."""
    df = df.withColumn("_code", tx.clean_code(F.col("CATEGORY_CODE")) if "CATEGORY_CODE" in df.columns
                       else F.lit(""))
    if wanted - _ROLE_FREE and rules.roles_present:
        roles = rules.table("category_role").select(tx.clean_code(F.col("code")).alias("code"), "role")
        df = df.join(small(bitmask(roles, "code", "role", ROLES, "_roles")),
                     F.col("_code") == F.col("_k_roles"), "left").drop("_k_roles")
    else:
        df = df.withColumn("_roles", F.lit(None).cast("bigint"))
    if wanted & _SELLER_CHECKS and rules.kinds_present:
        sellers = rules.for_country("approved_seller").select(F.lower("seller").alias("seller"), "kind")
        df = df.join(small(bitmask(sellers, "seller", "kind", SELLER_KINDS, "_kinds")),
                     tx.lower_key(F.col("SELLER_NAME")) == F.col("_k_kinds"), "left").drop("_k_kinds")
    else:
        df = df.withColumn("_kinds", F.lit(None).cast("bigint"))
    if "Suspected Fake product" in wanted:
        floors = rules.for_country("price_floor").select(
            F.col("brand").alias("_fb"), F.col("category_code").alias("_fc"), F.col("threshold").alias("_floor"))
        df = df.join(small(floors), (tx.lower_key(F.col("BRAND")) == F.col("_fb"))
                     & (F.col("_code") == F.col("_fc")), "left").drop("_fb", "_fc")
    if "Fashion brand issues" in wanted:
        if use_paths and "category_map" in rules.tables:
            from listguard.sources.rules import codes_to_paths
            paths = codes_to_paths(rules.table("category_map")).select(
                F.col("code").alias("_pc"), F.col("path").alias("_path"))
            df = df.join(small(paths), F.col("_code") == F.col("_pc"), "left").drop("_pc")
        else:
            df = df.withColumn("_path", F.lit(None).cast("string"))
    if "NG - TV Brand Seller" in wanted:
        # A brand may have very many sellers, so rows meet pairs, not a brand's whole list.
        pairs = rules.table("ng_tv").where("brand IS NOT NULL").distinct()
        brand, seller = tx.lower_key(F.col("BRAND")), tx.lower_key(F.col("SELLER_NAME"))
        df = df.join(small(pairs.select(F.col("brand").alias("_tb")).distinct()), brand == F.col("_tb"), "left")
        approved = pairs.where("seller IS NOT NULL").select(F.col("brand").alias("_pb"), F.col("seller").alias("_ps"))
        df = (df.join(small(approved, exact=True), (brand == F.col("_pb")) & (seller == F.col("_ps")), "left")
              .withColumn("_tv", F.col("_tb").isNotNull() & F.col("_pb").isNull()).drop("_tb", "_pb", "_ps"))
    if "NG - Rice Brand Seller" in wanted:
        rice = rules.table("ng_rice").select(F.col("brand").alias("_rb"),
                                             F.struct("sellers", "categories").alias("_rice"))
        df = df.join(small(rice), tx.lower_key(F.col("BRAND")) == F.col("_rb"), "left").drop("_rb")
    return df


def duplicate_hits(df: DataFrame, rules: RuleBook, pos: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``PRODUCT_SET_SID, detail`` of products after the first with one seller, brand and name key."""
    rows = df.select(*[c for c in ("PRODUCT_SET_SID", pos, "NAME", "BRAND", "SELLER_NAME", "CATEGORY_CODE")
                       if c in df.columns])
    if "duplicate_exempt" in rules.roles_present and "CATEGORY_CODE" in rows.columns:
        exempt = (rules.table("category_role").where("role = 'duplicate_exempt'")
                  .select(tx.clean_code(F.col("code")).alias("_ex")).distinct())
        rows = rows.join(small(exempt), tx.clean_code(F.col("CATEGORY_CODE")) == F.col("_ex"), "left_anti")
    name = tx.as_text(F.col("NAME"))
    key = F.concat_ws("|", tx.lower_key(F.col("SELLER_NAME")), tx.lower_key(F.col("BRAND")), tx.normalize_text(name))
    keyed = rows.select("PRODUCT_SET_SID", F.col(pos).alias("_p"), name.alias("_name"), key.alias("_key"))
    stats = (keyed.groupBy("_key").agg(F.count("*").alias("n"), F.min(F.struct("_p", "_name")).alias("first"))
             .where("n > 1"))
    later = attach_some(keyed, stats, ["_key"], ["PRODUCT_SET_SID"], "n", hot_rows).where("_p > first._p")
    return later.select("PRODUCT_SET_SID", F.concat(F.lit("Duplicate: '"), F.col("first._name"),
                                                    F.lit("'")).alias("detail"))


def sneaker_hits(df: DataFrame, rules: RuleBook) -> DataFrame:
    """``PRODUCT_SET_SID, detail`` of unbranded sneakers whose name holds a listed brand."""
    codes = (rules.table("category_role").where("role = 'sneaker'").select(tx.clean_code(F.col("code")).alias("_sc"))
             .distinct())
    rows = (df.where(tx.lower_key(F.col("BRAND")).isin("generic", "fashion"))
            .join(codes, tx.clean_code(F.col("CATEGORY_CODE")) == F.col("_sc"), "left_semi"))
    probe = rows.select("PRODUCT_SET_SID", tx.lower_key(F.col("NAME")).alias("text"))
    found = kw.containing(probe, rules.words("sneaker_brand"), "word")
    return found.groupBy("PRODUCT_SET_SID").agg(F.lit(None).cast("string").alias("detail"))


def book_hits(df: DataFrame, books: DataFrame) -> DataFrame:
    """``PRODUCT_SET_SID, detail`` of names whose first listed title the seller may not sell."""
    probe = df.select("PRODUCT_SET_SID", tx.lower_key(F.col("NAME")).alias("text"),
                      tx.lower_key(F.col("SELLER_NAME")).alias("s"))
    first = (kw.containing(probe, books, "title").groupBy("PRODUCT_SET_SID")
             .agg(F.min(F.struct("rule_order", "title", F.col("seller").cast("string").alias("allowed"), "s")).alias("b"))
             .select("PRODUCT_SET_SID", "b.*"))
    detail = F.when(F.col("allowed").isNull(), F.concat(F.lit("No seller authorised for book: '"), "title", F.lit("'"))
                    ).otherwise(F.concat(F.lit("Only '"), "allowed", F.lit("' may sell '"), "title", F.lit("'")))
    return (first.where(F.col("allowed").isNull() | (F.col("s") != F.col("allowed")))
            .select("PRODUCT_SET_SID", detail.alias("detail")))


def _joined_hits(df: DataFrame, rules: RuleBook, wanted: set, pos: str, predict, hot_rows: int) -> list:
    """(flag, hits) of the checks that need more than the row; each reads ``df`` on its own."""
    hits = []
    if "Wrong Category" in wanted and predict is not None:
        hits.append(("Wrong Category", predict(df)))
    if "Restricted brands" in wanted and "restricted_brand" in rules.tables:
        hits.append(("Restricted brands",
                     kw.restricted_brand_hits(df, rules.for_country("restricted_brand"))))
    if "Prohibited products" in wanted and "prohibited" in rules.tables:
        hits.append(("Prohibited products", kw.prohibited_hits(df, rules.for_country("prohibited"))))
    if "Generic branded products with genuine brands" in wanted:
        brands = rules.words("known_brand")
        if "word_list" in rules.tables:
            generic = df.where(tx.lower_key(F.col("BRAND")) == "generic")
            if "CATEGORY" in df.columns:
                generic = generic.where(~F.lower(tx.as_text(F.col("CATEGORY"))).rlike(COVER_WORDS))
            found = kw.known_brand_hits(generic, brands)
            detail = F.concat(F.lit("Detected Brand: "), tx.title_case(F.col("brand")))
            hits.append(("Generic branded products with genuine brands",
                         found.select("PRODUCT_SET_SID", detail.alias("detail"))))
    if "Counterfeit Sneakers" in wanted and "sneaker" in rules.roles_present:
        hits.append(("Counterfeit Sneakers", sneaker_hits(df, rules)))
    if "NG - Books Seller" in wanted and "ng_book" in rules.tables:
        hits.append(("NG - Books Seller", book_hits(df, rules.table("ng_book"))))
    if "Duplicate product" in wanted:
        hits.append(("Duplicate product", duplicate_hits(df, rules, pos, hot_rows)))
    return hits


def _brand_array(rules: RuleBook):
    if "restricted_brand" in rules.tables:
        return kw.in_row(kw.brand_rules(rules.for_country("restricted_brand")).drop("country", "variations"))


def _prohibited_array(rules: RuleBook):
    if "prohibited" in rules.tables:
        return kw.in_row(kw.prohibited_rules(rules.for_country("prohibited")))


def _known_array(rules: RuleBook):
    if "word_list" in rules.tables:
        return kw.in_row(kw.known_brands(rules.words("known_brand")))


def _sneaker_array(rules: RuleBook):
    if "sneaker" in rules.roles_present:
        return kw.in_row(rules.words("sneaker_brand").where("word <> ''"))


def _book_array(rules: RuleBook):
    if "ng_book" in rules.tables:
        return kw.in_row(rules.table("ng_book").where("title <> ''").select(
            "rule_order", "title", F.col("seller").cast("string").alias("allowed")))


def _brands_here(r, rules):
    return [kw.restricted_brand_detail(rules)]


def _prohibited_here(r, rules):
    return [kw.prohibited_detail(rules)]


def _known_here(r, rules):
    generic = r.brand == "generic"
    if "CATEGORY" in r.columns:
        generic = generic & ~F.lower(tx.as_text(F.col("CATEGORY"))).rlike(COVER_WORDS)
    brand = F.when(generic, kw.known_brand(rules))
    return [F.concat(F.lit("Detected Brand: "), tx.title_case(brand))]


def _sneakers_here(r, rules):
    named = tx.let(r.name, lambda n: F.exists(rules, lambda x: F.contains(n, x["word"])))
    return [F.when(r.role("sneaker") & r.brand.isin("generic", "fashion") & named, F.lit("")), F.lit(None).cast("string")]


def _books_here(r, rules):
    def first(n):
        return F.array_min(F.filter(rules, lambda x: F.contains(n, x["title"])))

    def detail(b):
        only = F.concat(F.lit("Only '"), b["allowed"], F.lit("' may sell '"), b["title"], F.lit("'"))
        none = F.concat(F.lit("No seller authorised for book: '"), b["title"], F.lit("'"))
        return F.when(b["title"].isNotNull(), F.when(b["allowed"].isNull(), none).when(r.seller != b["allowed"], only))

    return [tx.let(first(r.name), detail)]


# Keyword checks that a row makes by itself while their rules are few: the rules, and [detail or null, detail to give].
IN_ROW = {
    "Restricted brands": (_brand_array, _brands_here),
    "Prohibited products": (_prohibited_array, _prohibited_here),
    "Generic branded products with genuine brands": (_known_array, _known_here),
    "Counterfeit Sneakers": (_sneaker_array, _sneakers_here),
    "NG - Books Seller": (_book_array, _books_here),
}


def in_row_rules(rules: RuleBook, flag: str) -> tuple[Column, int] | None:
    """The rules of a keyword check as a constant array and their number; None if they are many, or for other checks."""
    if flag in IN_ROW and flag not in rules.arrays:
        rules.arrays[flag] = IN_ROW[flag][0](rules)
    return rules.arrays.get(flag)


FOUND = "array<struct<ord:int,detail:string>>"
# Checks that read the rows more than once, and the columns that these and their look-ups use.
JOINED_CHECKS = {"Wrong Category", "Restricted brands", "Prohibited products", "Counterfeit Sneakers", "NG - Books Seller",
                 "Generic branded products with genuine brands", "Duplicate product"}
READ_BY_JOINED = ["PRODUCT_SET_SID", "NAME", "BRAND", "SELLER_NAME", "CATEGORY", "CATEGORY_CODE"]


def run_checks(df: DataFrame, rules: RuleBook, flags: list[str] | None = None, skip=(),
               pos: str = "_pos", predict=None, use_paths: bool = True,
               hot_rows: int = HOT_ROWS, published: bool = False) -> DataFrame:
    """Rows with ``_mask`` and ``_found``; rows stay one per product.

    ``predict`` is a function from listings to ``PRODUCT_SET_SID, detail`` of wrong categories;
    without it the simple category check runs.  ``df`` should be a stored or staged table: the
    joined checks read it again, each with the few columns it needs.
    """
    if flags is None:
        flags = [f for f in ALL_FLAGS if rules.country == "NG" or f not in NIGERIAN]
    left_out = set(skip) | rules.skipped()
    flags = [f for f in flags if f not in left_out and set(NEEDS[f]) <= set(df.columns)]
    wanted = set(flags)
    row = Row(rules, df.columns)
    looked = row.add(look_up(df, rules, wanted, use_paths))
    looked, row.patterns = kw.attach_patterns(looked, _pattern_specs(rules, wanted), source=df)
    row_checks = {**ROW_CHECKS, **(AUDIT_CHECKS if published else {})}
    if predict is None:
        row_checks["Wrong Category"] = _miscellaneous
    found, made_here, short = [], {}, [f for f in flags if in_row_rules(rules, f) is not None]
    for flag in short:
        array, n = rules.arrays[flag]
        if n:
            detail, hit = IN_ROW[flag][1](row, array), F.col(f"_hit_{FLAG_ORDER[flag]}")
            made_here[f"_hit_{FLAG_ORDER[flag]}"] = detail[0]
            found.append(F.when(F.col("PRODUCT_SET_SID").isNotNull() & hit.isNotNull(), F.struct(
                F.lit(FLAG_ORDER[flag]).alias("ord"), (hit if len(detail) == 1 else detail[1]).alias("detail"))))
    for flag in flags:
        made = row_checks[flag](row) if flag in row_checks else None
        if made is not None:
            text = made[1] if made[1] is not None else F.lit(None).cast("string")
            found.append(F.when(made[0], F.struct(F.lit(FLAG_ORDER[flag]).alias("ord"), text.alias("detail"))))
    array = F.array_compact(F.array(*found)) if found else F.array().cast(FOUND)
    looked = looked.withColumns(made_here) if made_here else looked
    out = looked.select(*columns(df), array.cast(FOUND).alias("_found"))
    hits = _joined_hits(df, rules, wanted - set(short), pos, predict, hot_rows)
    if hits:
        tagged = [h.select("PRODUCT_SET_SID", F.struct(F.lit(FLAG_ORDER[f]).alias("ord"), F.col("detail")).alias("x"))
                  for f, h in hits]
        union = tagged[0]
        for t in tagged[1:]:
            union = union.unionByName(t)
        more = union.groupBy("PRODUCT_SET_SID").agg(F.collect_list("x").alias("_more"))
        every = F.concat("_found", F.coalesce("_more", F.array().cast(FOUND)))
        out = out.join(more, "PRODUCT_SET_SID", "left").withColumn("_found", every).drop("_more")
    # The mask is read off the finished array, so no condition is evaluated twice.
    mask = F.aggregate("_found", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), x.ord - 1)))
    return out.withColumn("_mask", mask)


def check(df: DataFrame, rules: RuleBook, flag: str, **kwargs) -> DataFrame:
    """Products one check flags, with its detail; a check that reads the rows several times gets them written."""
    if flag in JOINED_CHECKS and in_row_rules(rules, flag) is None:
        read = {*READ_BY_JOINED, kwargs.get("pos", "_pos")}
        df = stage(df.select(*[F.col(f"`{c}`") for c in df.columns if c in read]), "prepared")
    out = run_checks(df, rules, [flag], **kwargs).where("_mask <> 0")
    return out.select("PRODUCT_SET_SID", F.get("_found", F.lit(0)).getField("detail").alias("DETAIL"))


def contains_miscellaneous(df: DataFrame) -> DataFrame:
    """The simple category check, used where no category index is at hand."""
    return df.where(F.contains(F.lower(tx.as_text(F.col("CATEGORY"))), F.lit("miscellaneous")))


def highlighted_words(df: DataFrame, rules: RuleBook, listed: str = "unnecessary") -> DataFrame:
    """Names with every word of the list marked."""
    out, patterns = kw.attach_patterns(df, [(listed, rules.words(listed), tx.as_text(F.col("NAME")), "each")])
    pattern = patterns[listed]
    if pattern is None:
        return df.limit(0).select("PRODUCT_SET_SID", "NAME")
    return (out.where(kw.hit(tx.lower_key(F.col("NAME")), pattern))
            .select("PRODUCT_SET_SID", F.regexp_replace(F.col("NAME"), pattern, F.lit("[*]$0[*]")).alias("NAME")))
