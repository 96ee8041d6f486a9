"""Audit of published listings: category codes, column repair, advisory flags, audit checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.functions import text as tx
from listguard.functions.prices import discount_text, price_text
from listguard.functions.urls import base_sku, country_from_url, last_slug, official_pattern, sku_from_url
from listguard.market import DEFAULT_MARKET, Market
from listguard.operators import keywords as kw
from listguard.operators.skew import HOT_ROWS, attach_group, attach_some, columns, first_per_key, map_distinct, small

ADVISORY = {
    "_OLD_PRICE_CORRUPTED": "Corrupted original price",
    "_DISCOUNT_MISMATCH": "Discount / price mismatch",
    "_BRAND_IN_TITLE": "Brand duplicated in title",
    "_RATING_NO_REVIEWS": "Rating present, review count missing",
}


# ---- category codes ------------------------------------------------------------------------

def segments(c: Column, pattern: str = "[>/]") -> Column:
    return F.filter(F.transform(F.split(c, pattern), tx.strip_ws), lambda s: s != "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "_")


def resolve_by_name(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``CATEGORY_CODE``: code of the rightmost known segment, else a slug of the last one.

    ``codes`` has ``key`` (lower-case name) and ``code``.
    """
    def derive(values: DataFrame) -> DataFrame:
        parts = values.withColumn("_s", segments(F.col("CATEGORY")))
        found = (parts.select("CATEGORY", F.posexplode("_s").alias("_i", "seg"))
                 .withColumn("key", F.lower("seg")).join(small(codes.select("key", "code")), "key")
                 .groupBy("CATEGORY").agg(F.max_by("code", "_i").alias("_code")))
        last = F.when(F.size("_s") > 0, F.element_at("_s", -1)).otherwise(F.col("CATEGORY"))
        code = F.when(F.col("CATEGORY").isin("", "nan"), F.lit("")).otherwise(
            F.coalesce("_code", slug(last)))
        return parts.join(found, "CATEGORY", "left").select("CATEGORY", "_n", code.alias("_resolved"))

    out = map_distinct(df.drop("CATEGORY_CODE"), "CATEGORY", derive)
    return out.withColumn("CATEGORY_CODE", F.coalesce("_resolved", F.lit(""))).drop("_resolved")


def plain_key(c: Column) -> Column:
    """Letters and digits of the compatibility-decomposed, lower-cased text."""
    @F.pandas_udf("string")
    def decomposed(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKD")

    # Only texts outside ASCII need the Python step.
    foreign = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.regexp_replace(F.lower(F.coalesce(decomposed(foreign), c)), "[^a-z0-9]", "")


def path_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(tx.strip_ws(c), r"\s*[>/|\\]\s*", " / "))


def category_indexes(category_map: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes by path, by name, and by any name or path segment (first one wins)."""
    from listguard.sources.rules import cell

    rows = category_map.select("_pos", cell("name").alias("name"), cell("path").alias("path"),
                               tx.clean_code(cell("code")).alias("code")).where(r"code rlike '^\\d+$'")
    rows = rows.where(F.col("name").isNull() | (F.lower("name") != "none"))
    by_path = (rows.where("path IS NOT NULL").groupBy(path_key(F.col("path")).alias("key"))
               .agg(F.max_by("code", "_pos").alias("code")))
    by_name = (rows.where("name IS NOT NULL").groupBy(F.lower("name").alias("key"))
               .agg(F.max_by("code", "_pos").alias("code")))
    parts = F.concat(F.array(F.col("name")), F.coalesce(F.split("path", " / "), F.array().cast("array<string>")))
    by_part = (rows.select("_pos", "code", F.posexplode(parts).alias("_i", "part"))
               .select("_pos", "code", "_i", F.lower(tx.strip_ws(F.col("part"))).alias("key"))
               .where(~F.col("key").isin("", "nan", "none")).groupBy("key")
               .agg(F.min_by("code", F.struct("_pos", "_i")).alias("code"),
                    F.min(F.struct("_pos", "_i")).alias("first")))
    return by_path, by_name, by_part


def resolve_category(df: DataFrame, category_map: DataFrame) -> DataFrame:
    """Fill ``CATEGORY_CODE`` in three steps, keeping the existing value when all fail.

    1. the whole path; 2. segment names from the right; 3. segments from the right whose
    letters and digits contain, or are contained in, those of a known name: the longest such
    name of three characters or more wins.  Step 3 runs on distinct unresolved segments only
    and finds containing texts by three shared characters, so it needs no nested loop.
    """
    if "CATEGORY_CODE" not in df.columns:
        df = df.withColumn("CATEGORY_CODE", F.lit(""))
    by_path, by_name, by_part = category_indexes(category_map)

    def derive(values: DataFrame) -> DataFrame:
        raw = tx.strip_ws(F.col("CATEGORY"))
        known = values.where(~F.lower(raw).isin("", "nan", "none"))
        parts = (known.select("CATEGORY", "_n", raw.alias("_raw"))
                 .withColumn("_s", segments(F.col("_raw"), r"\s*[>/|\\]\s*"))
                 .withColumn("_key", path_key(F.col("_raw"))))
        stage1 = parts.join(small(by_path.select(F.col("key").alias("_key"), F.col("code").alias("_c1"))),
                            "_key", "left")
        names = (stage1.where("_c1 IS NULL").select("CATEGORY", F.posexplode("_s").alias("_i", "seg"))
                 .withColumn("key", F.lower("seg")).join(small(by_name), "key")
                 .groupBy("CATEGORY").agg(F.max_by("code", "_i").alias("_c2")))
        stage2 = stage1.join(names, "CATEGORY", "left")
        left = (stage2.where("_c1 IS NULL AND _c2 IS NULL")
                .select("CATEGORY", F.posexplode("_s").alias("_i", "seg"))
                .withColumn("sn", plain_key(F.col("seg"))).where("sn <> ''"))
        keys = (by_part.withColumn("kn", plain_key(F.col("key"))).where("length(kn) >= 3")
                .select("kn", "code", F.struct(F.length("kn").alias("a"), F.length("key").alias("b"),
                                               (-F.col("first._pos")).alias("c"),
                                               (-F.col("first._i")).alias("d")).alias("rank")))
        best = keys.groupBy("kn").agg(F.max_by("code", "rank").alias("code"), F.max("rank").alias("rank"))
        wanted = left.select("sn").distinct()
        inside = (kw.containing(wanted.select(F.col("sn").alias("text")), best, "kn")
                  .select(F.col("text").alias("sn"), "code", "rank"))
        around = (kw.containing(best.select("code", "rank", F.col("kn").alias("text")), wanted, "sn")
                  .select("sn", "code", "rank"))
        hits = inside.unionByName(around).groupBy("sn").agg(F.max_by("code", "rank").alias("code"))
        stage3 = (left.join(hits, "sn").groupBy("CATEGORY").agg(F.max_by("code", "_i").alias("_c3")))
        return stage2.join(stage3, "CATEGORY", "left").select(
            "CATEGORY", "_n", F.coalesce("_c1", "_c2", "_c3").alias("_resolved"))

    out = map_distinct(df, "CATEGORY", derive)
    kept = tx.strip_ws(tx.as_text(F.col("CATEGORY_CODE")))
    return out.withColumn("CATEGORY_CODE", F.coalesce("_resolved", kept)).drop("_resolved")


def unresolved_categories(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` distinct category texts without a numeric code."""
    return (df.where(~F.coalesce(F.col("CATEGORY_CODE").rlike(r"^\d+$"), F.lit(False))
                     & F.col("CATEGORY").isNotNull())
            .select("CATEGORY").distinct().orderBy("CATEGORY").limit(n))


# ---- column repair -------------------------------------------------------------------------

def blank_columns(df: DataFrame, columns: list[str]) -> set:
    """Columns that are absent or hold no value at all; one aggregate for all of them."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return set(columns)
    row = df.agg(*[F.count_if(~tx.is_blank(F.col(c))).alias(c) for c in have]).head()
    return {c for c in columns if c not in have or row[c] == 0}


def category_from_path(df: DataFrame) -> DataFrame:
    if "CATEGORY_PATH" not in df.columns:
        return df
    if "CATEGORY" not in df.columns:
        return df.withColumn("CATEGORY", F.col("CATEGORY_PATH"))
    return df.withColumn("CATEGORY", F.when(F.col("CATEGORY") == "", F.col("CATEGORY_PATH"))
                         .otherwise(F.col("CATEGORY")))


def build_variations(df: DataFrame, blank: set) -> DataFrame:
    """LIST_VARIATIONS as ``COLOR | SIZES`` where the file brings none."""
    if "LIST_VARIATIONS" not in blank:
        return df
    parts = [F.when(~tx.is_blank(F.col(c)), tx.strip_ws(F.col(c).cast("string")))
             for c in ("COLOR", "SIZES_AVAILABLE") if c in df.columns]
    if not parts:
        return df.withColumn("LIST_VARIATIONS", F.lit(""))
    joined = F.concat_ws(" | ", *parts)
    return df.withColumn("LIST_VARIATIONS", F.when(joined != "", joined))


def price_fallbacks(df: DataFrame, blank: set) -> DataFrame:
    """Sale price from the first price column there is, then from the page's price."""
    source = next((c for c in ("GLOBAL_SALE_PRICE", "GLOBAL_PRICE", "SALE_PRICE") if c in df.columns), None)
    if source is None:
        df = df.withColumn("GLOBAL_SALE_PRICE", F.lit(""))
    elif source != "GLOBAL_SALE_PRICE":
        df = df.withColumn("GLOBAL_SALE_PRICE", price_text(F.col(source)))
    if "PRICE" in df.columns:
        empty = tx.strip_ws(tx.as_text(F.col("GLOBAL_SALE_PRICE"))) == ""
        df = df.withColumn("GLOBAL_SALE_PRICE", F.when(empty, price_text(F.col("PRICE")))
                           .otherwise(F.col("GLOBAL_SALE_PRICE").cast("string")))
    if "GLOBAL_PRICE" in blank:
        df = df.withColumn("GLOBAL_PRICE", F.col("GLOBAL_SALE_PRICE"))
    return df


def official_store(df: DataFrame, blank: set, market: Market = DEFAULT_MARKET) -> DataFrame:
    if "TAGS" not in df.columns or "IS_OFFICIAL_STORE" not in blank:
        return df
    tagged = F.coalesce(F.col("TAGS").rlike(official_pattern(market.official_tag)), F.lit(False))
    return df.withColumn("IS_OFFICIAL_STORE", F.when(tagged, F.lit("Yes")).otherwise("No"))


def fill_discount(df: DataFrame) -> DataFrame:
    def column(c):
        return F.col(c) if c in df.columns else F.lit(None).cast("string")
    stated = column("DISCOUNT") if "DISCOUNT" in df.columns else F.lit("")
    return df.withColumn("DISCOUNT", discount_text(stated, column("GLOBAL_PRICE"), column("GLOBAL_SALE_PRICE")))


def color_from_title(df: DataFrame) -> DataFrame:
    """The colour named in the title replaces COLOR; without one COLOR becomes ``None``."""
    if "COLOR_IN_TITLE" not in df.columns:
        return df
    named = tx.strip_ws(tx.as_text(F.col("COLOR_IN_TITLE")))
    real = ~F.lower(named).isin("none") & ~named.isin("nan", "None", "")
    return df.withColumn("COLOR", F.when(real, named).otherwise("None"))


def advisory_flags(df: DataFrame) -> DataFrame:
    """Four advisory columns that do not change the verdict."""
    def number(c):
        return tx.num(F.col(c)) if c in df.columns else F.lit(None).cast("double")

    def text(c):
        return F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    both = {"BRAND", "NAME"} <= set(df.columns)
    # Parsed once here; the conditions below use each several times.
    parsed = df.withColumns({
        "_n_old": number("GLOBAL_PRICE"), "_n_sale": number("GLOBAL_SALE_PRICE"), "_n_rating": number("RATING"),
        "_n_reviews": number("REVIEW_COUNT"), "_n_stated": tx.num(F.replace(text("DISCOUNT"), F.lit("%"), F.lit(""))),
        "_t_brand": tx.lower_key(F.col("BRAND")) if both else F.lit(""),
        "_t_name": F.lower(tx.as_text(F.col("NAME"))) if both else F.lit("")})
    old, sale, brand = F.col("_n_old"), F.col("_n_sale"), F.col("_t_brand")
    corrupted = F.coalesce((old > 0) & (sale > 0) & (old > sale * 500), F.lit(False))
    computed = F.when((old > 0) & (sale < old), (old - sale) / old * 100)
    mismatch = F.coalesce(~corrupted & (F.abs(computed - F.col("_n_stated")) > 5), F.lit(False))
    times = (F.length("_t_name") - F.length(F.replace(F.col("_t_name"), brand, F.lit("")))) / F.length(brand)
    repeated = F.when(F.length(brand) > 0, times >= 2).otherwise(F.lit(False))
    reviews = F.col("_n_reviews")
    unreviewed = F.coalesce(F.col("_n_rating") > 0, F.lit(False)) & (reviews.isNull() | (reviews == 0))
    return parsed.select(*columns(df), corrupted.alias("_OLD_PRICE_CORRUPTED"), mismatch.alias("_DISCOUNT_MISMATCH"),
                         repeated.alias("_BRAND_IN_TITLE"), unreviewed.alias("_RATING_NO_REVIEWS"))


def advisory_breakdown(df: DataFrame) -> DataFrame:
    """Products per advisory flag, flags without any left out; one pass over the rows."""
    counts = df.agg(*[F.count_if(F.col(c)).alias(c) for c in ADVISORY])
    rows = F.array(*[F.struct(F.lit(title).alias("flag"), F.col(c).alias("n")) for c, title in ADVISORY.items()])
    return counts.select(F.inline(rows)).where("n > 0")


def repair(df: DataFrame, code: str, market: Market = DEFAULT_MARKET,
           category_map: DataFrame | None = None) -> DataFrame:
    """Everything between enrichment and the checks."""
    blank = blank_columns(df, ["LIST_VARIATIONS", "GLOBAL_PRICE", "IS_OFFICIAL_STORE"])
    df = category_from_path(df).withColumn("ACTIVE_STATUS_COUNTRY", F.lit(code))
    if category_map is not None and "CATEGORY" in df.columns:
        df = resolve_category(df, category_map)
    df = price_fallbacks(build_variations(df, blank), blank)
    for c in ("PARENTSKU", "NAME", "BRAND", "COLOR", "SELLER_NAME", "PRODUCT_WARRANTY",
              "WARRANTY_DURATION", "COUNT_VARIATIONS", "COLOR_FAMILY"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    df = fill_discount(official_store(df, blank, market))
    return advisory_flags(color_from_title(df))


# ---- audit checks --------------------------------------------------------------------------

def fake_discount_detail(df: DataFrame, times: float = 10.0) -> Column:
    """Detail where the old price is more than ``times`` the current one, else null."""
    if not {"GLOBAL_PRICE", "OLD_PRICE"} <= set(df.columns):
        return F.lit(None).cast("string")
    price, old = tx.num(F.col("GLOBAL_PRICE")), tx.num(F.col("OLD_PRICE"))
    return F.when((price > 0) & (old > price * times),
                  F.concat(F.lit("Old price "), F.format_number(old, 0), F.lit(" is "),
                           F.format_number(old / price, 0), F.lit("× current "), F.format_number(price, 0)))


def low_rating(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    r = tx.num(F.col("RATING"))
    return df.where(r < threshold).select(
        "PRODUCT_SET_SID", F.concat(F.lit("Rating "), F.bround(r, 1).cast("string"),
                                    F.lit(f" < {threshold}")).alias("DETAIL"))


def no_ratings(df: DataFrame) -> DataFrame:
    return df.where(tx.num(F.col("RATING")).isNull()).select(
        "PRODUCT_SET_SID", F.lit("No customer ratings").alias("DETAIL"))


def repeated_description(df: DataFrame, column: str = "DESCRIPTION", out: str = "_repeated",
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add a flag for a non-blank text that another row has too; texts meet by digest.

    Blank ones meet none and are spread by the product, or by all columns where there is none.
    """
    own = [F.col("PRODUCT_SET_SID")] if "PRODUCT_SET_SID" in df.columns else columns(df)
    filled = F.coalesce(tx.strip_ws(F.col(column)), F.lit("")) != ""
    keyed = df.withColumn("_digest", F.when(filled, F.sha2(F.col(column), 256)).otherwise(
        F.concat(F.lit("\u0001"), F.xxhash64(*own).cast("string"))))
    stats = keyed.where(~F.startswith("_digest", F.lit("\u0001"))).groupBy("_digest").agg(F.count("*").alias("_rep")).where("_rep > 1")
    joined = attach_some(keyed, stats, ["_digest"], own, "_rep", hot_rows)
    return joined.withColumn(out, F.col("_rep").isNotNull()).drop("_digest", "_rep")


# ---- lookup lines --------------------------------------------------------------------------

def lookup_inputs(lines: DataFrame, market: Market = DEFAULT_MARKET, pos: str = "_pos") -> DataFrame:
    """SKUs and addresses, one per line, as (input, sku, url, country_hint); first of a SKU wins."""
    text = tx.strip_ws(F.col("line"))
    rows = lines.select(pos, text.alias("input")).where("input <> ''")
    is_url = F.col("input").startswith("http")
    tail = last_slug(F.col("input"))
    digits = F.regexp_extract(tail, r"(\d{6,})$", 1)
    fallback = F.when(digits != "", digits).otherwise(tail)
    made = rows.select(
        pos, "input",
        F.when(is_url, F.coalesce(sku_from_url(F.col("input")), fallback))
        .otherwise(base_sku(F.col("input"))).alias("sku"),
        F.when(is_url, F.col("input")).alias("url"),
        F.when(is_url, country_from_url(F.col("input"), market.domains)).alias("country_hint"))
    return first_per_key(made.where("sku <> ''"), ["sku"], [pos]).drop(pos)


def one_page(pages: DataFrame, captured: str = "captured_at") -> DataFrame:
    """One page per SKU: the last captured where the pages tell, and of equals the last by content."""
    order = [F.desc(captured)] if captured in pages.columns else []
    return first_per_key(pages, ["sku"], [*order, *[F.desc(c) for c in sorted(pages.columns) if c != "sku"]])


def lookup_results(inputs: DataFrame, pages: DataFrame, default_country: str) -> DataFrame:
    """Lookup rows with what was found on the captured page of their SKU."""
    found = one_page(pages).withColumn("_found", F.lit(True))
    joined = inputs.join(found, "sku", "left")
    extra = [c for c in pages.columns if c != "sku"]
    return joined.select(
        F.col("sku").alias("PRODUCT_SET_SID"), F.col("input").alias("Input"),
        F.when(F.col("url").isNotNull(), "URL").otherwise("SKU").alias("Type"),
        F.coalesce("country_hint", F.lit(default_country)).alias("Country"),
        F.when(F.col("_found"), "Yes").otherwise("No").alias("Found"), *extra)


# ---- enrichment ----------------------------------------------------------------------------

# Fields a product page can fill; names of the SKU column, tried in this order.
PAGE_FIELDS = ["PRICE", "DISCOUNT", "STOCK_STATUS", "MODEL", "GTIN", "BRAND", "CATEGORY_PATH",
               "IS_OFFICIAL_STORE", "MAIN_IMAGE", "WEIGHT", "COLOR", "COLOR_IN_TITLE",
               "COUNT_VARIATIONS", "SIZES_AVAILABLE", "PRODUCT_WARRANTY", "WARRANTY_DURATION",
               "RATING", "REVIEW_COUNT", "SELLER_NAME", "DESCRIPTION", "KEY_FEATURES", "KEY_SPECS",
               "SPECIFICATIONS", "WHATS_IN_BOX"]
SKU_NAMES = ["PRODUCT_SET_SID", "SellerSku", "SELLER_SKU", "seller_sku", "SKU", "Sku", "sku"]


def empty_cell(c: Column) -> Column:
    return F.lower(F.coalesce(tx.strip_ws(c.cast("string")), F.lit(""))).isin("", "nan", "none")


def filled_shares(df: DataFrame, fields: list[str] = PAGE_FIELDS) -> DataFrame:
    """(field, filled, total) per field present, one pass."""
    have = [f for f in fields if f in df.columns]
    row = df.agg(F.count("*").alias("_t"), *[F.count_if(~tx.is_blank(F.col(f))).alias(f) for f in have])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.col("_t").alias("total"))
                     for f in have])
    return row.select(F.inline(rows))


def fields_to_fill(df: DataFrame, fields: list[str] = PAGE_FIELDS, share: float = 0.5) -> list[str]:
    """Fields that are absent or filled in less than ``share`` of the rows."""
    have = [f for f in fields if f in df.columns]
    if not have:
        return list(fields)
    filled = {r.field: r.filled / max(r.total, 1) for r in filled_shares(df, have).collect()}
    return [f for f in fields if f not in filled or filled[f] < share]


def enrich(df: DataFrame, pages: DataFrame, fields: list[str] | None = None,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fill empty cells of the needed fields from captured pages of the same base SKU.

    ``pages`` has any of the page fields by ``sku``; of several pages of a SKU the last one counts.
    """
    from listguard.operators.ingest import pick_column

    needed = fields_to_fill(df) if fields is None else fields
    sku = pick_column(df.columns, SKU_NAMES)
    if not needed or sku is None:
        return df
    df = df.withColumns({f: F.lit("") for f in needed if f not in df.columns})
    have = [f for f in needed if f in pages.columns]
    source = one_page(pages).select(F.col("sku").alias("_base"), *[F.col(f).alias(f"_page_{f}") for f in have])
    keyed = df.withColumn("_base", F.coalesce(base_sku(F.col(sku)), F.lit("")))
    # The size of each base SKU tells which ones are hot; only those present on a page matter.
    sizes = keyed.groupBy("_base").agg(F.count("*").alias("_n"))
    joined = attach_group(keyed, source.join(sizes, "_base"), ["_base"], [sku], "_n", hot_rows)
    return joined.withColumns({f: F.when(empty_cell(F.col(f)), F.coalesce(F.col(f"_page_{f}"), F.col(f)))
                               .otherwise(F.col(f)) for f in have}).select(*columns(df))


def fill_images(df: DataFrame, enriched: DataFrame) -> DataFrame:
    """MAIN_IMAGE from the enriched rows when the listing column is wholly blank."""
    if "MAIN_IMAGE" not in blank_columns(df, ["MAIN_IMAGE"]):
        return df
    if "MAIN_IMAGE" not in df.columns:
        df = df.withColumn("MAIN_IMAGE", F.lit(""))
    images = first_per_key(enriched.select("PRODUCT_SET_SID", F.col("MAIN_IMAGE").alias("_img")),
                           ["PRODUCT_SET_SID"], [F.desc("_img")])
    image = F.when(tx.is_blank(F.col("_img")), F.lit("")).otherwise(tx.strip_ws(F.col("_img")))
    return (df.join(images, "PRODUCT_SET_SID", "left")
            .withColumn("MAIN_IMAGE", F.when(F.col("_img").isNotNull(), image).otherwise(F.col("MAIN_IMAGE")))
            .select(*columns(df)))


def image_warnings(width: Column, height: Column) -> Column:
    ratio = F.when(width > 0, height / width).otherwise(F.lit(1.0))
    shape = F.when(ratio > 1.5, F.lit("Tall (Screenshot?)")).when(ratio < 0.6, F.lit("Wide Aspect"))
    return F.array_compact(F.array(F.when((width < 300) | (height < 300), F.lit("Low Resolution")), shape))


def image_quality(spark, path: str) -> DataFrame:
    """Warnings per stored image file."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.col("image.origin").alias("origin"), F.col("image.width").alias("width"),
                         F.col("image.height").alias("height"),
                         image_warnings(F.col("image.width"), F.col("image.height")).alias("warnings"))
