"""From raw listing rows to one prepared row per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listguard.functions import text as tx
from listguard.market import COUNTRIES, DEFAULT_MARKET, MULTI_COUNTRY, Market
from listguard.operators.skew import HOT_ROWS, attach_group, fill_within, first_per_key

# Accepted names of the listing columns, in lower case.
LISTING_ALIASES = {
    "cod_productset_sid": "PRODUCT_SET_SID", "dsc_name": "NAME", "dsc_brand_name": "BRAND",
    "cod_category_code": "CATEGORY_CODE", "dsc_category_name": "CATEGORY",
    "dsc_shop_seller_name": "SELLER_NAME", "dsc_shop_active_country": "ACTIVE_STATUS_COUNTRY",
    "cod_parent_sku": "PARENTSKU", "color": "COLOR", "colour": "COLOR",
    "color_family": "COLOR_FAMILY", "colour_family": "COLOR_FAMILY",
    "colour family": "COLOR_FAMILY", "color family": "COLOR_FAMILY",
    "list_seller_skus": "SELLER_SKU", "image1": "MAIN_IMAGE", "image_1": "MAIN_IMAGE",
    "main_image": "MAIN_IMAGE", "main image": "MAIN_IMAGE", "image": "MAIN_IMAGE",
    "img": "MAIN_IMAGE", "img_url": "MAIN_IMAGE", "image_url": "MAIN_IMAGE", "photo": "MAIN_IMAGE",
    "dsc_status": "LISTING_STATUS", "dsc_shop_email": "SELLER_EMAIL",
    "product_warranty": "PRODUCT_WARRANTY", "warranty_duration": "WARRANTY_DURATION",
    "warranty_address": "WARRANTY_ADDRESS", "warranty_type": "WARRANTY_TYPE",
    "count_variations": "COUNT_VARIATIONS", "count variations": "COUNT_VARIATIONS",
    "number of variations": "COUNT_VARIATIONS", "list_variations": "LIST_VARIATIONS",
    "list variations": "LIST_VARIATIONS",
}

# Accepted names of the audit columns, in lower case.  A header that ends in
# "express" names the express-delivery column whatever word stands before it.
AUDIT_ALIASES = {
    "sku": "PRODUCT_SET_SID", "name": "NAME", "brand": "BRAND", "category": "CATEGORY",
    "categories": "CATEGORY", "price": "GLOBAL_SALE_PRICE", "newprice": "GLOBAL_SALE_PRICE",
    "old price": "GLOBAL_PRICE", "oldprice": "GLOBAL_PRICE", "seller": "SELLER_NAME",
    "sellername": "SELLER_NAME", "seller name": "SELLER_NAME", "image url": "MAIN_IMAGE",
    "image": "MAIN_IMAGE", "main image": "MAIN_IMAGE", "url": "PRODUCT_URL",
    "product url": "PRODUCT_URL", "stock": "STOCK_STATUS", "stock status": "STOCK_STATUS",
    "rating": "RATING", "averagerating": "RATING", "average rating": "RATING",
    "total ratings": "REVIEW_COUNT", "totalratings": "REVIEW_COUNT",
    "review count": "REVIEW_COUNT", "discount": "DISCOUNT", "tags": "TAGS",
    "isexpress": "EXPRESS", "shop global": "SHOP_GLOBAL", "isglobal": "SHOP_GLOBAL",
    "color": "COLOR", "colour": "COLOR", "product warranty": "PRODUCT_WARRANTY",
    "warranty": "PRODUCT_WARRANTY", "warranty duration": "WARRANTY_DURATION",
    "count variations": "COUNT_VARIATIONS", "variations": "COUNT_VARIATIONS",
    "seller sku": "SELLER_SKU", "parentsku": "PARENTSKU", "parent sku": "PARENTSKU",
    "description": "DESCRIPTION",
}

# Names used by the scored report's input.
REPORT_ALIASES = {
    "SKU": "PRODUCT_SET_SID", "Name": "NAME", "Brand": "BRAND", "Category": "CATEGORY",
    "Price": "GLOBAL_PRICE", "Old Price": "OLD_PRICE", "Seller": "SELLER_NAME",
    "Image URL": "MAIN_IMAGE", "Product URL": "PRODUCT_URL", "Rating": "RATING",
    "Total Ratings": "TOTAL_RATINGS", "Discount": "DISCOUNT", "Stock": "STOCK",
    "Stock Status": "STOCK_STATUS",
}

# Columns that mark a published-listing file; columns every listing file needs;
# columns spread over the rows of one product.
AUDIT_SIGNATURE = {"sku", "name", "brand", "category", "price", "seller"}
REQUIRED = ["PRODUCT_SET_SID", "NAME", "BRAND", "CATEGORY_CODE", "ACTIVE_STATUS_COUNTRY"]
SPREAD_COLUMNS = ["COLOR_FAMILY", "PRODUCT_WARRANTY", "WARRANTY_DURATION", "WARRANTY_ADDRESS",
                  "WARRANTY_TYPE", "COUNT_VARIATIONS", "LIST_VARIATIONS"]


def file_kind(columns: list[str]) -> str:
    lowered = {c.strip().lower() for c in columns}
    return "post_qc" if AUDIT_SIGNATURE <= lowered else "pre_qc"


def schema_errors(columns: list[str]) -> list[str]:
    return [f"Missing: {c}" for c in REQUIRED if c not in columns]


def pick_column(columns: list[str], names: list[str]) -> str | None:
    """First of ``names`` that is a column."""
    return next((n for n in names if n in columns), None)


def _rename(df: DataFrame, target) -> DataFrame:
    """Rename every column by ``target(name)``; columns meeting in one name are coalesced."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(target(c.strip()), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cols]).alias(name) if len(cols) > 1
                       else F.col(f"`{cols[0]}`").alias(name) for name, cols in groups.items()])


def standardise_listings(df: DataFrame) -> DataFrame:
    out = _rename(df, lambda c: c if c.startswith("_") else LISTING_ALIASES.get(c.lower(), c.upper()))
    return out if "MAIN_IMAGE" in out.columns else out.withColumn("MAIN_IMAGE", F.lit(""))


def standardise_audit(df: DataFrame) -> DataFrame:
    def target(c: str) -> str:
        low = c.lower().strip()
        return AUDIT_ALIASES.get(low, "EXPRESS" if low.endswith(" express") else c)
    return _rename(df, target)


def standardise_report_input(df: DataFrame) -> DataFrame:
    """Column names and defaults of the scored report."""
    out = _rename(df, lambda c: REPORT_ALIASES.get(c, c))
    have = set(out.columns)
    defaults = {
        "ACTIVE_STATUS_COUNTRY": F.col("ACTIVE_STATUS_COUNTRY") if "ACTIVE_STATUS_COUNTRY" in have
        else F.lit("UNKNOWN"),
        "_IS_MULTI_COUNTRY": F.lit(False),
        "PARENTSKU": F.col("PRODUCT_SET_SID"),
        "COLOR": F.col("COLOR") if "COLOR" in have else F.lit(""),
        "COLOR_FAMILY": F.lit(""),
        "GLOBAL_SALE_PRICE": F.col("GLOBAL_PRICE") if "GLOBAL_PRICE" in have else F.lit(""),
        "COUNT_VARIATIONS": F.col("COUNT_VARIATIONS") if "COUNT_VARIATIONS" in have else F.lit("1"),
    }
    return out.withColumns(defaults)


def fix_encoding_artifacts(df: DataFrame, cols=("NAME", "PARENTSKU")) -> DataFrame:
    return df.withColumns({c: tx.fix_mojibake(F.col(c)) for c in cols if c in df.columns})


# Windows-1252 where it differs from Latin-1: its characters and their bytes, read as Latin-1.
_WINDOWS = {bytes([b]).decode("cp1252", "ignore"): chr(b) for b in range(0x80, 0xA0)}
_WINDOWS.pop("")
_TO, _FROM = "".join(_WINDOWS.values()), "".join(_WINDOWS)


def repair_encoding(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Undo UTF-8 text that was read as Windows-1252 or Latin-1, and drop control characters.

    A text is repaired if each of its characters is one of the charset's and their bytes are valid UTF-8 that
    reads otherwise; Windows-1252 comes first. Built-in functions throughout.
    """
    def reread(c: Column, foreign: str, single: Column) -> Column:
        # Characters beyond the charset are ruled out before any byte is made.
        read = F.when(~c.rlike(foreign), F.encode(single, "ISO-8859-1")).cast("string")
        return F.when(F.is_valid_utf8(read) & (read != c) & ~F.contains(read, F.lit("\ufffd")), read)

    def repaired(c: Column) -> Column:
        windows = reread(c, rf"[^\x00-\x7F\xA0-\xFF{_FROM}]", F.translate(c, _FROM, _TO))
        return F.coalesce(windows, reread(c, r"[^\x00-\xFF]", c), c)

    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    # One expression for all columns: written out for each, the code of many would pass what the JVM compiles.
    all_texts = F.transform(F.array(*[F.col(f"`{c}`") for c in names]), lambda c: tx.drop_control(
        F.when(c.rlike(r"[^\x00-\x7F]"), repaired(c)).otherwise(c)))
    return df.withColumn("_texts", all_texts).withColumns(
        {c: F.get("_texts", F.lit(i)) for i, c in enumerate(names)}).drop("_texts")


def country_value(market: Market = DEFAULT_MARKET):
    c = F.upper(tx.strip_ws(tx.as_text(F.col("ACTIVE_STATUS_COUNTRY"))))
    return F.regexp_replace(c, "^" + tx.quote(market.shop_prefix.upper()), "")


def with_country(df: DataFrame, code: str, market: Market = DEFAULT_MARKET) -> DataFrame:
    """Rows with their plain country, ``_IS_MULTI_COUNTRY``, and ``_kept`` for those of one country."""
    df = df.withColumn("ACTIVE_STATUS_COUNTRY", country_value(market))
    c = F.col("ACTIVE_STATUS_COUNTRY")
    multi = c.isin(*MULTI_COUNTRY) if code == "NG" else F.lit(False)
    return df.withColumn("_IS_MULTI_COUNTRY", multi).withColumn("_kept", (c == code) | F.col("_IS_MULTI_COUNTRY"))


def filter_country(df: DataFrame, code: str, market: Market = DEFAULT_MARKET) -> DataFrame:
    """Rows of one country; Nigeria also keeps rows listed in several countries."""
    return with_country(df, code, market).where("_kept").drop("_kept")


def detected_countries(df: DataFrame, market: Market = DEFAULT_MARKET) -> DataFrame:
    c = F.col("code")
    named = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in COUNTRIES.items()],
                       F.concat(F.lit("'"), c, F.lit("'")))
    return (df.select(country_value(market).alias("code")).distinct()
            .where((tx.strip_ws(c) != "") & (F.lower(tx.strip_ws(c)) != "nan"))
            .select(named.alias("country")))


def propagate_metadata(df: DataFrame, pos: str = "_pos", block: str | None = None,
                       **kwargs) -> DataFrame:
    """Fill seven descriptive columns over the rows of a product, forward then backward."""
    absent = {c: F.lit(None).cast("string") for c in SPREAD_COLUMNS if c not in df.columns}
    return fill_within(df.withColumns(absent), "PRODUCT_SET_SID", pos, SPREAD_COLUMNS, block, **kwargs)


def first_rows(df: DataFrame, pos: str = "_pos") -> DataFrame:
    return first_per_key(df, ["PRODUCT_SET_SID"], [pos])


def variation_count(df: DataFrame) -> DataFrame:
    """Rows per product; counted on its own so that only two columns are read."""
    return df.groupBy("PRODUCT_SET_SID").agg(F.count("*").alias("_rows"))


def prepare(df: DataFrame, code: str | None, market: Market = DEFAULT_MARKET, pos: str = "_pos",
            hot_rows: int = HOT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """First row of every product of one country (all when ``code`` is None), its gaps filled, its rows counted.

    Only first rows leave, so nothing is filled but them: a gap takes the last value known before the row, in
    any country, else the first one after it. Each is an aggregate with map-side combining, so a product of
    very many rows costs its task no more than its parts' results. Of the columns, only those in ``columns`` travel
    and leave, all by default; of rows of other countries only known values that may fill a gap do.
    """
    errors = schema_errors(df.columns)
    if errors:
        raise ValueError("; ".join(errors))
    absent = {c: F.lit(None).cast("string") for c in SPREAD_COLUMNS if c not in df.columns}
    df = df.withColumn("PRODUCT_SET_SID", tx.strip_ws(tx.as_text(F.col("PRODUCT_SET_SID")))).withColumns(absent)
    names = [c for c in [*df.columns, "_IS_MULTI_COUNTRY"] if columns is None or c in columns]
    spread = [c for c in SPREAD_COLUMNS if c in names]
    others = [c for c in names if c != "PRODUCT_SET_SID" and c not in spread]
    known = {c: F.col(c).isNotNull() for c in spread}
    if code is None:
        rows = df.withColumn("_IS_MULTI_COUNTRY", F.lit(False))
        first, count = F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), pos) if others else F.lit(None), F.count("*")
        filled = {c: F.min_by(c, F.when(known[c], F.col(pos))) for c in spread}
    else:
        rows = with_country(df, code, market)
        kept = F.col("_kept")
        starts = rows.groupBy("PRODUCT_SET_SID").agg(
            F.min(F.when(kept, F.col(pos))).alias("_start"), F.count_if("_kept").alias("_rows"), F.count("*").alias("_n")
        ).where("_start IS NOT NULL")
        useful = kept
        for c in spread:
            useful = useful | known[c]
        own = F.when(kept, F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit(None)
        rows = rows.where(useful).select("PRODUCT_SET_SID", F.col(pos).alias("_at"), "_kept", own.alias("_own"), *spread)
        rows = attach_group(rows, starts, ["PRODUCT_SET_SID"], ["_at"], "_n", hot_rows).where("_start IS NOT NULL")
        first = F.min_by("_own", F.when(kept, F.col("_at")))
        count, at, start = F.any_value("_rows"), F.col("_at"), F.col("_start")
        filled = {c: F.coalesce(F.max_by(c, F.when(known[c] & (at <= start), at)),
                                F.min_by(c, F.when(known[c] & (at > start), at))) for c in spread}
    found = rows.groupBy("PRODUCT_SET_SID").agg(first.alias("_first"), count.alias("_rows"),
                                                *[v.alias(f"_fill_{c}") for c, v in filled.items()])
    value = {c: F.col(f"_fill_{c}") for c in spread}
    if "COUNT_VARIATIONS" in value:
        stated = F.coalesce(tx.num(value["COUNT_VARIATIONS"]), F.lit(1.0))
        value["COUNT_VARIATIONS"] = F.greatest(F.col("_rows").cast("double"), stated)
    value["PRODUCT_SET_SID"] = F.col("PRODUCT_SET_SID")
    return found.select(*[(value[c] if c in value else F.col("_first").getField(c)).alias(c) for c in names])


def common_products(df: DataFrame, file_col: str = "_file") -> DataFrame:
    """Products that occur in every input file; none when there is only one file."""
    pairs = df.select("PRODUCT_SET_SID", file_col).distinct()
    total = pairs.agg(F.countDistinct(file_col).alias("_files"))
    return (pairs.groupBy("PRODUCT_SET_SID").agg(F.count("*").alias("_n"))
            .join(F.broadcast(total), (F.col("_n") == F.col("_files")) & (F.col("_files") > 1))
            .select("PRODUCT_SET_SID"))
