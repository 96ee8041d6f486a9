"""Filters and pages of the review screens, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.functions import text as tx
from listguard.operators.skew import small
from listguard.session import stage

# Columns of the review grid and of the full export.
GRID_COLUMNS = ["PRODUCT_SET_SID", "NAME", "BRAND", "CATEGORY", "SELLER_NAME", "MAIN_IMAGE",
                "GLOBAL_SALE_PRICE", "GLOBAL_PRICE", "COLOR"]


def _has(c: Column, term: str) -> Column:
    return F.contains(F.lower(tx.as_text(c)), F.lit(term.lower()))


def category_paths(df: DataFrame, paths: DataFrame, keep_code: bool = True) -> DataFrame:
    """CATEGORY as the full path of the code; the code itself where it is unknown."""
    code = tx.strip_ws(F.col("CATEGORY_CODE"))
    known = small(paths.select(F.col("code").alias("_pc"), F.col("path").alias("_pp")))
    unknown = F.coalesce(code, F.lit("")) if keep_code else F.col("CATEGORY")
    return (df.join(known, code == F.col("_pc"), "left")
            .withColumn("CATEGORY", F.coalesce("_pp", unknown)).drop("_pc", "_pp"))


def review_rows(verdicts: DataFrame, listings: DataFrame, just_rejected: DataFrame | None = None,
                paths: DataFrame | None = None, name: str | None = None,
                seller_or_category: str | None = None) -> DataFrame:
    """Approved products and those just rejected, searched by name, seller or category."""
    keep = F.col("Status") == "Approved"
    v = verdicts
    if just_rejected is not None:
        ids = just_rejected.select(F.col("sid").alias("ProductSetSid")).distinct().withColumn("_j", F.lit(True))
        v = v.join(ids, "ProductSetSid", "left")
        keep = keep | F.coalesce("_j", F.lit(False))
    chosen = v.where(keep).select(F.col("ProductSetSid").alias("PRODUCT_SET_SID"))
    have = [c for c in [*GRID_COLUMNS, "CATEGORY_CODE"] if c in listings.columns]
    rows = chosen.join(listings.select(*have), "PRODUCT_SET_SID", "left")
    if paths is not None and "CATEGORY_CODE" in have:
        rows = category_paths(rows, paths)
    if name:
        rows = rows.where(_has(F.col("NAME"), name))
    if seller_or_category:
        cond = _has(F.col("SELLER_NAME"), seller_or_category)
        if "CATEGORY" in rows.columns:
            cond = cond | _has(F.col("CATEGORY"), seller_or_category)
        rows = rows.where(cond)
    return rows


def search_rows(df: DataFrame, term: str | None = None, sellers: list[str] | None = None) -> DataFrame:
    """Rows with ``term`` in any column, of the given sellers."""
    if term:
        cond = F.lit(False)
        for c in df.columns:
            cond = cond | _has(F.col(f"`{c}`"), term)
        df = df.where(cond)
    if sellers:
        df = df.where(F.col("SELLER_NAME").isin(*sellers))
    return df


class Pages:
    """Rows in order, dealt to ranges and written once with their place, so that any page is a read of its few rows.

    One row per range (at most as many as shuffle partitions) tells how many rows it holds; with these a page finds its
    ranges and places, and the scan skips all others by the file's statistics.
    """

    def __init__(self, df: DataFrame, order: list) -> None:
        at = F.monotonically_increasing_id()
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        self.columns = df.columns
        self.rows = stage(ranged.withColumn("_range", F.shiftright(at, 33)).withColumn("_place", at.bitwiseAND((1 << 33) - 1)), "pages")
        self.held = sorted((r["_range"], r["n"]) for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect())

    def page(self, number: int, size: int = 40) -> DataFrame:
        """Rows of page ``number`` (from 0), in order; none beyond the last."""
        low, before, wanted = number * size, 0, F.lit(False)
        for part, n in self.held:
            first, last = max(low - before, 0), min(low + size - before, n)
            if first < last:
                wanted = wanted | ((F.col("_range") == part) & (F.col("_place") >= first) & (F.col("_place") < last))
            before += n
        return self.rows.where(wanted).orderBy("_range", "_place").select(*[F.col(f"`{c}`") for c in self.columns])


def page(df: DataFrame, order: list, number: int, size: int = 40) -> DataFrame:
    """Rows of page ``number`` (from 0). For several pages of a table, build ``Pages`` once."""
    return Pages(df, order).page(number, size)


def page_count(df: DataFrame, size: int = 40) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("bigint").alias("pages"))
