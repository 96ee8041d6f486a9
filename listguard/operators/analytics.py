"""Weekly rejection analytics and validation KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.operators.ingest import pick_column
from listguard.operators.skew import number_rows

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Accepted names of the weekly columns, tried in this order.
STATUS_NAMES = ["Status", "STATUS", "status", "LISTING_STATUS"]
SELLER_NAMES = ["SellerName", "SELLER_NAME", "seller_name", "Seller"]
FLAG_NAMES = ["FLAG", "Flag", "flag", "Reason"]
CATEGORY_NAMES = ["CATEGORY", "Category", "category"]


def choose_columns(df: DataFrame) -> DataFrame:
    """Weekly rows under the fixed names status, seller, flag, category."""
    chosen = {"status": STATUS_NAMES, "seller": SELLER_NAMES, "flag": FLAG_NAMES, "category": CATEGORY_NAMES}
    cols = []
    for name, names in chosen.items():
        have = pick_column(df.columns, names)
        cols.append((F.col(have) if have else F.lit(None).cast("string")).alias(name))
    return df.select("Date", "Day", *[c for c in ["Country"] if c in df.columns], *cols)


def statuses(df: DataFrame) -> list[str]:
    """Status values in use, one column each in the daily summary."""
    return sorted(r.status for r in df.select("status").where("status IS NOT NULL").distinct().collect())


def day_number(day: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DAYS]), day)


def daily_summary(df: DataFrame, values: list[str] | None = None, total: bool = True) -> DataFrame:
    """Day by status counts for seven days in order, a daily total and a weekly total row."""
    values = values or statuses(df)
    counts = df.where(F.col("status").isNotNull()).groupBy("Day").agg(
        *[F.count_if(F.col("status") == v).alias(v) for v in values])
    calendar = df.sparkSession.createDataFrame([(d, i + 1) for i, d in enumerate(DAYS)], "Day string, day_no int")
    days = calendar.join(counts, "Day", "left").select(
        "Day", "day_no", *[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(v) for v in values])
    days = days.withColumn("Daily Total", sum((F.col(v) for v in values), F.lit(0).cast("bigint")))
    if not total:
        return days
    numbers = [*values, "Daily Total"]
    # The seven rows are counted once: each enters its own day and the week's total.
    own = F.struct("Day", "day_no", *numbers)
    week = F.struct(F.lit("Weekly Total").alias("Day"), F.lit(8).alias("day_no"), *numbers)
    return (days.select(F.inline(F.array(own, week))).groupBy("Day", "day_no")
            .agg(*[F.sum(c).alias(c) for c in numbers]))


def weekly_totals(df: DataFrame) -> DataFrame:
    """Approved, rejected and all rows of known days, and the rejection rate in percent."""
    counted = df.where(F.col("status").isNotNull() & F.col("Day").isin(*DAYS)).agg(
        F.count_if(F.col("status") == "Approved").alias("approved"),
        F.count_if(F.col("status") == "Rejected").alias("rejected"), F.count("*").alias("total"))
    rate = F.when(F.col("total") > 0, F.col("rejected") / F.col("total") * 100).otherwise(F.lit(0.0))
    return counted.withColumn("rejection_rate", rate)


def health(rate: Column) -> Column:
    return F.when(rate > 20, F.lit("Action Required")).when(rate > 0, F.lit("Healthy Quality"))


def seller_stats(df: DataFrame, values: list[str] | None = None) -> DataFrame:
    values = values or statuses(df)
    counts = df.where(F.col("seller").isNotNull() & F.col("status").isNotNull()).groupBy("seller").agg(
        *[F.count_if(F.col("status") == v).alias(v) for v in values],
        F.count("*").alias("Total Submitted"))
    if "Rejected" not in values:
        counts = counts.withColumn("Rejected", F.lit(0).cast("bigint"))
    rate = F.bround(F.col("Rejected") / F.col("Total Submitted") * 100, 1)
    return counts.withColumn("Rejection Rate (%)", rate)


def daily_trend(df: DataFrame) -> DataFrame:
    return (df.where(F.col("status").isNotNull()).groupBy("Date", "status")
            .agg(F.count("*").alias("Count")))


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "Rejected")


def value_counts(df: DataFrame, column: str, name: str, count: str = "Rejected Count") -> DataFrame:
    """Counts of the rejected rows per value, missing values left out."""
    return (rejected(df).where(F.col(column).isNotNull()).groupBy(F.col(column).alias(name))
            .agg(F.count("*").alias(count)))


def top_values(df: DataFrame, column: str, name: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values among rejections; equal counts by name."""
    return value_counts(df, column, name).orderBy(F.desc("Rejected Count"), name).limit(n)


def top_reason(df: DataFrame) -> DataFrame:
    """Leading reason, its count and its share of all rejections in percent."""
    top = top_values(df, "flag", "reason", 1)
    total = rejected(df).agg(F.count("*").alias("all_rejected"))
    return top.join(F.broadcast(total)).select(
        "reason", F.col("Rejected Count").alias("n"),
        (F.col("Rejected Count") / F.col("all_rejected") * 100).alias("share"))


def worst_seller(df: DataFrame) -> DataFrame:
    best = value_counts(df, "seller", "seller", "rejections").orderBy(F.desc("rejections"), "seller").limit(1)
    return best.where("rejections > 0")


def busiest_day(df: DataFrame) -> DataFrame:
    days = daily_summary(df, total=False)
    return (days.agg(F.max_by("Day", F.struct(F.col("Daily Total"), -F.col("day_no"))).alias("Day"),
                     F.max("Daily Total").alias("total")).where("total > 0"))


def top_sellers(df: DataFrame, n: int = 5) -> DataFrame:
    stats = seller_stats(df)
    return (stats.select("seller", "Rejected", "Rejection Rate (%)")
            .orderBy(F.desc("Rejected"), "seller").limit(n))


def explore(df: DataFrame, status: list[str] | None = None, seller: str | None = None) -> DataFrame:
    if status:
        df = df.where(F.col("status").isin(*status))
    if seller:
        df = df.where(F.contains(F.lower("seller"), F.lit(seller.lower())))
    return df


def report_metadata(df: DataFrame, country: str, week: str, files: int, generated: str) -> DataFrame:
    """Eight metric rows of the weekly cover sheet."""
    t = weekly_totals(df)
    rate = F.concat(F.format_number("rejection_rate", 1), F.lit("%"))
    pairs = [("Report Generated On", F.lit(generated)), ("Country / Region", F.lit(country)),
             ("Reporting Week", F.lit(f"Week {week}")), ("Total Files/Parts Merged", F.lit(str(files))),
             ("Total Products Processed", F.col("total").cast("string")),
             ("Total Approved", F.col("approved").cast("string")),
             ("Total Rejected", F.col("rejected").cast("string")), ("Overall Rejection Rate", rate)]
    rows = F.array(*[F.struct(F.lit(k).alias("Metric"), v.alias("Value")) for k, v in pairs])
    return t.select(F.inline(rows))


# ---- validation KPIs -----------------------------------------------------------------------

def validation_kpis(verdicts: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """Totals and rejection rate; the number of multi-country products where known."""
    k = verdicts.agg(F.count("*").alias("total"),
                     F.count_if(F.col("Status") == "Approved").alias("approved"),
                     F.count_if(F.col("Status") == "Rejected").alias("rejected"))
    k = k.withColumn("rejection_rate", F.when(F.col("total") > 0, F.col("rejected") / F.col("total") * 100)
                     .otherwise(F.lit(0.0)))
    if listings is not None:
        multi = listings.agg(F.count_if("_IS_MULTI_COUNTRY").alias("multi_country"))
        k = k.join(F.broadcast(multi))
    return k


def flag_counts(verdicts: DataFrame) -> DataFrame:
    return (verdicts.where(F.col("Status") == "Rejected").groupBy("FLAG").agg(F.count("*").alias("n")))


def top_flag(verdicts: DataFrame) -> DataFrame:
    return flag_counts(verdicts).orderBy(F.desc("n"), "FLAG").limit(1)


def seller_summary(verdicts: DataFrame) -> DataFrame:
    """Rejected and approved per seller, most rejections first, numbered 1..n; ties by name."""
    counts = verdicts.where(F.col("SellerName").isNotNull()).groupBy(F.col("SellerName").alias("SELLER_NAME")).agg(
        F.count_if(F.col("Status") == "Rejected").alias("Rejected"),
        F.count_if(F.col("Status") == "Approved").alias("Approved"))
    ordered = F.struct((-F.col("Rejected")).alias("a"), F.col("SELLER_NAME").alias("b"))
    return number_rows(counts, ordered, "SELLER_NAME", "Rank").select(
        F.col("Rank").cast("int").alias("Rank"), "SELLER_NAME", "Rejected", "Approved")


def filled_counts(df: DataFrame, fields: list[str], name: str) -> DataFrame:
    """(field, filled cells) for every field, in one pass."""
    from listguard.functions.text import is_blank
    counted = df.agg(*[(F.count_if(~is_blank(F.col(f))) if f in df.columns else F.max(F.lit(0).cast("bigint")))
                       .alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(0)).alias(name)) for f in fields])
    return counted.select(F.inline(rows))


def enrichment_summary(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    joined = filled_counts(before, fields, "before").join(filled_counts(after, fields, "after"), "field")
    return joined.withColumn("filled", F.greatest(F.lit(0).cast("bigint"), F.col("after") - F.col("before")))


def enrichment_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count_if(F.col("filled") > 0).alias("fields_enriched"),
                       F.sum("filled").alias("cells_filled"))


def resolved_codes(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("CATEGORY_CODE").rlike(r"^\d+$")).alias("resolved"))
