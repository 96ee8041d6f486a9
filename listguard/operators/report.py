"""The scored quality report; issues of a product stay in one array on its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.functions import text as tx
from listguard.operators import keywords as kw
from listguard.operators.audit import fake_discount_detail, repeated_description
from listguard.operators.checks import run_checks, unnecessary_detail
from listguard.operators.skew import columns, exploded
from listguard.sources.rules import FLAGS, RuleBook

# Weight of an issue by severity, in report order.
WEIGHTS = {"critical": 25, "high": 12, "medium": 6, "low": 2}
SEVERITIES = list(WEIGHTS)

# Report columns that hold YES or NO.
YES_NO = ["Few Images (<5)", "Non-White Background", "Low Resolution Images", "Empty Description",
          "Thin Description", "Muddled Description", "Repeated Description", "Missing Images in Desc",
          "Naming Issue", "Wrong Category", "Prohibited Item", "Blacklisted Keyword", "Restricted Brand",
          "NG Seller Restriction", "Counterfeit Flag", "Suspicious Price"]
BREAKDOWN = ["Prohibited Item", "Counterfeit Flag", "Wrong Category", "Blacklisted Keyword",
             "Restricted Brand", "NG Seller Restriction", "Suspicious Price", "Naming Issue",
             "Few Images (<5)", "Missing Images in Desc", "Empty Description", "Thin Description",
             "Repeated Description"]

# Fixed values: (listing flag, severity, report flag, message when the check gives none), in the
# order in which the report collects issues.  A number takes the place of a non-listing check.
REGISTRATIONS = [
    ("Prohibited products", "critical", "Prohibited Item", None),
    ("Counterfeit Sneakers", "critical", "Counterfeit Flag", "Counterfeit sneaker detected"),
    ("Suspected counterfeit Jerseys", "critical", "Counterfeit Flag", "Counterfeit jersey detected"),
    ("Suspected Fake product", "critical", "Counterfeit Flag", "Suspected counterfeit (price)"),
    ("Wrong Category", "high", "Wrong Category", None),
    ("Restricted brands", "high", "Restricted Brand", None),
    ("#blacklist", "high", "Blacklisted Keyword", None),
    ("Suspected Fake product", "high", "Suspicious Price", "Price below threshold for brand/category"),
    ("NG - Gift Card Seller", "high", "NG Seller Restriction", None),
    ("NG - Books Seller", "high", "NG Seller Restriction", None),
    ("NG - TV Brand Seller", "high", "NG Seller Restriction", None),
    ("NG - HP Toners Seller", "high", "NG Seller Restriction", None),
    ("NG - Apple Seller", "high", "NG Seller Restriction", None),
    ("NG - Xmas Tree Seller", "high", "NG Seller Restriction", None),
    ("Unnecessary words in NAME", "medium", "Naming Issue", "Unnecessary words in product name"),
    ("Single-word NAME", "medium", "Naming Issue", "Product name is a single word"),
    ("BRAND name repeated in NAME", "medium", "Naming Issue", "Brand name repeated in product name"),
    ("Generic BRAND Issues", "medium", "Naming Issue", "Generic brand used in wrong category"),
    ("Fashion brand issues", "medium", "Naming Issue", "Fashion brand used outside fashion category"),
    ("Generic branded products with genuine brands", "medium", "Naming Issue",
     "Product has Generic brand but name contains real brand"),
    ("Incomplete Smartphone Name", "medium", "Naming Issue", "Smartphone name missing memory/storage spec"),
    ("Missing Weight/Volume", "medium", "Naming Issue", "Product name missing weight/volume"),
    ("Wrong Variation", "medium", "Naming Issue", "Wrong variation — should be separate SKUs"),
    ("Seller Approved to Sell Perfume", "high", "Restricted Brand", "Seller not approved for perfume"),
    ("Perfume Tester", "critical", "Prohibited Item", "Perfume tester — not permitted"),
    ("Seller Approve to sell books", "high", "Restricted Brand", "Seller not approved for books"),
    ("Seller Not approved to sell Refurb", "high", "Restricted Brand",
     "Seller not approved for refurbished devices"),
    ("#discount", "high", "Suspicious Price", None),
    ("#repeated", "low", "Repeated Description", "Description appears in multiple products"),
    ("#few_images", "medium", "Few Images (<5)", None),
    ("#empty", "medium", "Empty Description", "Product has no description"),
    ("#thin", "medium", "Thin Description", "Product description is too short"),
    ("#no_img", "medium", "Missing Images in Desc", "Product description does not contain any images"),
]
LISTING_FLAGS = [f for f, _, _ in FLAGS if any(r[0] == f for r in REGISTRATIONS)]
ISSUE = "struct<ord:int,severity:string,flag:string,message:string>"


def _issue(i: int, message: Column) -> Column:
    _, severity, flag, _ = REGISTRATIONS[i]
    return F.struct(F.lit(i).alias("ord"), F.lit(severity).alias("severity"), F.lit(flag).alias("flag"),
                    message.alias("message"))


def _from_checks() -> Column:
    """Issues made from the listing flags found on a row."""
    specs = []
    for flag, _, _ in FLAGS:
        own = [F.struct(F.lit(i).alias("ord"), F.lit(sev).alias("severity"), F.lit(col).alias("flag"),
                        F.lit(msg or col).alias("message"))
               for i, (f, sev, col, msg) in enumerate(REGISTRATIONS) if f == flag]
        specs.append(F.array(*own).cast(f"array<{ISSUE}>"))
    table = F.array(*specs)

    def issues(x):
        detail = F.when(F.coalesce(x.detail, F.lit("")) != "", x.detail)
        return F.transform(F.get(table, x.ord - 1), lambda s: F.struct(
            s.ord.alias("ord"), s.severity.alias("severity"), s.flag.alias("flag"),
            F.coalesce(tx.strip_ws(detail), s.message).alias("message")))
    return F.flatten(F.transform("_found", issues))


def find_issues(df: DataFrame, rules: RuleBook, predict=None) -> DataFrame:
    """Rows with ``_issues``: deduplicated issues in collection order."""
    base, kept = df.columns, columns(df)
    flags = [f for f in LISTING_FLAGS if rules.country == "NG" or not f.startswith("NG - ")]
    out = run_checks(df, RuleBook(rules.spark, {**rules.tables, "country_skip": rules.spark.createDataFrame(
        [], "country string, flag string")}, rules.market, rules.country), flags, predict=predict, use_paths=False)
    index = {r[0]: i for i, r in enumerate(REGISTRATIONS)}
    extra = []

    def add(name, cond, message):
        extra.append(F.when(cond, _issue(index[name], message)))
    out, patterns = kw.attach_patterns(
        out, [("blacklist", rules.words("blacklist"), tx.as_text(F.col("NAME")), "each")], source=df)
    pattern = patterns["blacklist"]
    if pattern is not None:
        name = tx.as_text(F.col("NAME"))
        add("#blacklist", kw.hit(tx.lower_key(F.col("NAME")), pattern), unnecessary_detail(name, pattern))
    discount = fake_discount_detail(out)
    add("#discount", discount.isNotNull(), discount)
    if "No. of Images" in base:
        n = F.col("`No. of Images`")
        add("#few_images", F.coalesce(tx.num(n), F.lit(1.0)) < 5,
            F.concat(F.lit("Product has only "), tx.as_text(n), F.lit(" image(s), minimum recommended is 5")))
    text = next((c for c in ("DESCRIPTION_HTML", "DESCRIPTION") if c in base), None)
    if text:
        d = F.col(text).cast("string")
        blank = F.coalesce(tx.strip_ws(d), F.lit("")).isin("", "nan", "None")
        for name, cond in (("#empty", blank), ("#thin", ~blank & (F.length(d) < 100)),
                           ("#no_img", d.isNotNull() & ~F.contains(F.lower(d), F.lit("<img")))):
            add(name, cond, F.lit(REGISTRATIONS[index[name]][3]))
    # What a row finds by itself is found before rows meet, so long texts do not travel.
    out = out.withColumn("_own", F.concat(_from_checks(), F.array_compact(F.array(*extra))))
    every = F.col("_own")
    if "DESCRIPTION" in base:
        out = repeated_description(out)
        again = _issue(index["#repeated"], F.lit(REGISTRATIONS[index["#repeated"]][3]))
        every = F.concat(every, F.array_compact(F.array(F.when(F.col("_repeated"), again))))
    out = out.withColumn("_all", F.array_sort(every))
    key = F.transform("_all", lambda x: F.struct(x.flag.alias("flag"), x.message.alias("m")))
    out = out.withColumn("_keys", key)
    first = F.filter("_all", lambda x, i: F.array_position(F.col("_keys"), F.get("_keys", i)) == i + 1)
    return out.withColumn("_issues", first).select(*kept, "_issues")


def issue_rows(df: DataFrame) -> DataFrame:
    """One row per issue."""
    return exploded(df.select(F.col("PRODUCT_SET_SID").alias("sid"), "_issues"), "_issues").select(
        "sid", "x.severity", "x.flag", "x.message", F.col("x.ord").alias("issue_order"))


def severity_count(severity: str) -> Column:
    return F.size(F.filter("_issues", lambda x: x.severity == severity))


def quality_score() -> Column:
    lost = sum((severity_count(s) * w for s, w in WEIGHTS.items()), F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - lost)


def yes_no(flag: str) -> Column:
    return F.when(F.exists("_issues", lambda x: x.flag == flag), "YES").otherwise("NO")


def top_issues() -> Column:
    rank = F.array(*[F.lit(s) for s in SEVERITIES])
    ranked = F.array_sort(F.transform("_issues", lambda x: F.struct(
        F.array_position(rank, x.severity).alias("r"), x.ord.alias("o"),
        F.concat(F.lit("["), x.severity, F.lit("] "), x.message).alias("t"))))
    return F.array_join(F.transform(ranked, lambda x: x.t), " | ")


def quality_report(df: DataFrame, country: str) -> DataFrame:
    """The 41 report columns from rows with ``_issues``."""
    def first(*names, default=""):
        have = next((n for n in names if n in df.columns), None)
        return F.col(f"`{have}`") if have else F.lit(default)

    def text(*names):
        have = next((n for n in names if n in df.columns), None)
        return tx.as_text(F.col(f"`{have}`")) if have else F.lit("")
    out = [
        tx.strip_ws(text("PRODUCT_SET_SID", "SKU")).alias("SKU"), text("NAME", "Name").alias("Name"),
        text("BRAND", "Brand").alias("Brand"), text("CATEGORY", "Category").alias("Category"),
        first("GLOBAL_PRICE", "Price").alias("Price"), first("OLD_PRICE", "Old Price").alias("Old Price"),
        first("DISCOUNT", "Discount").alias("Discount"), first("RATING", "Rating").alias("Rating"),
        first("TOTAL_RATINGS", "Total Ratings").alias("Total Ratings"), text("SELLER_NAME", "Seller").alias("Seller"),
        first("Express", "EXPRESS", default="No").alias("Express"),
        first("Shop Global", "SHOP_GLOBAL", default="No").alias("Shop Global"),
        text("MAIN_IMAGE", "Image URL").alias("Image URL"), text("PRODUCT_URL", "Product URL").alias("Product URL"),
        first("STOCK_STATUS", "Stock", default="In Stock").alias("Stock"), first("Tags", "TAGS").alias("Tags"),
        first("Country", default=country).alias("Country"), quality_score().alias("Quality Score"),
        *[severity_count(s).alias(f"{s.title()} Issues") for s in SEVERITIES],
        F.size("_issues").alias("Total Issues"), top_issues().alias("Top Issues"),
        first("No. of Images", default="N/A").alias("No. of Images"), *[yes_no(f).alias(f) for f in YES_NO],
    ]
    return df.select(*out)


def report_kpis(report: DataFrame) -> DataFrame:
    total, crit = F.col("Total Issues"), F.col("Critical Issues")
    return report.agg(
        F.count("*").alias("products"), F.avg("Quality Score").alias("avg_score"),
        F.count_if(total > 0).alias("with_issues"), F.count_if(crit > 0).alias("critical"),
        F.count_if(total == 0).alias("clean"),
        (F.count_if(total > 0) / F.greatest(F.count("*"), F.lit(1)) * 100).alias("issue_rate"))


def flag_breakdown(report: DataFrame) -> DataFrame:
    """Products per report flag, flags without any left out, most frequent first."""
    counts = report.agg(*[F.count_if(F.col(f"`{c}`") == "YES").alias(c) for c in BREAKDOWN])
    rows = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(f"`{c}`").alias("n")) for c in BREAKDOWN])
    return counts.select(F.inline(rows)).where("n > 0").orderBy(F.desc("n"), "flag")


def filter_report(report: DataFrame, show: str = "All", flag: str | None = None, low: int = 0,
                  high: int = 100, search: str | None = None) -> DataFrame:
    if show == "Issues Only":
        report = report.where(F.col("Total Issues") > 0)
    elif show == "Critical Only":
        report = report.where(F.col("Critical Issues") > 0)
    elif show == "Clean Only":
        report = report.where(F.col("Total Issues") == 0)
    if flag:
        report = report.where(F.col(f"`{flag}`") == "YES")
    report = report.where(F.col("Quality Score").between(low, high))
    if search:
        term = F.lit(search.strip().lower())
        cond = F.lit(False)
        for c in ("SKU", "Name", "Brand", "Seller"):
            cond = cond | F.contains(F.lower(F.col(c)), term)
        report = report.where(cond)
    return report
