"""Rule and dimension tables in long form, and the loaders that make them from raw sheets.

A raw sheet is a DataFrame of strings with a ``_pos`` column that gives the row order; the
country it belongs to is a column, not a map key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listguard.functions import text as tx
from listguard.market import COUNTRY_SKIPS, DEFAULT_MARKET, Market
from listguard.operators.skew import first_per_key

ROLES = ["fashion", "sneaker", "weight", "warranty", "variation", "smartphone",
         "duplicate_exempt", "color", "book", "perfume", "jersey", "phone", "laptop",
         "ng_gift", "ng_tv", "ng_hp", "ng_power"]
SELLER_KINDS = ["phone", "laptop", "book", "perfume", "jersey_exempt", "ng_gift", "ng_hp",
                "ng_apple", "ng_xmas"]

# Flag, reason, English comment, in priority order; {market} is the marketplace.
_NO_LICENSE = "1000024 - Product does not have a license to be sold via {market} (Not Authorized)"
_FAKE = "1000023 - Confirmation of counterfeit product by {market} technical team (Not Authorized)"
_CONTACT = ("1000028 - Kindly Contact {market} Seller Support To Confirm Possibility Of Sale Of "
            "This Product By Raising A Claim")
_NAME = "1000008 - Kindly Improve Product Name Description"
_OTHER = "1000007 - Other Reason"
_BRAND = "1000003 - Restricted Brand"
FLAGS = [
    ("Wrong Category", "1000004 - Wrong Category",
     "Assigned to Wrong Category. Please use correct category."),
    ("Restricted brands", _NO_LICENSE,
     "Missing license for this item. Raise a claim via Vendor Center."),
    ("Suspected Fake product", _FAKE, "Product confirmed counterfeit."),
    ("Seller Not approved to sell Refurb", _CONTACT,
     "Contact Seller Support for Refurbished approval."),
    ("Product Warranty", "1000013 - Kindly Provide Product Warranty Details",
     "Valid warranty required in Description/Warranty tabs."),
    ("Seller Approve to sell books", _CONTACT, "Contact Seller Support for Book category approval."),
    ("Seller Approved to Sell Perfume", _CONTACT, "Contact Seller Support for Perfume approval."),
    ("Perfume Tester", _OTHER, "Sale of perfume testers is not permitted on {market}."),
    ("Counterfeit Sneakers", _FAKE, "Sneaker confirmed counterfeit."),
    ("Suspected counterfeit Jerseys", _FAKE, "Jersey confirmed counterfeit."),
    ("Prohibited products", _OTHER, "Listing of this product is prohibited."),
    ("Unnecessary words in NAME", _NAME, "Avoid unnecessary words in title."),
    ("Single-word NAME", _NAME, "Update product title format: Name – Type – Color."),
    ("Generic BRAND Issues", _OTHER,
     "Use correct brand instead of Generic/Fashion. Apply for brand approval if needed."),
    ("Fashion brand issues", _OTHER,
     "Use correct brand instead of Fashion. Apply for brand approval if needed."),
    ("BRAND name repeated in NAME", _OTHER, "Brand name should not be repeated in product name."),
    ("Wrong Variation", "1000039 - Product Poorly Created. Each Variation Of This Product Should "
     "Be Created Uniquely (Not Authorized)",
     "Create different SKUs instead of variations (variations only for sizes)."),
    ("Generic branded products with genuine brands", _OTHER,
     "Use the displayed brand on the product instead of Generic."),
    ("Missing COLOR", "1000005 - Kindly confirm the actual product colour",
     "Product color must be mentioned in title/color tab."),
    ("Missing Weight/Volume", _NAME, "Include weight or volume (e.g., '1kg', '500ml')."),
    ("Incomplete Smartphone Name", _NAME, "Include memory/storage details (e.g., '128GB')."),
    ("Duplicate product", _OTHER, "This product is a duplicate."),
    ("NG - Gift Card Seller", _BRAND, "Seller not authorised to sell Gift Cards in these categories."),
    ("NG - Books Seller", _BRAND,
     "Seller not authorised to sell this book title, or no seller is approved for it."),
    ("NG - TV Brand Seller", _BRAND, "Seller not authorised to sell this TV brand."),
    ("NG - HP Toners Seller", _BRAND, "Seller not authorised to sell HP Ink/Toners in these categories."),
    ("NG - Apple Seller", _BRAND, "Seller not authorised to sell Apple products."),
    ("NG - Xmas Tree Seller", _BRAND, "Seller not authorised to sell Christmas Tree products."),
    ("NG - Rice Brand Seller", _BRAND, "Seller not authorised to sell this rice brand."),
    ("NG - Powerbank Capacity", _OTHER,
     "Only approved brands may list powerbanks with 20,000mAh or above capacity."),
]
MANUAL_FLAGS = [("Poor images", "1000042 - Kindly follow our product image upload guideline.",
                 "Poor Image Quality")]
FLAG_ORDER = {flag: i + 1 for i, (flag, _, _) in enumerate(FLAGS)}
DEFAULT_REASON = _OTHER

# Header cells repeated inside the sheets, dropped on load.
HEADER_WORDS = {"", "nan", "seller", "sellername", "seller name", "exempted sellers", "brand",
                "keyword", "keywords", "name", "words", "phone", "phones", "laptop", "laptops",
                "category", "categories"}

EMPTY = {
    "category_role": "code string, role string",
    "word_list": "list string, word string",
    "keyword_rule": "kind string, country string, keyword string",
    "approved_seller": "kind string, country string, seller string",
    "restricted_brand": "country string, rule_order int, brand string, brand_raw string, "
                        "sellers array<string>, categories array<string>, variations array<string>",
    "prohibited": "country string, rule_order int, keyword string, categories array<string>",
    "price_floor": "country string, brand string, category_code string, threshold double",
    "ng_book": "rule_order int, title string, seller string",
    "ng_tv": "brand string, seller string",
    "ng_rice": "brand string, sellers array<string>, categories array<string>",
    "ng_power_brand": "brand string",
    "flag_map": "flag string, reason string, comment_en string, comment_fr string, comment_ar string",
    "category_map": "name string, code string, path string, _pos bigint",
    "category_keyword": "category string, keyword string, weight double",
    "correction": "id bigint, name string, category string",
    "country_skip": "country string, flag string",
}


def flag_dimension(spark: SparkSession, market: Market = DEFAULT_MARKET,
                   custom: DataFrame | None = None) -> DataFrame:
    """Flag texts in three languages; a custom table replaces all but the Nigerian flags."""
    rows = [(f, r.format(market=market.name), c.format(market=market.name))
            for f, r, c in FLAGS + MANUAL_FLAGS]
    default = spark.createDataFrame(rows, "flag string, reason string, comment_en string")
    default = default.withColumns({"comment_fr": F.col("comment_en"), "comment_ar": F.col("comment_en")})
    if custom is None:
        return default
    lowered = custom.toDF(*[c.strip().lower() for c in custom.columns])
    if not {"flag", "reason", "comment"} <= set(lowered.columns):
        return default

    def cell(c):
        return tx.strip_ws(tx.as_text(F.col(c))) if c in lowered.columns else F.lit("")
    en = cell("comment")
    given = lowered.select(
        cell("flag").alias("flag"), cell("reason").alias("reason"), en.alias("comment_en"),
        *[F.when(F.lower(cell(c)).isin("", "nan"), en).otherwise(cell(c)).alias(n)
          for c, n in (("french", "comment_fr"), ("arabic", "comment_ar"))],
        *([F.col("_pos")] if "_pos" in lowered.columns else [F.lit(0).alias("_pos")]))
    given = given.where(~F.lower("flag").isin("", "nan"))
    last = first_per_key(given, ["flag"], [F.desc("_pos")]).drop("_pos")
    nigerian = default.where(F.col("flag").startswith("NG - "))
    if not last.head(1):
        return default
    return last.join(nigerian.select("flag"), "flag", "left_anti").unionByName(nigerian)


@dataclass
class RuleBook:
    """Every rule table of one run; missing tables are empty.

    A table may be given as a function without arguments, which is called on first use.
    """

    spark: SparkSession
    tables: dict
    market: Market = DEFAULT_MARKET
    country: str = "KE"
    #: Short lists as constant arrays, by the check that reads them.
    arrays: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        found = self.tables.get(name)
        if found is None:
            return self.spark.createDataFrame([], EMPTY[name])
        if callable(found):
            self.tables[name] = found = found()
        return found

    def for_country(self, name: str) -> DataFrame:
        return self.table(name).where(F.col("country") == self.country)

    @cached_property
    def roles_present(self) -> set:
        if "category_role" not in self.tables:
            return set()
        return {r.role for r in self.table("category_role").select("role").distinct()
                .where(F.col("role").isin(*ROLES)).collect()}

    @cached_property
    def kinds_present(self) -> set:
        if "approved_seller" not in self.tables:
            return set()
        return {r.kind for r in self.for_country("approved_seller").select("kind").distinct()
                .where(F.col("kind").isin(*SELLER_KINDS)).collect()}

    def words(self, name: str) -> DataFrame:
        return (self.table("word_list").where(F.col("list") == name)
                .select(F.lower("word").alias("word")).distinct())

    def keywords(self, kind: str) -> DataFrame:
        return self._keyword_table().where(F.col("list") == kind).select("word").distinct()

    def _keyword_table(self) -> DataFrame:
        # Jersey keywords differ by country; the other kinds hold everywhere.
        return (self.table("keyword_rule").where((F.col("kind") != "jersey") | (F.col("country") == self.country))
                .select(F.col("kind").alias("list"), F.lower("keyword").alias("word")))

    def skipped(self) -> set:
        if "country_skip" in self.tables:
            known = F.col("flag").isin(*[f for f, *_ in FLAGS])  # so no more rows than flags come back
            return {r.flag for r in self.for_country("country_skip").where(known).select("flag").distinct().collect()}
        return set(COUNTRY_SKIPS.get(self.country, ()))

    @cached_property
    def flags(self) -> DataFrame:
        if "flag_map" in self.tables:
            return self.table("flag_map")
        return flag_dimension(self.spark, self.market)


# ---- loaders -------------------------------------------------------------------------------

def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One item per line, trimmed, blanks and repeats dropped."""
    return (spark.read.text(path).select(tx.strip_ws(F.col("value")).alias("word"))
            .where("word <> ''").distinct())


def cell(c: str):
    """A sheet cell as trimmed text; a missing cell is null."""
    s = tx.strip_ws(F.col(c).cast("string"))
    return F.when((s != "") & (F.lower(s) != "nan"), s)


def pieces(c, pattern: str):
    return F.filter(F.transform(F.split(c, pattern), tx.strip_ws), lambda p: p != "")


def code_pieces(c, pattern: str):
    return F.transform(pieces(c, pattern), tx.clean_code)


def seller_sheet(df: DataFrame, kind: str, column: str) -> DataFrame:
    return (df.select(F.lit(kind).alias("kind"), "country", F.lower(cell(column)).alias("seller"))
            .where(F.col("seller").isNotNull() & ~F.col("seller").isin(*HEADER_WORDS)).distinct())


def keyword_sheet(df: DataFrame, kind: str, column: str) -> DataFrame:
    country = F.col("country") if "country" in df.columns else F.lit(None).cast("string")
    return (df.select(F.lit(kind).alias("kind"), country.alias("country"),
                      F.lower(cell(column)).alias("keyword"))
            .where(F.col("keyword").isNotNull() & ~F.col("keyword").isin(*HEADER_WORDS)).distinct())


def category_sheet(df: DataFrame, role: str, column: str) -> DataFrame:
    return (df.select(tx.clean_code(cell(column)).alias("code"), F.lit(role).alias("role"))
            .where(~F.lower("code").isin(*HEADER_WORDS)).distinct())


def prohibited_rules(df: DataFrame) -> DataFrame:
    kept = (df.select("country", "_pos", F.lower(cell("keyword")).alias("keyword"),
                      F.coalesce(code_pieces(cell("categories"), r"[,\n]+"),
                                 F.array().cast("array<string>")).alias("categories"))
            .where(F.col("keyword").isNotNull() & (F.col("keyword") != "keywords")))
    return kept.select("country", F.col("_pos").cast("int").alias("rule_order"), "keyword", "categories")


def restricted_brands(df: DataFrame) -> DataFrame:
    """Rows of one brand merged; a single blank category cell removes the category filter."""
    none = F.array().cast("array<string>")
    rows = df.select("country", "_pos", cell("brand").alias("raw"),
                     F.coalesce(pieces(F.lower(cell("approved_sellers")), ","), none).alias("s"),
                     F.coalesce(code_pieces(cell("categories"), ","), none).alias("c"),
                     F.coalesce(pieces(F.lower(cell("variations")), ","), none).alias("v"),
                     cell("categories").isNull().alias("blank")).where("raw IS NOT NULL")
    merged = rows.groupBy("country", F.lower("raw").alias("brand")).agg(
        F.min("_pos").cast("int").alias("rule_order"), F.min_by("raw", "_pos").alias("brand_raw"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(n)
          for c, n in (("s", "sellers"), ("c", "cats"), ("v", "variations"))],
        F.bool_or("blank").alias("blank"))
    return merged.select("country", "rule_order", "brand", "brand_raw", "sellers",
                         F.when(F.col("blank"), none).otherwise(F.col("cats")).alias("categories"),
                         "variations")


def price_floors(df: DataFrame, country: str, skip=("Unnamed: 0", "Brand", "Price")) -> DataFrame:
    """Brand per column, price in the first row, category codes below."""
    brands = [c for c in df.columns if c not in skip and not c.startswith("_")]
    order = {b: i for i, b in enumerate(brands)}
    long = df.select("_pos", *[F.col(f"`{b}`").cast("string").alias(b) for b in brands]).unpivot(
        ["_pos"], brands, "sheet_brand", "value")
    rank = F.coalesce(*[F.when(F.col("sheet_brand") == b, F.lit(i)) for b, i in order.items()])
    first = df.agg(F.min("_pos")).head()[0]
    tagged = long.withColumn("rank", rank).withColumn("_first", F.lit(first))
    price = (tagged.where("_pos = _first").select("sheet_brand", tx.num(F.col("value")).alias("threshold"))
             .where("threshold > 0"))
    cats = (tagged.where("_pos > _first")
            .select("sheet_brand", "rank", "_pos", tx.clean_code(cell("value")).alias("category_code"))
            .where("category_code <> ''"))
    pairs = cats.join(price, "sheet_brand").withColumn(
        "brand", F.lower(tx.strip_ws(F.col("sheet_brand"))))
    return (pairs.groupBy("brand", "category_code")
            .agg(F.max_by("threshold", F.struct("rank", "_pos")).alias("threshold"))
            .select(F.lit(country).alias("country"), "brand", "category_code", "threshold"))


def nigeria_books(df: DataFrame) -> DataFrame:
    rows = df.select("_pos", F.lower(cell("title")).alias("title"),
                     F.lower(cell("seller")).alias("seller")).where("title IS NOT NULL")
    return rows.groupBy("title").agg(
        F.min("_pos").cast("int").alias("rule_order"),
        F.max_by(F.struct("seller"), "_pos").getField("seller").alias("seller"),
    ).select("rule_order", "title", "seller")


def nigeria_tvs(df: DataFrame, category_column: str) -> tuple[DataFrame, DataFrame]:
    """(brand, seller) pairs and the category codes of the wide sheet."""
    brands = [c for c in df.columns if c != category_column and not c.startswith("_")]
    pairs = (df.select(*[F.col(f"`{b}`").cast("string").alias(b) for b in brands])
             .unpivot([], brands, "b", "s")
             .select(F.lower(tx.strip_ws(F.col("b"))).alias("brand"), F.lower(cell("s")).alias("seller"))
             .where(F.col("seller").isNotNull() & (F.col("seller") != F.col("brand"))).distinct())
    return pairs, category_sheet(df, "ng_tv", category_column)


def nigeria_rice(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = df.select(F.lower(cell("brand")).alias("brand"),
                     F.coalesce(pieces(F.lower(cell("sellers")), ","), none).alias("s"),
                     tx.clean_code(cell("category")).alias("c")).where("brand IS NOT NULL")
    return rows.groupBy("brand").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("sellers"),
        F.array_sort(F.collect_set(F.when(F.col("c") != "", F.col("c")))).alias("categories"))


def category_codes_by_name(df: DataFrame) -> DataFrame:
    """Name or last path segment -> code; a name always wins over a segment."""
    code = tx.clean_code(cell("code"))
    base = df.select("_pos", code.alias("code"), F.lower(cell("name")).alias("name"),
                     F.lower(tx.strip_ws(F.element_at(F.split(cell("path"), "/"), -1))).alias("seg"))
    base = base.where("code <> ''")
    names = base.where("name IS NOT NULL").groupBy(F.col("name").alias("key")).agg(
        F.max_by("code", "_pos").alias("code")).withColumn("src", F.lit(0))
    segs = base.where("seg <> ''").groupBy(F.col("seg").alias("key")).agg(
        F.min_by("code", "_pos").alias("code")).withColumn("src", F.lit(1))
    return names.unionByName(segs).groupBy("key").agg(F.min_by("code", "src").alias("code"))


def paths_to_codes(df: DataFrame) -> DataFrame:
    """Lower-cased path -> code; the last row of a path wins."""
    rows = df.select("_pos", F.lower(cell("path")).alias("path"), tx.clean_code(cell("code")).alias("code"))
    return (rows.where("path IS NOT NULL AND code <> ''").groupBy("path")
            .agg(F.max_by("code", "_pos").alias("code"), F.min("_pos").alias("_pos")))


def codes_to_paths(df: DataFrame) -> DataFrame:
    """Code -> path; the path that first appeared last wins."""
    return paths_to_codes(df).groupBy("code").agg(F.max_by("path", "_pos").alias("path"))


def weighted_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Weighted keywords from a JSON file holding a map, or a list of records."""
    raw = spark.read.text(path, wholetext=True)
    records = F.from_json(
        "value", "array<struct<category:string,`Category Path`:string,name:string,"
        "category_name:string,keywords:map<string,double>,weights:map<string,double>,"
        "positive:map<string,double>>>")
    filled = [F.when(F.size(F.col(f"r.{c}")) > 0, F.col(f"r.{c}")) for c in ("keywords", "weights", "positive")]
    named = [F.when(F.col(f"r.{c}") != "", F.col(f"r.{c}"))
             for c in ("category", "`Category Path`", "name", "category_name")]
    listed = (raw.where("ltrim(value) LIKE '[%'").select(F.explode(records).alias("r"))
              .select(F.coalesce(*named).alias("category"), F.coalesce(*filled).alias("kw")))
    mapped = (raw.where("ltrim(value) LIKE '{%'")
              .select(F.explode(F.from_json("value", "map<string,map<string,double>>"))
                      .alias("category", "kw")))
    return (listed.unionByName(mapped).where("category IS NOT NULL")
            .select(F.lower(tx.strip_ws(F.col("category"))).alias("category"), F.explode("kw").alias("k", "weight"))
            .select("category", F.lower("k").alias("keyword"), "weight").where("weight IS NOT NULL"))


def learned_names(corrections: DataFrame) -> DataFrame:
    """Last corrected category per name, by id and, where the table has it, place in the batch."""
    order = F.struct("id", *[c for c in ("pos",) if c in corrections.columns])
    return corrections.groupBy("name").agg(F.max_by("category", order).alias("category"))
