"""Readers and exports: files written from the driver's tables into the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driver_queries import sql as S
from driver_queries.audit_queries import _FIRST, simple_verdicts
from driver_queries.views import table, view
from listguard.operators import ingest, matching
from listguard.plans import flows
from listguard.session import shared_folder
from listguard.sources import exports, files
from listguard.sources import rules as R

QUERIES, SQL = {}, {}


def add(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


_LINES = """SELECT p_partkey, concat('P', CAST(p_partkey AS string)) AS {sid}, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' café' END, CASE WHEN p_size = 1 THEN ' "x", y' ELSE '' END) AS {name},
 p_brand AS {brand}, CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice AS string) END AS {price} FROM {part}"""


def _lines(spark, sf, **names):
    text = _LINES
    for key, value in names.items():
        text = text.replace("{" + key + "}", f"`{value}`")
    return spark.sql(text, part=table(spark, sf, "part"))


_READ = """SELECT concat('P', p_partkey) AS PRODUCT_SET_SID, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' café' END, CASE WHEN p_size = 1 THEN ' "x", y' ELSE '' END) AS NAME,
 p_brand AS BRAND, CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice AS varchar) END AS GLOBAL_PRICE, """


@add("s01_s04_listing_files", _READ + "CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS COLOR FROM part")
def s01(spark, sf):
    """Three layouts read as one: commas and UTF-8, semicolons with a further column, tabs and Latin-1."""
    rows, path = _lines(spark, sf, sid="cod_productset_sid", name="dsc_name", brand="dsc_brand_name", price="GLOBAL_PRICE"), folder(spark)
    for k, (sep, charset) in enumerate(((",", "UTF-8"), (";", "UTF-8"), ("\t", "ISO-8859-1"))):
        some = rows.where(f"p_partkey % 3 = {k}").drop("p_partkey")
        if k == 1:
            some = some.withColumn("colour", F.col("dsc_brand_name"))
        some.write.option("header", True).option("sep", sep).option("encoding", charset).option("escape", '"').csv(f"{path}/{k}")
    return files.read_listings(spark, f"{path}/*").select("PRODUCT_SET_SID", "NAME", "BRAND", "GLOBAL_PRICE", "COLOR")


@add("s02_grab_files", _READ + "p_partkey % 2 = 0 AS piped FROM part")
def s02(spark, sf):
    """Grab files with pipes, and others with commas."""
    rows, path = _lines(spark, sf, sid="SKU", name="Name", brand="Brand", price="Old Price"), folder(spark)
    for k, sep in enumerate("|,"):
        rows.where(f"p_partkey % 2 = {k}").drop("p_partkey").write.option("header", True).option("sep", sep).option("escape", '"').csv(f"{path}/{k}")
    out = files.read_grab(spark, f"{path}/*")
    return out.select("PRODUCT_SET_SID", "NAME", "BRAND", "GLOBAL_PRICE",
                      F.col("_file").rlike("/0/[^/]*$").alias("piped"))


@add("s03_audit_files", _READ + "p_partkey AS n FROM part")
def s03(spark, sf):
    rows, path = _lines(spark, sf, sid="SKU", name="Name", brand="Brand", price="Old Price"), folder(spark)
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    out = files.read_audit(spark, path)
    return out.select("PRODUCT_SET_SID", "NAME", "BRAND", "GLOBAL_PRICE", F.col("p_partkey").cast("long").alias("n"))


@add("s06_word_list", "SELECT DISTINCT trim(split_part(p_name, ' ', 2)) AS word FROM part WHERE p_size > 3")
def s06(spark, sf):
    path = folder(spark)
    spark.sql("SELECT CASE WHEN p_size <= 3 THEN '   ' ELSE concat('  ', split_part(p_name, ' ', 2), ' ') END AS value FROM {part}",
              part=table(spark, sf, "part")).write.text(path)
    return R.read_list(spark, path)


@add("s07_prepared_round_trip", S.with_("prepared") + "SELECT PRODUCT_SET_SID, NAME, BRAND, COUNT_VARIATIONS FROM prepared")
def s07(spark, sf):
    from driver_queries.check_queries import prepared
    path = folder(spark)
    files.save_prepared(prepared(spark, sf), path)
    return files.load_prepared(spark, path).select("PRODUCT_SET_SID", "NAME", "BRAND", "COUNT_VARIATIONS")


@add("s10_weighted_keywords", """SELECT DISTINCT concat('size ', p_size) AS category, concat('word', p_size) AS keyword, p_size / 10.0 AS weight FROM part
UNION ALL SELECT DISTINCT concat('brand ', lower(p_brand)), concat('x', length(p_brand)), 0.5 FROM part""")
def s10(spark, sf):
    """One JSON file with a map of categories, one with a list of records."""
    path, part = folder(spark), table(spark, sf, "part")
    for name, text in (("map", """SELECT concat('{{', array_join(array_sort(collect_set(concat('" Size ', p_size, '":{{"WORD', p_size, '":', p_size / 10.0, '}}'))), ','), '}}') AS value FROM {part}"""),
                       ("list", """SELECT concat('[', array_join(array_sort(collect_set(concat('{{"category":"","Category Path":"Brand ', p_brand, '","weights":{{"x', length(p_brand), '":0.5}}}}'))), ','), ']') AS value FROM {part}""")):
        spark.sql(text, part=part).coalesce(1).write.text(f"{path}/{name}")
    return R.weighted_keywords(spark, f"{path}/*")


# ---- exports -------------------------------------------------------------------------------

_EXPORTS = _FIRST + """, verdicts AS (SELECT PRODUCT_SET_SID AS sid, CASE WHEN bad THEN 'Rejected' ELSE 'Approved' END AS status FROM v)
"""


@add("k01_k03_exports", _EXPORTS + """SELECT 'PIM_Export' AS export, sid, status FROM verdicts UNION ALL SELECT status, sid, status FROM verdicts
UNION ALL SELECT 'Full', sid, status FROM verdicts""")
def k01(spark, sf):
    """All four exports, read back."""
    rows, verdicts = simple_verdicts(spark, sf, written=True)
    path = folder(spark)
    reasons = verdicts.select(F.lit("1 - x").alias("CODE - REJECTION_REASON")).distinct()
    exports.write_exports(verdicts, rows, path, reasons, "gzip")
    out = None
    for name in ("PIM_Export", "Rejected", "Approved", "Full"):
        read = spark.read.option("header", True).option("escape", '"').csv(f"{path}/{name}/ProductSets")
        some = read.select(F.lit(name).alias("export"), F.col("PRODUCT_SET_SID" if name == "Full" else "ProductSetSid").alias("sid"),
                           F.col("Status").alias("status"))
        out = some if out is None else out.union(some)
    return out


@add("k02_rows_per_part", _FIRST + f"SELECT count(*) AS n, true AS bounded FROM first")
def k02(spark, sf):
    """No file of an export holds more rows than one part may."""
    rows, verdicts = simple_verdicts(spark, sf)
    path = folder(spark)
    exports.write_product_sets(verdicts, path)  # by many tasks, each of which cuts its rows into parts
    read = spark.read.option("header", True).option("escape", '"').csv(f"{path}/ProductSets")
    per_file = read.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("n"), (F.max("n") <= exports.PART_ROWS).alias("bounded"))


@add("k04_report", S.with_("published") + """SELECT PRODUCT_SET_SID, NAME, RATING FROM published""")
def k04(spark, sf):
    path = folder(spark)
    exports.write_report(view(spark, sf, "published").select("PRODUCT_SET_SID", "NAME", "RATING"), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@add("k05_weekly_tables", S.with_("weekly") + """SELECT category, count(*) AS n FROM weekly WHERE status = 'Rejected' GROUP BY 1""")
def k05(spark, sf):
    """The weekly tables, of which the rejected categories are read back."""
    rows = view(spark, sf, "weekly").select(
        F.col("Date"), F.date_format("Date", "EEEE").alias("Day"), F.col("status").alias("Status"), F.col("flag").alias("Reason"),
        F.col("seller").alias("Seller"), F.col("category").alias("Category"))
    path = folder(spark)
    exports.write_weekly(flows.weekly_tables(rows, "Kenya", "1", 1, "today"), path)
    read = spark.read.option("header", True).csv(f"{path}/Top Rejected Categories")
    return read.select(F.col(read.columns[0]).alias("category"), F.col(read.columns[1]).cast("long").alias("n"))


@add("k06_csv_text", """SELECT p_partkey, concat(p_name, ' é "q", ', p_brand) AS name FROM part""")
def k06(spark, sf):
    path = folder(spark)
    rows = spark.sql("""SELECT p_partkey, concat(p_name, ' é "q", ', p_brand) AS name FROM {part}""", part=table(spark, sf, "part"))
    exports.write_csv(rows, path, encoding="ISO-8859-1")
    read = spark.read.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return read.select(F.col("p_partkey").cast("long").alias("p_partkey"), "name")


@add("m07_learned_twice", r"""WITH c AS (SELECT trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name, p_size, p_partkey FROM part)
SELECT DISTINCT name, concat('second ', max(p_size) OVER (PARTITION BY name)) AS category FROM c""")
def m07(spark, sf):
    """Corrections appended in two batches: the later one counts."""
    path = folder(spark)
    rows = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias("p_size"))
    for batch in ("first", "second"):
        matching.learn(spark, rows.select("name", F.concat(F.lit(batch + " "), "p_size").alias("category")), path)
    return R.learned_names(spark.read.parquet(path)).select("name", "category")
