"""Weekly analytics over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import sql as S
from driver_queries.views import table, view
from listguard.operators import analytics as A
from listguard.sources.files import weekly_metadata

QUERIES, SQL = {}, {}


def add(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def weekly(spark, sf):
    raw = view(spark, sf, "weekly")
    return A.choose_columns(raw.withColumn("Day", F.date_format("Date", "EEEE")).withColumnRenamed("status", "Status")
                            .withColumnRenamed("seller", "Seller"))


W = S.with_("weekly") + ", w AS (SELECT *, dayname(Date) AS Day FROM weekly)\n"
STAT = ["Approved", "Pending", "Rejected"]
_CNT = ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in STAT)
REJ = "w WHERE status = 'Rejected'"


@add("s05_weekly_metadata", """WITH x AS (SELECT o_orderkey, concat(CASE o_custkey % 4 WHEN 0 THEN 'ke' WHEN 1 THEN 'MO' WHEN 2 THEN 'zz' ELSE 'ci' END, '_Sets_', CASE WHEN o_orderkey % 10 = 0 THEN 'undated'
 ELSE strftime(o_orderdate, '%Y-%m-%d') END, '.csv') AS f, o_orderdate FROM orders)
SELECT o_orderkey, CAST(o_orderdate AS date) AS "Date", dayname(o_orderdate) AS "Day", CASE substring(f, 1, 2) WHEN 'ke' THEN 'Kenya' WHEN 'MO' THEN 'Morocco' WHEN 'ci' THEN 'Ivory Coast'
 ELSE 'Unknown Country' END AS "Country", CAST(weekofyear(o_orderdate) AS integer) AS "Week" FROM x WHERE o_orderkey % 10 <> 0""")
def s05(spark, sf):
    o = table(spark, sf, "orders")
    prefix = F.element_at(F.array(F.lit("ke"), F.lit("MO"), F.lit("zz"), F.lit("ci")), (F.col("o_custkey") % 4 + 1).cast("int"))
    name = F.concat(prefix, F.lit("_Sets_"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("undated"))
                    .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(".csv"))
    return weekly_metadata(o.select("o_orderkey", name.alias("f")), F.col("f")).drop("f")


@add("a01_a02_daily_summary", W + f"""SELECT coalesce(Day, 'Weekly Total') AS "Day", {_CNT}, count(*) AS "Daily Total",
 CAST(CASE WHEN Day IS NULL THEN 8 ELSE isodow(any_value(Date)) END AS integer) AS day_no FROM w GROUP BY ROLLUP(Day)""")
def a01(spark, sf):
    return A.daily_summary(weekly(spark, sf))


@add("a03_a09_weekly_totals", W + """SELECT *, rejected / total * 100 AS rejection_rate, CASE WHEN rejected / total * 100 > 20 THEN 'Action Required'
 WHEN rejected > 0 THEN 'Healthy Quality' END AS health FROM (SELECT count(*) FILTER (status = 'Approved') AS approved,
 count(*) FILTER (status = 'Rejected') AS rejected, count(*) AS total FROM w)""")
def a03(spark, sf):
    return A.weekly_totals(weekly(spark, sf)).withColumn("health", A.health(F.col("rejection_rate")))


@add("a04_seller_stats", W + f"""SELECT seller, {_CNT}, count(*) AS "Total Submitted",
 round_even(count(*) FILTER (status = 'Rejected') / count(*) * 100, 1) AS "Rejection Rate (%)" FROM w GROUP BY 1""")
def a04(spark, sf):
    return A.seller_stats(weekly(spark, sf))


@add("a05_daily_trend", W + 'SELECT Date, status, count(*) AS "Count" FROM w GROUP BY 1, 2')
def a05(spark, sf):
    return A.daily_trend(weekly(spark, sf))


@add("a06_top_reason", W + f"""SELECT flag AS reason, count(*) AS n, count(*) / (SELECT count(*) FROM {REJ}) * 100 AS share FROM {REJ} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""")
def a06(spark, sf):
    return A.top_reason(weekly(spark, sf))


@add("a07_worst_seller", W + f"SELECT seller, count(*) AS rejections FROM {REJ} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def a07(spark, sf):
    return A.worst_seller(weekly(spark, sf))


@add("a08_busiest_day", W + 'SELECT Day, count(*) AS total FROM w GROUP BY Day ORDER BY 2 DESC, min(isodow(Date)) LIMIT 1')
def a08(spark, sf):
    return A.busiest_day(weekly(spark, sf))


@add("a10_reason_distribution", W + f'SELECT flag AS "Reason", count(*) AS "Count" FROM {REJ} GROUP BY 1')
def a10(spark, sf):
    return A.value_counts(weekly(spark, sf), "flag", "Reason", "Count")


@add("a11_top_sellers", W + """SELECT seller, count(*) FILTER (status = 'Rejected') AS "Rejected", round_even(count(*) FILTER (status = 'Rejected') / count(*) * 100, 1) AS "Rejection Rate (%)"
 FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def a11(spark, sf):
    return A.top_sellers(weekly(spark, sf))


@add("a12_top_categories", W + f'SELECT category AS "Category", count(*) AS "Rejected Count" FROM {REJ} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5')
def a12(spark, sf):
    return A.top_values(weekly(spark, sf), "category", "Category")


@add("a13_top_reasons", W + f'SELECT flag AS "Reason", count(*) AS "Rejected Count" FROM {REJ} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5')
def a13(spark, sf):
    return A.top_values(weekly(spark, sf), "flag", "Reason")


@add("a14_a15_report_metadata", W + """, t AS (SELECT count(*) FILTER (status = 'Approved') AS a, count(*) FILTER (status = 'Rejected') AS r, count(*) AS n FROM w)
SELECT unnest(['Report Generated On', 'Country / Region', 'Reporting Week', 'Total Files/Parts Merged', 'Total Products Processed', 'Total Approved', 'Total Rejected', 'Overall Rejection Rate']) AS "Metric",
 unnest(['2024-01-01 00:00', 'Kenya', 'Week 7', '3', CAST(n AS varchar), CAST(a AS varchar), CAST(r AS varchar), format('{:.1f}%', r / n * 100)]) AS "Value" FROM t""")
def a14(spark, sf):
    return A.report_metadata(weekly(spark, sf), "Kenya", "7", 3, "2024-01-01 00:00")


@add("f14_weekly_explorer", W + "SELECT Date, status, seller, flag, category FROM w WHERE status IN ('Rejected', 'Pending') AND contains(lower(seller), '#00000000')")
def f14(spark, sf):
    return A.explore(weekly(spark, sf), ["Rejected", "Pending"], "#00000000").drop("Day")
