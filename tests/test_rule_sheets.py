"""Rules without categories hold for every category, in each query that reads the sheets of brands and prohibited words."""

import duckdb
import pytest

import __spark_entry__ as registered
from driver_queries.views import cte

SHEETS = ("brand_sheet", "prohibited_sheet")
# a16_validation_kpis counts the verdicts of v04_verdict_nigeria.
READERS = """c02_restricted_brands c11_prohibited c11_highlight f08_flagged_rows f09_approved v02_match_key_expansion v03_first_flag
v04_verdict_kenya v04_verdict_nigeria v05_approved_rows v06_full_merge v07_v08_decisions v09_bulk_approve
v09_bulk_approve_counts v10_audit_export a17_flag_counts a17_top_flag q01_q02_issues q01_q02_issues_nigeria q03_q04_scores
q05_yes_no_flags q06_top_issues q07_quality_report q08_report_kpis q09_flag_breakdown f11_report_filter""".split()

# No size is a category that a sheet lists for these brands and names, now or by a narrower sheet; sizes of the
# pair 6 and 30 tell whether only one of two equal listings is flagged.
TABLES = {
    "part": """SELECT p AS p_partkey, 'blue ringss' AS p_name, b AS p_brand, 'SMALL BRASS' AS p_type, z AS p_size, 900.0 + p AS p_retailprice
FROM (VALUES (6, 'Brand#23', 34), (7, 'Brand#22', 5), (14, 'Brand#22', 35), (15, 'Brand#23', 1), (1, 'Brand#22', 1), (24, 'Brand#22', 4)) v(p, b, z)""",
    "supplier": """SELECT s AS s_suppkey, concat('Supplier#0000000', CASE s WHEN 13 THEN '03' ELSE CAST(20 + s AS varchar) END) AS s_name, CAST(n AS integer) AS s_nationkey
FROM (VALUES (5, 0), (10, 0), (13, 2), (25, 5), (55, 10)) v(s, n)""",
    "lineitem": """SELECT o AS l_orderkey, CAST(1 + o % 4 AS integer) AS l_linenumber, p_partkey AS l_partkey, s_suppkey AS l_suppkey,
 CAST(5 AS double) AS l_quantity, 5000.0 + o AS l_extendedprice, 0.05 AS l_discount, 0.02 AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus,
 DATE '1996-01-01' + CAST(o AS integer) AS l_shipdate FROM (SELECT *, row_number() OVER (ORDER BY k, p_partkey, s_suppkey) AS o
 FROM part, supplier, range(16) r(k))""",
    "orders": """SELECT l_orderkey AS o_orderkey, l_orderkey % 7 AS o_custkey, 'F' AS o_orderstatus, 100.0 AS o_totalprice,
 DATE '1996-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM lineitem""",
    "customer": "SELECT k AS c_custkey, concat('Customer#', k) AS c_name, 'BUILDING' AS c_mktsegment FROM range(7) r(k)",
    "nation": "SELECT CAST(k AS integer) AS n_nationkey, concat('N', k) AS n_name, 0 AS n_regionkey FROM range(25) r(k)",
    "region": "SELECT 0 AS r_regionkey, 'AFRICA' AS r_name",
}


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    for name, text in TABLES.items():
        con.sql(f"CREATE TABLE {name} AS {text}")
    return con


def emptied(text):
    for sheet in SHEETS:
        whole = cte(sheet)
        text = text.replace(whole, f"{sheet} AS (SELECT * FROM ({whole[len(sheet) + 5:-1]}) WHERE false)")
    return text


@pytest.mark.parametrize("name", READERS)
def test_rules_without_categories_count(rows, name):
    text = registered.oracle_sql()[name]
    assert emptied(text) != text
    assert sorted(map(repr, rows.sql(text).fetchall())) != sorted(map(repr, rows.sql(emptied(text)).fetchall()))


def test_equal_listings_of_two_categories_are_flagged_by_themselves(rows):
    """Brand#23 stands for all categories: neither of two equal listings has its flag from the other alone."""
    text = registered.oracle_sql()["v01_duplicate_expansion"]
    rows.sql("CREATE OR REPLACE TABLE part AS SELECT * FROM part UNION ALL SELECT 30, 'blue ringss', 'Brand#23', 'SMALL BRASS', 23, 930.0")
    rows.sql("""INSERT INTO lineitem SELECT l_orderkey, l_linenumber + 4, 30, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
 l_linestatus, l_shipdate FROM lineitem WHERE l_partkey = 6""")
    try:
        assert not [r for r in rows.sql(text).fetchall() if r[1] == 2]
    finally:
        rows.sql("DELETE FROM lineitem WHERE l_partkey = 30")
        rows.sql("DELETE FROM part WHERE p_partkey = 30")


@pytest.mark.parametrize("name", ["c02_restricted_brands", "c11_prohibited", "c11_highlight", "v04_verdict_kenya"])
def test_operators_over_whole_sheets(spark, rows, tmp_path, name):
    for table in TABLES:
        rows.sql(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    wanted = rows.sql(registered.oracle_sql()[name])
    got = registered.queries()[name](spark, str(tmp_path)).select(*wanted.columns).collect()
    assert len(got) and sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted.fetchall()))


def test_kpis_count_a_rejection_that_only_rules_without_categories_give(spark, tmp_path):
    """A Nigerian product with no other flag: rejected by a prohibited word for all categories, approved without the sheets."""
    con = duckdb.connect()
    own = {**TABLES, "part": """SELECT 5 AS p_partkey, 'blue ringss' AS p_name, 'Brand#22' AS p_brand, 'SMALL BRASS' AS p_type, 5 AS p_size,
 905.0 AS p_retailprice""", "lineitem": TABLES["lineitem"].replace("FROM (", "FROM (SELECT * REPLACE (3 AS o) FROM (", 1).replace(
        "range(16) r(k))", "range(1) r(k)) WHERE s_suppkey = 13)")}
    for name, text in own.items():
        con.sql(f"CREATE TABLE {name} AS {text}")
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    text = registered.oracle_sql()["a16_validation_kpis"]
    wanted = con.sql(text)
    assert con.sql(emptied(text)).fetchall() == [(1, 1, 0, 0.0, 0)] and wanted.fetchall() == [(1, 0, 1, 100.0, 0)]
    got = registered.queries()["a16_validation_kpis"](spark, str(tmp_path)).select(*wanted.columns).collect()
    assert list(map(tuple, got)) == [(1, 0, 1, 100.0, 0)]
