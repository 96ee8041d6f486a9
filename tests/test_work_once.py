"""Queries that read rows several times write them first; none leaves its whole work to one task."""

import duckdb
import pytest

import __spark_entry__ as registered
from driver_queries import views
from listguard.operators import audit, checks as C, review
from listguard.sources import exports
from tests.test_checks import book, found, rows
from tests.test_rule_sheets import TABLES


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    con, path = duckdb.connect(), tmp_path_factory.mktemp("tables")
    for name, text in TABLES.items():
        con.sql(f"CREATE TABLE {name} AS {text}")
        con.sql(f"COPY {name} TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def spied(monkeypatch, module, name, calls):
    real = getattr(module, name)

    def call(*args, **kwargs):
        calls.setdefault(name, []).append(args)
        return real(*args, **kwargs)
    monkeypatch.setattr(module, name, call)


def test_audit_flow_writes_rows_before_each_look(spark, tables, monkeypatch):
    calls = {}
    for name in ("enrich", "repair"):
        spied(monkeypatch, audit, name, calls)
    assert registered.queries()["audit_flow"](spark, tables).count() == 480
    for name in ("enrich", "repair"):
        assert "Window" not in plan(calls[name][0][0]) and "Join" not in plan(calls[name][0][0])


def test_exports_read_written_rows(spark, tables, monkeypatch):
    calls = {}
    spied(monkeypatch, exports, "write_exports", calls)
    assert registered.queries()["k01_k03_exports"](spark, tables).count() == 3 * 480
    assert "Window" not in plan(calls["write_exports"][0][0])


def test_parts_are_written_by_many_tasks(spark, tables, monkeypatch):
    calls = {}
    spied(monkeypatch, exports, "write_product_sets", calls)
    assert [tuple(r) for r in registered.queries()["k02_rows_per_part"](spark, tables).collect()] == [(480, True)]
    assert "Repartition 1, false" not in plan(calls["write_product_sets"][0][0])


def test_a_page_deals_only_its_columns(spark, tables, monkeypatch):
    calls = {}
    spied(monkeypatch, review, "page", calls)
    assert registered.queries()["f15_page"](spark, tables).count() == 40
    assert calls["page"][0][0].columns == ["PRODUCT_SET_SID", "NAME", "_pos"]


def test_compressed_exports_hold_the_same(spark, tmp_path):
    df = spark.range(25).selectExpr("CAST(id AS string) AS ProductSetSid")
    exports.write_csv(df, f"{tmp_path}/x", 10, compression="gzip")
    assert spark.read.csv(f"{tmp_path}/x", header=True).count() == 25 and len(list((tmp_path / "x").glob("*.csv.gz"))) >= 3


def test_tv_sellers_of_a_brand_are_met_one_by_one(spark, tables):
    assert sorted(views.tv_sellers(spark, tables).collect()) == sorted(views.view(spark, tables, "tv_seller").collect())
    joined = views.tv_sellers(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Aggregate") == 3  # repeats go before the join too
    rules = book(spark, "NG", category_role=[("5", "ng_tv")])
    rules.tables["ng_tv"] = spark.createDataFrame(
        [("sony", "a"), ("sony", "a"), ("sony", "b"), ("lg", None), (None, "a")], "brand string, seller string")
    df = rows(spark, {"BRAND": "Sony ", "SELLER_NAME": " A"}, {"BRAND": "sony", "SELLER_NAME": "c"}, {"BRAND": "LG", "SELLER_NAME": "a"},
              {"BRAND": "acme", "SELLER_NAME": "a"}, {"BRAND": None, "SELLER_NAME": None}, {"BRAND": "sony", "CATEGORY_CODE": "6", "SELLER_NAME": "c"},
              {"BRAND": "sony", "SELLER_NAME": None})
    assert found(df, rules, "NG - TV Brand Seller") == {
        s: f"Seller not authorised for {b} TVs: {n}" for s, b, n in (("s1", "SONY", "c"), ("s2", "LG", "a"), ("s6", "SONY", "nan"))}
    assert "collect_set" not in plan(C.check(df, rules, "NG - TV Brand Seller"))
