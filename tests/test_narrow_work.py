"""Short rule lists are tried inside the row, and only the columns that a query reads travel."""

import re

import pytest
from pyspark.sql import functions as F

from listguard.operators import audit, checks as C, ingest, keywords as K, report
from listguard.sources.rules import RuleBook
from tests.test_checks import book, rows

RULES = {
    "category_role": [("5", "sneaker"), ("5", "color"), ("5", "jersey"), ("5", "book")],
    "restricted_brand": [("KE", 1, "nike", "Nike", ["good"], [], ["air max", "nik"]), ("KE", 2, "puma", "Puma", [], ["5"], []),
                         ("KE", 3, "c++", "C++", [], [], []), ("NG", 1, "acme", "Acme", [], [], [])],
    "prohibited": [("KE", 1, "knife set", []), ("KE", 2, "knife", []), ("KE", 3, "+", ["5"]), ("KE", 4, "it's", ["6"])],
    "word_list": [("known_brand", "Sony"), ("known_brand", "Sony-Tv"), ("sneaker_brand", "ny"), ("unnecessary", "new"), ("unnecessary", "★"),
                  ("color", "red")],
    "keyword_rule": [("jersey", "KE", "it's \\ new"), ("refurb", "KE", "old")],
}
NAMES = ["Nike and puma", "Air-Max Air max", "nik c++", "Knife set + it's", "sony.tv x", "Sony Tvs", "it's \\ new ★", None, "", "red KNIFE"]


def listings(spark):
    given = [{"NAME": n, "BRAND": b, "SELLER_NAME": s, "COLOR": None} for n in NAMES for b in ("Generic", "puma", None) for s in ("Good", "x")]
    df = rows(spark, *given)
    return df.union(df.limit(2).withColumn("PRODUCT_SET_SID", F.lit(None).cast("string")))


def found(df):
    return sorted((str(r.PRODUCT_SET_SID), sorted((x.ord, str(x.detail)) for x in r._found)) for r in df.collect())


def books(spark):
    return {"ng_book": spark.createDataFrame([(2, "ny", "good"), (1, "knife", None), (3, "", None)], "rule_order int, title string, seller string")}


def rule_book(spark, country):
    made = book(spark, country, **RULES)
    return RuleBook(spark, {**made.tables, **books(spark)}, country=country)


def exchanges(df):
    return re.findall(r"Exchange (?:hash|range)partitioning\(PRODUCT_SET_SID", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("country", ["KE", "NG"])
def test_rows_and_joins_find_the_same(spark, monkeypatch, country):
    df = listings(spark)
    short = C.run_checks(df, rule_book(spark, country), use_paths=False)
    got = found(short)
    monkeypatch.setattr(K, "IN_ROW", -1)
    assert found(C.run_checks(df, rule_book(spark, country), use_paths=False)) == got
    assert {o for _, xs in got for o, _ in xs} >= ({2, 11, 12, 18, 9} if country == "KE" else {24, 12})


def test_short_lists_need_no_shuffle(spark):
    """a16_validation_kpis, q01_q02_issues and all others that run the checks sent each text once per key."""
    df = rows(spark, {"NAME": "Nike"}, {"NAME": None})
    flags = ["Restricted brands", "Prohibited products", "Unnecessary words in NAME", "Missing COLOR", "Suspected counterfeit Jerseys",
             "Generic branded products with genuine brands", "Counterfeit Sneakers"]
    assert exchanges(C.run_checks(df, rule_book(spark, "KE"), [*flags, "Duplicate product"]))
    assert not exchanges(C.run_checks(df, rule_book(spark, "KE"), flags))


def test_long_lists_still_join(spark):
    rules = book(spark, prohibited=[("KE", i, f"word{i}", []) for i in range(K.IN_ROW + 1)])
    assert C.in_row_rules(rules, "Prohibited products") is None
    df = rows(spark, {"NAME": "a word7 b"}, {"NAME": "word"})
    assert found(C.run_checks(df, rules, ["Prohibited products"])) == [("s0", [(11, "Prohibited: word7")]), ("s1", [])]


@pytest.mark.parametrize("code", [None, "NG"])
def test_only_the_wanted_columns_are_shuffled(spark, code):
    df = spark.createDataFrame([("a", "one", "b", "1", "NG", None, "long text", 1), ("a", "two", "b", "1", "KE", "4", "long text", 2)],
                               "PRODUCT_SET_SID string, NAME string, BRAND string, CATEGORY_CODE string, ACTIVE_STATUS_COUNTRY string, "
                               "COUNT_VARIATIONS string, MAIN_IMAGE string, _pos int")
    out = ingest.prepare(df, code, columns=["PRODUCT_SET_SID", "NAME", "COUNT_VARIATIONS"])
    assert out.columns == ["PRODUCT_SET_SID", "NAME", "COUNT_VARIATIONS"]
    assert [tuple(r) for r in out.collect()] == [("a", "one", 4.0)]
    whole = ingest.prepare(df, code)
    assert whole.select(*out.columns).collect() == out.collect() and whole.head().MAIN_IMAGE == "long text"
    # Only the reading of the rows names the column.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "MAIN_IMAGE" in line and ("Exchange" in line or "Aggregate" in line)]


def test_a_check_prepares_what_it_reads():
    assert C.columns_read(["Seller Not approved to sell Refurb"]) == ["PRODUCT_SET_SID", "CATEGORY_CODE", "NAME", "SELLER_NAME"]
    assert "_pos" in C.columns_read() and "_pos" in C.columns_read(["Duplicate product"])


def test_issues_are_found_once_and_without_long_texts(spark):
    df = rows(spark, {"NAME": "acme"}, {"NAME": "acme two"}, {"NAME": "x y z"}).withColumn("DESCRIPTION", F.element_at(
        F.array(F.lit("again"), F.lit("again"), F.lit("  ")), F.col("_pos") + 1))
    out = report.issue_rows(report.find_issues(df, book(spark)))
    assert sorted(r.sid for r in out.where("flag = 'Repeated Description'").collect()) == ["s0", "s1"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in "".join(line for line in plan.splitlines() if "Filter" in line)


def test_blank_descriptions_do_not_meet(spark):
    """Rows without a text were dealt to one task, as all of them had one digest."""
    df = spark.range(40).select(F.col("id").cast("string").alias("PRODUCT_SET_SID"), F.when(F.col("id") % 2 == 0, " ").alias("DESCRIPTION"))
    assert audit.repeated_description(df).where("_repeated").count() == 0
