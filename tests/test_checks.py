"""Edge rows of the checks, on small invented listings and rules."""

import pytest
from pyspark.sql import functions as F

from listguard.operators import checks as C, keywords as K, verdict as V
from listguard.sources.rules import FLAG_ORDER, RuleBook

COLUMNS = ["PRODUCT_SET_SID", "NAME", "BRAND", "CATEGORY", "CATEGORY_CODE", "SELLER_NAME", "COLOR", "GLOBAL_PRICE",
           "GLOBAL_SALE_PRICE", "COUNT_VARIATIONS", "PARENTSKU"]


def rows(spark, *given):
    made = []
    for i, g in enumerate(given):
        base = {"PRODUCT_SET_SID": f"s{i}", "NAME": "plain thing", "BRAND": "Acme", "CATEGORY": "Home / X",
                "CATEGORY_CODE": "5", "SELLER_NAME": "shop", "COLOR": "red", "GLOBAL_PRICE": "100",
                "GLOBAL_SALE_PRICE": "50", "COUNT_VARIATIONS": "1", "PARENTSKU": "p"}
        base.update(g)
        made.append(tuple(base[c] for c in COLUMNS) + (i,))
    return spark.createDataFrame(made, ", ".join(f"{c} string" for c in COLUMNS) + ", _pos int")


def book(spark, country="KE", **tables):
    schemas = {"category_role": "code string, role string", "word_list": "list string, word string",
               "price_floor": "country string, brand string, category_code string, threshold double",
               "approved_seller": "kind string, country string, seller string",
               "keyword_rule": "kind string, country string, keyword string",
               "restricted_brand": "country string, rule_order int, brand string, brand_raw string, sellers array<string>, "
                                   "categories array<string>, variations array<string>",
               "prohibited": "country string, rule_order int, keyword string, categories array<string>",
               "ng_power_brand": "brand string",
               "ng_rice": "brand string, sellers array<string>, categories array<string>"}
    return RuleBook(spark, {n: spark.createDataFrame(v, schemas[n]) for n, v in tables.items()}, country=country)


def found(df, rules, flag, **kw):
    return {r.PRODUCT_SET_SID: r.DETAIL for r in C.check(df, rules, flag, **kw).collect()}


def test_null_name_is_one_word_and_null_brand_is_no_brand(spark):
    df = rows(spark, {"NAME": None}, {"BRAND": None, "NAME": "nan nan"})
    rules = book(spark, category_role=[("5", "weight")])
    assert set(found(df, rules, "Single-word NAME")) == {"s0"}
    assert set(found(df, rules, "Missing Weight/Volume")) == {"s0", "s1"}
    assert found(df, rules, "BRAND name repeated in NAME") == {}


def test_code_with_decimals_and_trimmed_brand(spark):
    df = rows(spark, {"CATEGORY_CODE": " 1000089.0 ", "BRAND": "\tGeneric\n", "NAME": "Sony-TV x"},
              {"CATEGORY_CODE": "1000089", "BRAND": "GENERIC"})
    rules = book(spark, category_role=[("1000089", "fashion")], word_list=[("known_brand", "Sony")])
    assert set(found(df, rules, "Generic BRAND Issues")) == {"s1"}
    assert found(df, rules, "Generic branded products with genuine brands") == {"s0": "Detected Brand: Sony"}


def test_accents_and_boundaries(spark):
    df = rows(spark, {"NAME": "éphone x"}, {"NAME": "my phone!"}, {"NAME": "pineapple", "BRAND": "apple"})
    rules = book(spark, prohibited=[("KE", 1, "phone", [])],
                 restricted_brand=[("KE", 1, "apple", "Apple", [], [], [])])
    assert found(df, rules, "Prohibited products") == {"s1": "Prohibited: phone"}
    assert set(found(df.where("BRAND <> 'apple'"), rules, "Restricted brands")) == set()
    assert set(found(df, rules, "BRAND name repeated in NAME")) == {"s2"}


def test_prices(spark):
    df = rows(spark, *[{"GLOBAL_PRICE": p, "GLOBAL_SALE_PRICE": p} for p in ("12d", "1,000", "")],
              {"GLOBAL_PRICE": "50", "GLOBAL_SALE_PRICE": "0"}, {"GLOBAL_PRICE": "50", "GLOBAL_SALE_PRICE": "39"})
    rules = book(spark, price_floor=[("KE", "acme", "5", 40.0)])
    assert set(found(df, rules, "Suspected Fake product")) == {"s0", "s1", "s2", "s4"}


def test_restricted_brand_fold(spark):
    rules = book(spark, restricted_brand=[
        ("KE", 1, "nike", "Nike", ["good"], [], ["air max", "nik"]), ("KE", 2, "puma", "Puma", [], [], []),
        ("KE", 3, "zed", "Zed", [], ["9"], [])])
    df = rows(spark, {"NAME": "nike and puma"}, {"NAME": "Air-Max Air max", "SELLER_NAME": "x"},
              {"NAME": "nike", "SELLER_NAME": " GOOD "}, {"NAME": "zed thing"}, {"BRAND": "Puma"})
    assert found(df, rules, "Restricted brands") == {
        "s0": "Restricted Brand: Puma - No sellers approved",
        "s1": "Restricted Brand: Nike (as 'air max') - Seller not in approved list",
        "s4": "Restricted Brand: Puma - No sellers approved"}


def test_prohibited_fold_and_highlight(spark):
    rules = book(spark, prohibited=[("KE", 1, "knife set", []), ("KE", 2, "knife", []), ("KE", 3, "c++", [])])
    df = rows(spark, {"NAME": "Knife set"}, {"NAME": "learn C++ now"})
    assert found(df, rules, "Prohibited products") == {"s0": "Prohibited: knife set", "s1": "Prohibited: c++"}
    marked = {r.PRODUCT_SET_SID: r.highlighted for r in K.prohibited_hits(df, rules.for_country("prohibited")).collect()}
    assert marked == {"s0": "[!]Knife[!] set", "s1": "learn [!]C++[!] now"}


@pytest.mark.parametrize("many", [False, True])
def test_long_word_lists_give_the_same(spark, many):
    extra = [("unnecessary", f"word{i}") for i in range(100)] if many else []
    rules = book(spark, word_list=[("unnecessary", "Buy Now"), ("unnecessary", "now")] + extra)
    df = rows(spark, {"NAME": "BUY now Now"}, {"NAME": "nowhere"}, {"NAME": "word7 x"})
    want = {"s0": "Unnecessary: buy now, now"}
    if many:
        want["s2"] = "Unnecessary: word7"
    assert found(df, rules, "Unnecessary words in NAME") == want


def test_capacity_quotes_the_first_match(spark):
    rules = book(spark, "NG", ng_power_brand=[("oraimo",), ("anker",)])
    df = rows(spark, {"NAME": "x 10,000mAh or 30000 mAh"}, {"NAME": "19999mah"}, {"NAME": "20000MAH", "BRAND": "Anker"})
    assert found(df, rules, "NG - Powerbank Capacity") == {
        "s0": "Brand 'Acme' not approved for 10,000mAh powerbanks. Approved: Anker, Oraimo"}


def test_empty_seller_lists(spark):
    rules = book(spark, "NG", category_role=[("5", "ng_gift")], ng_rice=[("acme", [], [])])
    df = rows(spark, {})
    assert found(df, rules, "NG - Gift Card Seller") == {}
    assert set(found(df, rules, "NG - Rice Brand Seller")) == {"s0"}


def test_duplicates_and_expansion(spark):
    same = {"NAME": "Red Ring", "BRAND": "Acme"}
    df = rows(spark, same, {**same, "NAME": "new red  ring"}, same, {"NAME": "other thing"})
    for hot in (1, 1_000_000):
        out = V.expand(C.run_checks(df, book(spark), ["Duplicate product"], hot_rows=hot), hot_rows=hot)
        masks = {r.PRODUCT_SET_SID: (r._mask != 0, r._final != 0) for r in out.collect()}
        assert masks == {"s0": (False, True), "s1": (True, True), "s2": (True, True), "s3": (False, False)}


def test_match_key_carries_restricted_brands_without_detail(spark):
    rules = book(spark, restricted_brand=[("KE", 1, "nike", "Nike", ["good"], [], [])])
    df = rows(spark, {"NAME": "Nike shoe", "SELLER_NAME": "bad"}, {"NAME": "New Nike shoe", "SELLER_NAME": "good"})
    out = V.verdict(V.expand(C.run_checks(df, rules, ["Restricted brands"])), rules)
    got = {r.ProductSetSid: (r.FLAG, "Restricted Brand: Nike" in r.Comment) for r in out.collect()}
    assert got == {"s0": ("Restricted brands", True), "s1": ("Restricted brands", False)}


def test_verdict_takes_first_flag_and_every_product_once(spark):
    df = rows(spark, {"NAME": "acme"}, {"NAME": "two words"}, {"BRAND": "generic", "CATEGORY": "Miscellaneous"})
    rules = book(spark)
    flagged = V.expand(C.run_checks(df, rules))
    out = {r.ProductSetSid: (r.Status, r.FLAG) for r in V.verdict(flagged, rules).collect()}
    assert out == {"s0": ("Rejected", "Single-word NAME"), "s1": ("Approved", ""), "s2": ("Rejected", "Wrong Category")}
    after = {r.ProductSetSid: r.FLAG for r in V.bulk_approve(flagged, rules, "Single-word NAME").collect()}
    assert after == {"s0": "BRAND name repeated in NAME"}


def test_lowest_bit(spark):
    masks = spark.createDataFrame([(1 << (o - 1),) for o in FLAG_ORDER.values()], "m bigint")
    got = [r[0] for r in masks.select(V.lowest_bit(F.col("m"))).collect()]
    assert got == list(FLAG_ORDER.values())


def test_keyword_plans_have_no_nested_loop(spark):
    rules = book(spark, prohibited=[("KE", 1, "phone", [])], word_list=[("known_brand", "Sony")],
                 restricted_brand=[("KE", 1, "apple", "Apple", [], [], ["mac"])])
    for flag in ("Restricted brands", "Prohibited products", "Generic branded products with genuine brands"):
        plan = C.run_checks(rows(spark, {}), rules, [flag])._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_order_independent_of_partitions(spark):
    df = rows(spark, *[{"NAME": f"ring {i % 3}"} for i in range(30)])
    one = V.verdict(V.expand(C.run_checks(df.repartition(1), book(spark))), book(spark))
    many = V.verdict(V.expand(C.run_checks(df.repartition(8), book(spark))), book(spark))
    assert sorted(one.collect()) == sorted(many.collect())
