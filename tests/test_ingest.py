"""Preparation, sources, exports and the skew helpers."""

import random

import pytest
from pyspark.sql import functions as F

from listguard.functions import prices, text as tx, urls
from listguard.market import Market
from listguard.operators import analytics, audit, ingest, skew
from listguard.operators.verdict import VERDICT_COLUMNS
from listguard.session import stage
from listguard.sources import exports, files, rules as R


def test_fill_matches_plain_python_with_and_without_hot_keys(spark):
    random.seed(3)
    cols = ingest.SPREAD_COLUMNS
    data = [(f"s{random.choice([0, 0, 0, 1, 2])}", i, i // 7) + tuple(random.choice([None, None, str(i)]) for _ in cols)
            for i in range(150)]
    df = spark.createDataFrame(data, "PRODUCT_SET_SID string, _pos int, blk int, " + ", ".join(f"{c} string" for c in cols))
    pdf = df.toPandas()
    for c in cols:
        pdf[c] = pdf.groupby("PRODUCT_SET_SID")[c].transform(lambda x: x.ffill().bfill())
    want = pdf.sort_values("_pos")[cols].fillna("").values.tolist()
    for kwargs in ({}, {"block": "blk", "hot_rows": 10}, {"block": "blk"}):
        got = ingest.propagate_metadata(df, **kwargs).toPandas().sort_values("_pos")[cols].fillna("").values.tolist()
        assert got == want


@pytest.mark.parametrize("hot", [2, 1_000_000])
def test_attach_group_keeps_every_row(spark, hot):
    df = spark.createDataFrame([("a" if i % 3 else f"k{i}", i) for i in range(60)], "k string, i int")
    stats = df.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    out = skew.attach_group(df, stats, ["k"], ["i"], "n", hot).collect()
    assert len(out) == 60 and all(r.first == (1 if r.k == "a" else r.i) for r in out)


@pytest.mark.parametrize("least", [10, 1_000_000])
def test_number_rows(spark, least):
    df = spark.range(3000).select(F.concat(F.lit("s"), F.col("id")).alias("k"), (F.col("id") % 7).alias("v"))
    order = F.struct((-F.col("v")).alias("a"), F.col("k").alias("b"))
    got = skew.number_rows(df, order, "k", "rank", cuts=20, least=least).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 3001))
    assert [(r.v, r.k) for r in got] == sorted(((r.v, r.k) for r in got), key=lambda x: (-x[0], x[1]))


def listing(spark, rows):
    schema = "PRODUCT_SET_SID string, NAME string, BRAND string, CATEGORY_CODE string, ACTIVE_STATUS_COUNTRY string, COUNT_VARIATIONS string, _pos int"
    return spark.createDataFrame(rows, schema)


def test_prepare_counts_and_keeps_the_first_row(spark):
    df = listing(spark, [("a", "one", "b", "1", "shop-ke", None, 2), ("a", "two", "b", "1", "KE", "1", 1),
                         ("a", "three", "b", "1", " ke ", "1", 3), ("b", "x", "b", "1", "Multiple", "7", 4),
                         ("c", "x", "b", "1", "NG", "3.7", 5)])
    ke = ingest.prepare(df, "KE").collect()
    assert [(r.PRODUCT_SET_SID, r.NAME, r.COUNT_VARIATIONS) for r in ke] == [("a", "two", 3.0)]
    ng = {r.PRODUCT_SET_SID: (r._IS_MULTI_COUNTRY, r.COUNT_VARIATIONS) for r in ingest.prepare(df, "NG").collect()}
    assert ng == {"b": (True, 7.0), "c": (False, 3.7)}
    with pytest.raises(ValueError, match="Missing: BRAND"):
        ingest.prepare(df.drop("BRAND"), "KE")


def test_text_functions(spark):
    df = spark.createDataFrame([("o'neal-abc d2x", "\t x \n", "1,000", "New Rose-Gold  ring!")], "a string, b string, c string, d string")
    r = df.select(tx.title_case(F.col("a")).alias("t"), tx.strip_ws(F.col("b")).alias("s"), tx.num(F.col("c")).alias("n"),
                  tx.normalize_text(F.col("d")).alias("k"), F.array_join(tx.extract_colors(F.col("d")), ",").alias("c"),
                  tx.variant_tokens(F.lit("RedBlueXL42")).alias("v"), tx.ngrams(F.split(F.lit("a b c"), " "), 3).alias("g"),
                  prices.local_price(F.lit("3.5"), "Kenya").alias("p"), prices.local_price(F.lit("0"), "Kenya").alias("z"),
                  prices.discount_text(F.lit(None).cast("string"), F.lit("80"), F.lit("78")).alias("half"),
                  urls.sku_from_url(F.lit("https://x/y-AB123456789012-1234567NAFAMZ0ab-500ml.html")).alias("sku")).head()
    assert (r.t, r.s, r.n, r.k, r.c) == ("O'Neal-Abc D2X", "x", None, "rosegoldring", "pink,yellow")
    assert r.v == ["Red", "Blue", "XL", "42"] and r.g == ["a", "b", "c", "a b", "b c", "a b c"]
    assert (r.p, r.z, r.half, r.sku) == ("KSh 448", "", "2%", "1234567NAFAMZ0AB")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿cod_productset_sid;dsc_name\nx;Café\ny;B\n".encode())
    (tmp_path / "b.csv").write_bytes("cod_productset_sid,dsc_name,color\nz,Café – ok,red\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"cod_productset_sid\tdsc_name\nw,1\tH\xe9\x81\n")
    df = files.read_listings(spark, str(tmp_path / "*.csv"))
    got = [(r.PRODUCT_SET_SID, r.NAME, r.COLOR) for r in df.orderBy("_pos").collect()]
    assert got == [("x", "Café", None), ("y", "B", None), ("z", "Café – ok", "red"), ("w,1", "Hé\x81", None)]
    words = tmp_path / "words.txt"
    words.write_bytes(b"red \r\n\r\nblue\r\nred\r\n")
    assert sorted(r.word for r in R.read_list(spark, str(words)).collect()) == ["blue", "red"]


def test_grab_audit_and_weekly_sources(spark, tmp_path):
    (tmp_path / "grab.csv").write_text("sku|name|newPrice|Shop Express\n1|A|5|Yes\n")
    grab = files.read_grab(spark, str(tmp_path / "grab.csv")).head()
    assert (grab.PRODUCT_SET_SID, grab.GLOBAL_SALE_PRICE, grab.EXPRESS) == ("1", "5", "Yes")
    (tmp_path / "audit.csv").write_bytes("SKU;Name;Brand;Category;Price;Seller\n1;é;b;c;5;s\n".encode("latin-1"))
    assert files.read_audit(spark, str(tmp_path / "audit.csv")).head().Name == "é"
    week = tmp_path / "week"
    week.mkdir()
    (week / "ke_sets_2024-03-04.csv").write_text("Status,FLAG\nRejected,x\n")
    (week / "ng_undated.csv").write_text("Status,FLAG\nRejected,x\n")
    rows = files.read_weekly(spark, str(week / "*.csv")).collect()
    assert [(str(r.Date), r.Day, r.Country, r.Week) for r in rows] == [("2024-03-04", "Monday", "Kenya", 10)]


def test_weighted_keywords_in_both_forms(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"A > B": {"Red": 2, "blue": 1.5}}')
    (tmp_path / "l.json").write_text('[{"category_name": "X", "positive": {"k": 3}}, {"name": "Y"}]')
    got = {(r.category, r.keyword, r.weight) for f in ("m", "l")
           for r in R.weighted_keywords(spark, str(tmp_path / f"{f}.json")).collect()}
    assert got == {("a > b", "red", 2.0), ("a > b", "blue", 1.5), ("x", "k", 3.0)}


def test_exports(spark, tmp_path):
    v = spark.range(25).select(F.col("id").cast("string").alias("ProductSetSid"), F.lit("p").alias("ParentSKU"),
                               F.when(F.col("id") % 5 == 0, "Approved").otherwise("Rejected").alias("Status"),
                               F.lit("r").alias("Reason"), F.lit("cafÃ©").alias("Comment"), F.lit("f").alias("FLAG"),
                               F.lit("s").alias("SellerName"))
    listings = v.select(F.col("ProductSetSid").alias("PRODUCT_SET_SID"), F.lit("n").alias("NAME"))
    out = str(tmp_path / "out")
    exports.write_exports(v, listings, out)
    rejected = spark.read.csv(f"{out}/Rejected/ProductSets", header=True)
    assert rejected.columns == VERDICT_COLUMNS and rejected.count() == 20 and rejected.head().Comment == "café"
    full = spark.read.csv(f"{out}/Full/ProductSets", header=True)
    assert full.columns == exports.full_columns() and full.count() == 25
    exports.write_csv(v.repartition(1), f"{out}/parts", 10)
    parts = spark.read.csv(f"{out}/parts", header=True).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in parts) == [5, 10, 10]
    exports.write_weekly({"Cover Sheet": v.limit(1)}, f"{out}/weekly")
    files.save_prepared(v, f"{out}/prepared")
    assert files.load_prepared(spark, f"{out}/prepared").count() == 25
    assert stage(v, "x").count() == 25


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(path, w, h):
        def chunk(tag, data):
            body = tag + data
            return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))
        raw = b"".join(b"\x00" + b"\x00" * (w * 3) for _ in range(h))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                         + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    png(tmp_path / "a.png", 400, 700)
    png(tmp_path / "b.png", 700, 299)
    got = {r.origin.rsplit("/", 1)[-1]: r.warnings for r in audit.image_quality(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ["Tall (Screenshot?)"], "b.png": ["Low Resolution", "Wide Aspect"]}


def test_empty_week_day_and_ties(spark):
    df = spark.createDataFrame([("Monday", "Rejected", "b"), ("Monday", "Rejected", "a"), ("Tuesday", "Approved", "c")],
                               "Day string, status string, seller string")
    days = {r.Day: r["Daily Total"] for r in analytics.daily_summary(df).collect()}
    assert days["Sunday"] == 0 and days["Weekly Total"] == 3 and len(days) == 8
    v = df.select(F.col("status").alias("Status"), F.col("seller").alias("SellerName"))
    assert [(r.Rank, r.SELLER_NAME) for r in analytics.seller_summary(v).orderBy("Rank").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    assert analytics.worst_seller(df).head().seller == "a" and analytics.busiest_day(df).head().Day == "Monday"


def test_market_names_come_from_the_user(spark):
    market = Market(name="Bazaar", shop_prefix="BZ-", domains={"bazaar.test": "GH"})
    reasons = [r.reason for r in R.flag_dimension(spark, market).collect()]
    assert any("via Bazaar" in r for r in reasons) and not any("{" in r for r in reasons)
    df = spark.createDataFrame([("https://www.bazaar.test/p-AB12345678901.html", 1), (" S1-x", 2), ("S1", 3)], "line string, _pos int")
    got = {(r.sku, r.country_hint) for r in audit.lookup_inputs(df, market).collect()}
    assert got == {("AB12345678901", "GH"), ("S1", None)}
