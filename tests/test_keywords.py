"""Keyword rules found by their rarest keys."""

from pyspark.sql import functions as F

from listguard.operators import keywords as K


def keys_of(spark, words):
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    keys, used = K.word_keys(frame, "word")
    return {r["word"]: r["_key"] for r in keys.collect()}, used


def test_a_rule_takes_its_rarest_word(spark):
    words = [f"the book of w{i}" for i in range(100)] + ["the", "the book", "+++", "", "Book of THE", "  the  w7 "]
    keys, used = keys_of(spark, words)
    assert all(keys[f"the book of w{i}"] == f"w{i}" for i in range(100) if i != 7)
    assert keys["+++"] == K.SIGN + "+" and "" not in keys and keys["the"] == "the"
    assert keys["Book of THE"] == "book of"  # each of its words is crowded, two of them are not
    assert used == [1, 2]
    assert keys_of(spark, []) == ({}, [1])


def test_crowded_words_go_on_to_longer_sequences(spark):
    words = [f"{a} {b} {c}" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]
    keys, used = keys_of(spark, words)
    assert used == [1, 2]  # a word is in 36 rules, two that follow each other in 6
    assert all(k in w and len(k) == 3 for w, k in keys.items())


def test_a_million_rules_against_names(spark):
    rules = spark.range(1_000_000).select(
        F.col("id").alias("rule_order"), F.format_string("item%d of part%d, the lot", "id", F.col("id") % 97).alias("keyword"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("7"))).otherwise(F.array().cast("array<string>")).alias("categories"))
    names = [f"Big ITEM{i} of part{i % 97}, the lot" for i in range(0, 60)]
    names += [f"item{i} of part{(i + 1) % 97}, the lot" for i in range(60, 90)] + ["of the lot", None, ""]
    rows = [(str(i), n, "7" if i % 3 else "8") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "PRODUCT_SET_SID string, NAME string, CATEGORY_CODE string")
    found = {r.PRODUCT_SET_SID: r.detail for r in K.prohibited_hits(df, rules).collect()}
    wanted = {str(i): f"Prohibited: item{i} of part{i % 97}, the lot" for i in range(60) if i % 2 or i % 3}
    assert found == wanted


def test_word_lists_of_all_lengths(spark):
    df = spark.createDataFrame([("1", "a very long name + more"), ("2", "name long"), ("3", None), ("4", "a.b very-long")],
                               "PRODUCT_SET_SID string, NAME string")
    words = spark.createDataFrame([("very long",), ("+",), ("long name",), ("a.b",)], "word string")
    none = words.where("false")
    out, patterns = K.attach_patterns(df, [("x", words, F.col("NAME"), "bounded"), ("y", none, F.col("NAME"), "each"),
                                           ("z", words.where("word = '+'"), F.lower("NAME"), "bounded")])
    assert patterns["y"] is None
    got = {r.PRODUCT_SET_SID: r.w for r in out.select("PRODUCT_SET_SID", K.every_match(F.col("NAME"), patterns["x"]).alias("w")).collect()}
    assert got == {"1": ["very long", "+"], "2": None, "3": None, "4": ["a.b"]}
    assert K.attach_patterns(df, [("y", none, F.col("NAME"), "each")])[1] == {"y": None}


def test_few_candidates_when_all_titles_share_their_words(spark):
    titles = spark.createDataFrame([(f"the story of the {i * 7919 % 1000:04d} and of the rest",) for i in range(1000)], "title string")
    texts = spark.createDataFrame([(i, f"new: the story of the {i:04d} and of the rest, used") for i in range(300)], "id int, text string")
    texts = texts.union(spark.createDataFrame([(1000 + i, "the story of the rest and of the story") for i in range(300)], texts.schema))
    met = K.candidates(texts, titles, "title", "text")
    assert K.containing(texts, titles, "title").count() == 300
    assert met.count() < 10 * 300


def test_containment_of_short_and_repeated_rules(spark):
    rules = spark.createDataFrame([("a",), ("ab",), ("abc",), ("",), (None,), ("abcabcabc",), ("é+",)], "title string")
    texts = spark.createDataFrame([(1, "xabcabcabcx"), (2, "ab"), (3, ""), (4, None), (5, "né+t"), (2, "ab")], "id int, text string")
    got = sorted((r.id, r.title) for r in K.containing(texts, rules, "title").collect())
    assert got == [(1, "a"), (1, "ab"), (1, "abc"), (1, "abcabcabc"), (2, "a"), (2, "a"), (2, "ab"), (2, "ab"), (5, "é+")]
