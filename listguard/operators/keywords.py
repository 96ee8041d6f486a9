"""Keyword rules against names: equality joins on each rule's rarest key, then the exact test.

A rule is found by its rarest word. Only where many rules share even their rarest word do they take two
words that follow each other, then three, and so on; the keys depend on the rules alone. Names are cut into
sequences of just the lengths in use, so pairs grow with the rules that a name nearly holds, not with the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listguard.functions import text as tx
from listguard.session import stage

# Marks the key of a word without word characters: its first character.
SIGN = "\u0001"
# Rules that may share a key before a longer one is tried, and copies of a rule that a frequent key's rows meet.
CROWD = 32
SALTS = 8
# Lists up to this many rules, written as SQL in this many characters, are tried inside the row; longer ones meet the rows by keys.
IN_ROW = 256
IN_ROW_SIZE = 256 << 10


def _literal(value, kind: T.DataType) -> str:
    """``value`` as SQL text; texts as bytes, so nothing has to be quoted."""
    if value is None:
        text = "NULL"
    elif isinstance(kind, T.StringType):
        return f"CAST(X'{value.encode().hex()}' AS string)"
    elif isinstance(kind, T.ArrayType):
        text = f"array({', '.join(_literal(v, kind.elementType) for v in value)})"
    elif isinstance(kind, T.StructType):
        text = f"named_struct({', '.join(f'{f.name!r}, {_literal(v, f.dataType)}' for f, v in zip(kind.fields, value))})"
    else:
        text = str(value)
    return f"CAST({text} AS {kind.simpleString()})"


def in_row(rules: DataFrame) -> tuple[Column, int] | None:
    """The rules as one constant array, which a row goes through by itself, and their number; None for long lists."""
    found = rules.limit(IN_ROW + 1).collect()
    text = _literal(found, T.ArrayType(rules.schema))
    return (F.expr(text), len(found)) if len(found) <= IN_ROW and len(text) <= IN_ROW_SIZE else None


def rarest_keys(words: DataFrame, options: Callable[[int], Column], size: Column, sizes: Callable[[int], int]
                ) -> tuple[DataFrame, list[int]]:
    """(word, _key) of every different ``word``, and the key lengths in use.

    ``options(n)`` lists a word's keys of length ``n`` and ``size`` is its own length; ``sizes(n)`` follows n. A word takes
    its rarest key, counted over the words, and goes on to longer ones while that is crowded. Each round
    holds the crowded words alone and is written.
    """
    pending, done, used, n = words.select("word").distinct(), None, [], sizes(0)
    while True:
        each = pending.select("word", F.explode(F.array_distinct(options(n))).alias("_key"))
        shared = each.groupBy("_key").agg(F.count("*").alias("n"))
        best = F.min(F.struct("n", "_key")).alias("b")
        picked = stage(each.join(shared, "_key").groupBy("word").agg(best)
                       .select("word", "b._key", ((F.col("b.n") > CROWD) & (size > n)).alias("crowded")), "keys")
        ready = picked.where("NOT crowded").select("word", "_key")
        done = ready if done is None else done.union(ready)
        used.append(n)
        pending = picked.where("crowded").select("word")
        if not pending.head(1):
            return done, used
        n = sizes(n)


def spread(rules: DataFrame) -> DataFrame:
    """Every rule SALTS times, for rows that carry a salt: a key of very many rows goes to several tasks."""
    return rules.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def salt(row_id: str) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int").alias("_salt")


def word_keys(rules: DataFrame, column: str) -> tuple[DataFrame, list[int]]:
    """(word, _key) for the texts of ``column``: word sequences, or the marked first character of a text without words."""
    words = rules.where(F.col(column) != "").select(F.col(column).alias("word"))
    tokens = tx.word_tokens(F.col("word"))

    def options(n: int) -> Column:
        sign = F.array(F.concat(F.lit(SIGN), F.substr("word", F.lit(1), F.lit(1))))
        return tx.let(tokens, lambda t: F.when(F.size(t) > 0, tx.sequences(t, n)).otherwise(sign))

    return rarest_keys(words, options, F.size(tokens), lambda n: n + 1)


def keyed_rules(rules: DataFrame, column: str) -> tuple[DataFrame, list[int]]:
    """Rules with the ``_key`` of their ``column`` and ``_salt``, written once, and the key lengths in use."""
    keys, used = word_keys(rules, column)
    met = rules.join(keys.withColumnRenamed("word", "_word"), F.col(column) == F.col("_word")).drop("_word")
    return spread(stage(met, "rules")), used


def signs(text: Column) -> Column:
    """The text's characters that are neither of words nor white."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)([^\w\s])"), F.lit(1)))


def text_keys(text: Column, used: list[int]) -> Column:
    """The text's word sequences of the lengths in use, and its other characters marked, which find wordless keywords."""
    marks = F.transform(signs(text), lambda c: F.concat(F.lit(SIGN), c))
    return tx.let(tx.word_tokens(text), lambda t: F.array_distinct(F.concat(*[tx.sequences(t, n) for n in used], marks)))


def word_sequence(text: Column) -> Column:
    """All words of the text, each between spaces."""
    return F.concat(F.lit(" "), F.array_join(tx.word_tokens(text), " "), F.lit(" "))


def row_pattern(words: Column, style: str) -> Column:
    """Pattern of one row's own candidate words, longest first; null without any."""
    ordered = F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b),
                                                      F.length(b) - F.length(a))
                           .when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(ordered, tx.quote_col)
    before, between, after = {"each": (r"(?iU)(\b", r"\b|\b", r"\b)"), "group": (r"(?iU)\b(", "|", r")\b"),
                              "bounded": (r"(?iU)(?<!\w)(", "|", r")(?!\w)")}[style]
    return F.when(F.size(words) > 0, F.concat(F.lit(before), F.array_join(quoted, between), F.lit(after)))


def _patterns_in_row(df: DataFrame, lists: list[tuple], row_id: str) -> tuple[DataFrame, dict[str, Column | None]]:
    """The part of ``attach_patterns`` for short lists: each row finds the words whose sequence its text contains."""
    made, patterns, words = {}, {}, {}
    for name, listed, text, style in lists:
        found = in_row(listed.where("word <> ''").select(
            "word", word_sequence(F.col("word")).alias("_seq"), F.substr("word", F.lit(1), F.lit(1)).alias("_sign")).distinct())
        if found is None:
            continue
        patterns[name] = None
        if not found[1]:
            continue
        held = words.setdefault(str(text), (f"_words_{len(words)}", F.struct(word_sequence(text).alias("w"), signs(text).alias("s"))))[0]
        own = tx.let(F.col(held), lambda t: F.filter(found[0], lambda x: F.when(
            F.trim(x["_seq"]) != "", F.contains(t["w"], x["_seq"])).otherwise(F.array_contains(t["s"], x["_sign"]))))
        made[f"_pat_{name}"] = F.when(F.col(row_id).isNotNull(), tx.let(
            F.transform(own, lambda x: x["word"]), lambda w: row_pattern(w, style)))
        patterns[name] = F.col(f"_pat_{name}")
    if not made:
        return df, patterns
    return df.withColumns(dict(words.values())).withColumns(made).drop(*[held for held, _ in words.values()]), patterns


def attach_patterns(df: DataFrame, lists: list[tuple], row_id: str = "PRODUCT_SET_SID",
                    source: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column | None]]:
    """Per word list the column with the pattern to try on each row, None for an empty list.

    ``lists`` has (name, words, text, style).  All lists, whatever their length, are joined at once on word
    sequences by row, so each row only tries the few words whose sequence its text contains; ``source`` is
    the table to take the texts from when ``df`` is already the result of joins.
    """
    df, short = _patterns_in_row(df, lists, row_id)
    lists = [x for x in lists if x[0] not in short]
    if not lists:
        return df, short
    texts = list({str(text): text for _, _, text, _ in lists}.items())
    of = {name: i for name, _, text, _ in lists for i, (key, _) in enumerate(texts) if key == str(text)}
    rules = None
    for name, words, _, _ in lists:
        some = words.select(F.lit(name).alias("list"), F.lit(of[name]).alias("src"), "word")
        rules = some if rules is None else rules.unionByName(some)
    rules, used = keyed_rules(rules.withColumn("_seq", word_sequence(F.col("word"))), "word")
    filled = {r[0] for r in rules.select("list").distinct().collect()}  # names of lists, which the caller wrote
    if not filled:
        return df, short | {name: None for name, *_ in lists}

    def sourced(src: int, text: Column) -> Column:
        return tx.let(word_sequence(text), lambda words: F.transform(text_keys(text, used), lambda k: F.struct(
            F.lit(src).alias("src"), k.alias("_key"), words.alias("_words"))))

    keys = F.concat(*[sourced(i, text) for i, (_, text) in enumerate(texts)])
    met = ((df if source is None else source).select(row_id, salt(row_id), F.inline(keys)).join(rules, ["src", "_key", "_salt"])
           .where(F.startswith("_key", F.lit(SIGN)) | F.contains("_words", F.col("_seq"))))
    found = met.groupBy(row_id).agg(*[
        row_pattern(F.collect_set(F.when(F.col("list") == name, F.col("word"))), style).alias(f"_pat_{name}")
        for name, _, _, style in lists if name in filled])
    return df.join(found, row_id, "left"), short | {
        name: F.col(f"_pat_{name}") if name in filled else None for name, *_ in lists}


def hit(text: Column, pattern: Column) -> Column:
    """True when the pattern occurs; a missing pattern means no candidate."""
    return F.coalesce(F.rlike(text, pattern), F.lit(False))


def first_match(text: Column, pattern: Column) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def every_match(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(0))


def containing(df: DataFrame, rules: DataFrame, column: str, text: str = "text") -> DataFrame:
    """Rows of ``df`` with each rule whose ``column`` occurs in ``text``; empty rules never match."""
    return candidates(df, rules, column, text).where(F.contains(F.col(text), F.col(column)))


def candidates(df: DataFrame, rules: DataFrame, column: str, text: str) -> DataFrame:
    """Rows of ``df`` with the rules that ``text`` may contain; no pair without a shared key is formed.

    Each rule is found by its rarest three neighbouring characters, counted over the rules (shorter rules by
    themselves), which every text that holds it has too; where these are crowded, by its rarest six, then twelve,
    and so on.
    """
    def cut(c: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(c) - F.lit(n) + 1)
        grams = F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, grams).otherwise(F.array().cast("array<string>"))

    own, size = F.col(column), F.length("word")
    words = rules.where(F.length(own) > 0).select(own.alias("word"))
    keys, _ = rarest_keys(words, lambda n: F.when(size >= n, cut(F.col("word"), n)).otherwise(F.array("word")), size,
                          lambda n: 2 * n or 3)
    keyed = spread(stage(rules.join(keys.withColumnRenamed("word", "_word"), own == F.col("_word")).drop("_word"), "rules"))
    # Lengths of keys: a few sizes, and those of rules shorter than the size they reached.
    lengths = sorted(r[0] for r in keyed.select(F.length("_key")).distinct().collect())
    if not lengths:
        return df.join(rules, F.lit(False))
    by_text = F.array_distinct(F.concat(*[cut(F.col(text), n) for n in lengths]))
    return (df.withColumn("_key", F.explode(by_text)).withColumn("_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
            .join(keyed, ["_key", "_salt"]).drop("_key", "_salt"))


def bounded_word(word: Column) -> Column:
    return F.concat(F.lit(r"(?iU)(?<!\w)"), tx.quote_col(word), F.lit(r"(?!\w)"))


def marked(c: Column) -> Column:
    """The text with a mark on both sides of every non-word character and at both ends.

    A marked word occurs in a marked text exactly where the word occurs in the text with no
    word character beside it, so a plain substring test replaces one pattern per row and rule.
    """
    mark = F.lit("\u0001")
    return F.concat(mark, F.regexp_replace(c, r"(?U)(\W)", "\u0001$1\u0001"), mark)


def brand_rules(rules: DataFrame) -> DataFrame:
    """Restricted-brand rules with their marked texts and their variations, longest first."""
    by_length = F.array_sort("variations", lambda x, y: F.when(
        F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    return rules.withColumns({"brand_marked": marked(F.col("brand")), "marks": F.transform("variations", marked),
                              "by_length": by_length})


def _brand_texts() -> dict[str, Column]:
    return {"n": F.lower(tx.as_text(F.col("NAME"))), "b": tx.lower_key(F.col("BRAND")), "s": tx.lower_key(F.col("SELLER_NAME")),
            "c": tx.clean_code(F.col("CATEGORY_CODE"))}


def _brand_found(row: Column, rule: Column) -> dict[str, Column]:
    """How the rule is met: by the brand itself, or by a variation in the brand or in the name."""
    return {"main": (row["b"] == rule["brand"]) | F.contains(row["mn"], rule["brand_marked"]),
            "vb": F.exists(rule["marks"], lambda v: F.contains(row["mb"], v)),
            "vn": F.exists(rule["marks"], lambda v: F.contains(row["mn"], v))}


def _brand_step(row: Column, rule: Column, met: dict[str, Column]) -> Column:
    where_found = F.when(met["vb"], row["b"]).otherwise(row["n"])
    var = tx.let(where_found, lambda t: F.get(F.filter(rule["by_length"], lambda v: F.contains(t, v)), F.lit(0)))
    rejects = (((F.size(rule["categories"]) == 0) | F.array_contains(rule["categories"], row["c"]))
               & ~F.array_contains(rule["sellers"], row["s"]))
    return F.struct(
        rule["rule_order"].alias("rule_order"), met["main"].alias("main"), rejects.alias("rejects"),
        F.size(rule["sellers"]).alias("n_sellers"),
        F.when(met["main"], rule["brand_raw"])
        .otherwise(F.concat(rule["brand_raw"], F.lit(" (as '"), var, F.lit("')"))).alias("label"))


def _brand_detail(steps: Column) -> Column:
    """Detail of the sorted steps of a row, null where no rule rejects it."""
    start = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("detail"))

    def fold(acc, x):
        label = F.when(x.main, x.label).otherwise(F.coalesce(acc.label, x.label))
        status = F.when(x.n_sellers > 0, F.lit("Seller not in approved list")).otherwise("No sellers approved")
        detail = F.when(x.rejects, F.concat(F.lit("Restricted Brand: "), label, F.lit(" - "), status)
                        ).otherwise(acc.detail)
        return F.struct(label.alias("label"), detail.alias("detail"))

    return F.aggregate(steps, start, fold).getField("detail")


def restricted_brand_detail(rules: Column) -> Column:
    """Detail of ``restricted_brand_hits`` for a row that goes through the ``brand_rules`` by itself."""
    texts = _brand_texts()
    row = F.struct(*[c.alias(k) for k, c in texts.items()], marked(texts["n"]).alias("mn"), marked(texts["b"]).alias("mb"))

    def met(r, x):
        found = _brand_found(r, x)
        return found["main"] | found["vb"] | found["vn"]

    steps = tx.let(row, lambda r: F.transform(F.filter(rules, lambda x: met(r, x)), lambda x: _brand_step(r, x, _brand_found(r, x))))
    return _brand_detail(F.array_sort(F.array_distinct(steps)))


def restricted_brand_hits(df: DataFrame, rules: DataFrame, row_id: str = "PRODUCT_SET_SID") -> DataFrame:
    """``row_id, detail`` of rows that break a restricted-brand rule.

    Rules meet rows by equality of word sequences (or of the whole brand), are confirmed on
    the marked texts, and are then folded in rule order: a match on the brand itself always
    renames the finding, a match on a variation only names it when nothing did before, and the
    last rejecting rule writes the detail.
    """
    rules = brand_rules(rules)
    rules = rules.withColumn("_rule", F.struct(*rules.columns))
    whole = F.concat(F.lit("="), F.col("brand"))
    words = F.array_union(F.array("brand"), F.col("variations"))
    by_word, used = keyed_rules(rules.select("_rule", F.explode(words).alias("_of")), "_of")
    by_brand = spread(rules.select("_rule", whole.alias("_key")))
    keyed = by_word.select("_rule", "_key", "_salt").unionByName(by_brand)
    probe = df.select(row_id, *[c.alias(k) for k, c in _brand_texts().items()])
    keys = F.array_union(F.array_union(text_keys(F.col("n"), used), text_keys(F.col("b"), used)),
                         F.array(F.concat(F.lit("="), F.col("b"))))
    row = F.struct("n", "b", "s", "c", marked(F.col("n")).alias("mn"), marked(F.col("b")).alias("mb"))
    met = (probe.select(row_id, row.alias("_row"), salt(row_id), F.explode(keys).alias("_key")).join(keyed, ["_key", "_salt"])
           .select(row_id, "_row", "_rule").withColumns(_brand_found(F.col("_row"), F.col("_rule"))).where("main OR vb OR vn"))
    step = _brand_step(F.col("_row"), F.col("_rule"), {c: F.col(c) for c in ("main", "vb", "vn")})
    steps = met.groupBy(row_id).agg(F.array_sort(F.collect_set(step)).alias("steps"))
    return steps.select(row_id, _brand_detail(F.col("steps")).alias("detail")).where("detail IS NOT NULL")


def _prohibited_text(k: Column) -> Column:
    """The keywords of the sorted (rule_order, keyword) list, without those that the text so far contains."""
    def fold(acc, x):
        return F.when(F.contains(acc, x.keyword), acc).otherwise(F.concat(acc, F.lit(" "), x.keyword, F.lit(",")))

    return F.regexp_replace(F.aggregate(k, F.lit("Prohibited:"), fold), ",+$", "")


def prohibited_rules(rules: DataFrame) -> DataFrame:
    return rules.where("keyword <> ''").select("rule_order", "keyword", "categories", marked(F.lower("keyword")).alias("_marked"))


def prohibited_found(rules: Column) -> Column:
    """Sorted (rule_order, keyword) of the rules, an array of ``prohibited_rules``, that a row meets; null without any."""
    row = F.struct(marked(F.lower(tx.as_text(F.col("NAME")))).alias("m"), tx.clean_code(F.col("CATEGORY_CODE")).alias("c"))
    found = tx.let(row, lambda r: F.filter(rules, lambda x: F.contains(r["m"], x["_marked"]) & (
        (F.size(x["categories"]) == 0) | F.array_contains(x["categories"], r["c"]))))
    pairs = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct(
        x["rule_order"].alias("rule_order"), x["keyword"].alias("keyword")))))
    return tx.let(pairs, lambda k: F.when(F.size(k) > 0, k))


def prohibited_detail(rules: Column) -> Column:
    """Detail of ``prohibited_hits`` for a row that goes through the rules by itself."""
    return _prohibited_text(prohibited_found(rules))


def prohibited_hits(df: DataFrame, rules: DataFrame, row_id: str = "PRODUCT_SET_SID") -> DataFrame:
    """``row_id, detail, highlighted`` of rows naming a prohibited keyword.

    The detail lists keywords in rule order, leaving out one already contained in the text so
    far; the name is marked with the last keyword found.
    """
    keyed, used = keyed_rules(rules.withColumn("_marked", marked(F.lower("keyword"))), "keyword")
    probe = df.select(row_id, tx.as_text(F.col("NAME")).alias("raw"),
                      tx.clean_code(F.col("CATEGORY_CODE")).alias("c"))
    met = (probe.select("*", marked(F.lower("raw")).alias("_m"), salt(row_id), F.explode(text_keys(F.col("raw"), used)).alias("_key"))
           .join(keyed, ["_key", "_salt"])
           .where(((F.size("categories") == 0) | F.array_contains("categories", F.col("c")))
                  & F.contains("_m", F.col("_marked"))))
    found = met.groupBy(row_id).agg(
        F.array_sort(F.collect_set(F.struct("rule_order", "keyword"))).alias("k"),
        F.any_value("raw").alias("raw"))
    last = F.element_at(F.col("k"), -1).getField("keyword")
    return found.select(
        row_id, _prohibited_text(F.col("k")).alias("detail"),
        F.regexp_replace(F.col("raw"), bounded_word(last), F.lit("[!]$0[!]")).alias("highlighted"))


def _plain(c: Column) -> Column:
    return tx.strip_ws(tx.squeeze(F.regexp_replace(F.lower(c), r"['.\-]", " ")))


def _goes_on(text: Column, i: Column) -> Column:
    """A letter or digit stands after the first ``i`` characters."""
    return F.coalesce(F.substr(text, i + 1, F.lit(1)).rlike(r"(?U)[\p{L}\p{N}]"), F.lit(False))


def known_brands(brands: DataFrame) -> DataFrame:
    return (brands.select(F.lower(tx.strip_ws(F.col("word"))).alias("brand")).where("brand <> ''").distinct()
            .withColumn("_key", _plain(F.col("brand"))).where("_key <> ''"))


def known_brand(brands: Column) -> Column:
    """Brand of ``known_brand_hits`` for a row that goes through the ``known_brands`` by itself; null without any."""
    met = tx.let(_plain(tx.as_text(F.col("NAME"))), lambda n: F.filter(
        brands, lambda x: F.startswith(n, x["_key"]) & ~_goes_on(n, F.length(x["_key"]))))
    return F.array_max(F.transform(met, lambda x: F.struct(F.length(x["brand"]).alias("l"), x["brand"].alias("brand"))))["brand"]


def known_brand_hits(df: DataFrame, brands: DataFrame, row_id: str = "PRODUCT_SET_SID") -> DataFrame:
    """``row_id, brand`` for names that start with a known brand; the longest brand wins."""
    known = stage(known_brands(brands), "brands")
    longest = known.agg(F.max(F.length("_key"))).head()[0] or 1
    probe = df.select(row_id, _plain(tx.as_text(F.col("NAME"))).alias("n"))
    cuts = F.filter(F.sequence(F.lit(1), F.least(F.length("n"), F.lit(longest))), lambda i: ~_goes_on(F.col("n"), i))
    starts = F.when(F.length("n") > 0, F.transform(cuts, lambda i: F.substr(F.col("n"), F.lit(1), i)))
    met = probe.select(row_id, salt(row_id), F.explode(starts).alias("_key")).join(spread(known), ["_key", "_salt"])
    return met.groupBy(row_id).agg(F.max_by("brand", F.struct(F.length("brand"), "brand")).alias("brand"))
