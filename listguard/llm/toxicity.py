"""Toxicity by class-conditional Kneser-Ney models of the letters of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.llm.batches import small_batches
from listguard.llm.rows import quoted
from listguard.llm.scratch import clear, collected, stage

WORDS = re.compile(r"\w+")
#: For ASCII texts: every byte that is in no word becomes a space.
SPACED = bytes(b if WORDS.match(chr(b)) else 0x20 for b in range(256))
#: Letters of an expression, and the longest one whose counts both classes share.
ORDER = 6
SHARED = 2
#: Probability of an unseen letter, the range of discounts, and the occurrences that both classes' counts weigh in each.
UNSEEN = 1e-4
DISCOUNTS = (0.1, 0.95)
PRIOR = 2.0
#: Ridge of the two weights, small enough that few calibration rows still tell well separated classes apart.
RIDGE = 0.01
CLASSES = ("ordinary", "toxic")
#: The most frequent words, of at most LONG letters, whose scores tasks hold; all others get theirs by a join.
REMEMBERED = 200_000
LONG = 64
#: Words taken apart together, and turns (a power of two) in which expressions and words meet the counts.
GATHERED = 8192
PARTS = 2
#: Labelled documents that the two weights are fitted on.
CALIBRATION_ROWS = 20_000
#: Words that count as the worst of a document.
WORST = 3
#: Remainders of crc32(doc_id) modulo FOLDS: held out, and for calibration; the others are counted.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1

MIX = np.uint64(0x9E3779B97F4A7C15)
OPEN, CLOSE = 1, 2


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text; ASCII texts, most of them, are split without the expression."""
    text = (text or "").lower()
    return text.encode().translate(SPACED).decode().split() if text.isascii() else WORDS.findall(text)


class Letters:
    """The expressions of a list of words, side by side: hashes of each letter with the letters before it."""

    def __init__(self, words: list[str]) -> None:
        lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
        self.codes = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), lengths)
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def hashes(self, order: int) -> np.ndarray:
        """Hash of the last ``order`` letters up to each letter; only for places >= order - 1."""
        out = np.full(len(self.codes), order, np.uint64) * MIX
        for back in range(order - 1, -1, -1):
            shifted = np.r_[np.zeros(back, np.uint64), self.codes][:len(self.codes)]
            out = (out ^ shifted) * MIX
            out ^= out >> np.uint64(29)
        return out


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ordinary, toxic) of (text, toxic) rows, added up over up to REMEMBERED words before they leave the task."""
    def out(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = list(dict.fromkeys([*seen[0], *seen[1]]))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[
            pa.array([c.get(w, 0) for w in words], pa.int64()) for c in seen]], names=["word", "ordinary", "toxic"])

    seen = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            seen[int(toxic)].update(words_of(text))
        if len(seen[0]) + len(seen[1]) > REMEMBERED:
            yield out(seen)
            seen = (Counter(), Counter())
    yield out(seen)


def expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, context, suffix, start, size, ordinary, toxic): the words' expressions up to ORDER letters, by batch.

    ``start`` marks expressions at a word's beginning, which nothing can precede.
    """
    names = ["g", "context", "suffix", "start", "size", "ordinary", "toxic"]
    for batch in batches:
        letters = Letters(batch["word"].to_pylist())
        weight = [batch[c].to_numpy(zero_copy_only=False)[letters.word] for c in ("ordinary", "toxic")]
        hashed = [np.zeros(len(letters.codes), np.uint64), *map(letters.hashes, range(1, ORDER + 1))]
        parts = []
        for k in range(1, ORDER + 1):
            at = np.flatnonzero((letters.place >= k - 1) & (letters.place >= 1))
            g, first, back = np.unique(hashed[k][at], return_index=True, return_inverse=True)
            before = at[first]
            parts.append([g, hashed[k - 1][before - 1] if k > 1 else np.zeros(len(g), np.uint64), hashed[k - 1][before],
                          letters.place[before] == k - 1, np.full(len(g), k, np.int32),
                          *[np.bincount(back, w[at]).astype(np.int64) for w in weight]])
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else []
        columns = [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def count_tables(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kneser-Ney counts from (text, toxic) rows: by expression and by context.

    Full expressions and those at a word's beginning count by occurrence; shorter ones by the distinct
    letters before them. Up to SHARED letters both classes share their sum.
    """
    words = (train.mapInArrow(word_counts, "word string, ordinary bigint, toxic bigint").groupBy("word")
             .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    kinds = "g bigint, context bigint, suffix bigint, start boolean, size int, ordinary bigint, toxic bigint"
    counted = (words.mapInArrow(expressions, kinds).groupBy("g")
               .agg(*[F.first(c).alias(c) for c in ("context", "suffix", "start", "size")],
                    F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    with collected() as written:
        counted = stage(counted, "expressions")
    # Letters before: one for each longer expression that ends in this one, in each class.
    before = counted.where("size > 1").groupBy(F.col("suffix").alias("g")).agg(
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"b_{c}") for c in ("ordinary", "toxic")])
    raw = F.col("start") | (F.col("size") == ORDER)
    each = counted.join(before, "g", "left").select("g", "context", "size", *[
        F.when(raw, F.col(c)).otherwise(F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in ("ordinary", "toxic")])
    both = F.col("ordinary") + F.col("toxic")
    each = each.select("g", "context", "size", *[F.when(F.col("size") <= SHARED, both).otherwise(F.col(c)).alias(c)
                                                 for c in ("ordinary", "toxic")])
    each = stage(each, "counts")
    clear(train.sparkSession, written)
    n = together()
    contexts = each.groupBy("context").agg(*[F.sum(c).alias(f"n_{c}") for c in CLASSES], F.sum(n).alias("n"),
                                           F.count(F.when(n > 0, 1)).alias("kinds"))
    return each, contexts


def together() -> Column:
    """Both classes' count of an expression; where the classes share their counts, each has it already."""
    return F.when(F.col("size") <= SHARED, F.col("ordinary")).otherwise(F.col("ordinary") + F.col("toxic"))


def discounts(each: DataFrame) -> np.ndarray:
    """Discounts by size, from the expressions counted once and twice in both classes together."""
    out = np.full(ORDER + 1, 0.75)
    for r in each.groupBy("size").agg(*[F.count(F.when(together() == n, 1)).alias(f"c{n}") for n in (1, 2)]).collect():
        if r["c1"]:
            out[r["size"]] = np.clip(r["c1"] / (r["c1"] + 2 * r["c2"]), *DISCOUNTS)
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches some thousand rows at a time."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= GATHERED:
            yield pa.Table.from_batches(waiting)
            waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting)


def all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of texts, added up over up to REMEMBERED words before they leave the task."""
    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                          names=["word", "n"])

    seen = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            seen.update(words_of(text))
        if len(seen) > REMEMBERED:
            yield out(seen)
            seen = Counter()
    yield out(seen)


def asked(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """(g, context, suffix, size, start): the expressions of words that a score needs, once for each table of words.

    ``start`` marks expressions at a word's beginning. Only those whose hash falls into the ``part`` of PARTS.
    """
    for table in gathered(batches):
        letters = Letters(table["word"].to_pylist())
        hashed = [np.zeros(len(letters.codes), np.uint64), *map(letters.hashes, range(1, ORDER + 1))]
        parts = []
        for k in range(1, ORDER + 1):
            at = np.flatnonzero((letters.place >= k - 1) & (letters.place >= 1))
            at = at[hashed[k][at] >> np.uint64(32) & np.uint64(PARTS - 1) == part]
            g, first = np.unique(hashed[k][at], return_index=True)
            ends = at[first]
            parts.append([g, hashed[k - 1][ends - 1] if k > 1 else np.zeros(len(g), np.uint64), hashed[k - 1][ends],
                          np.full(len(g), k, np.int32), letters.place[ends] == k - 1])
        g, context, suffix, size, start = (np.concatenate(c) for c in zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (g, context, suffix)] +
                                         [pa.array(size), pa.array(start)], names=["g", "context", "suffix", "size", "start"])


def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, g): the longest expression that ends at each letter of the word numbered ``w``."""
    for table in gathered(batches):
        letters = Letters(table["word"].to_pylist())
        g = np.zeros(len(letters.codes), np.uint64)
        for k in range(2, ORDER + 1):
            g = np.where(letters.place >= k - 1, letters.hashes(k), g)
        inner = letters.place >= 1
        yield pa.RecordBatch.from_arrays([pa.array(table["w"].to_numpy()[letters.word[inner]]),
                                          pa.array(g[inner].view(np.int64))], names=["w", "g"])


def word_ratios(train: DataFrame, words: DataFrame) -> DataFrame:
    """(w, ratio): log P(word | toxic) - log P(word | ordinary) of the distinct ``words`` (w, word).

    After a context, the discount taken from the counts of both classes together is the weight of the next shorter
    order; both classes share it, so an expression that neither has seen tells nothing of the class. The rest goes to the
    letters by the class's own counts, with the shares of both classes weighing in as PRIOR occurrences. So the
    probabilities of a class that knows the context add up to one. A class that does not know it takes the shorter order
    for the letters that the other has seen there, and with the shared weight for all others: at most one in all.

    Counts stay in tables keyed by the whole 64-bit hash of an expression and grow with the input. Each
    distinct expression of the words meets its count and its context's once; then every order takes the
    probability of the next shorter one by a join, so no key is hotter than the letters are many. Tables
    go once the next one is written, and the widest joins run in PARTS turns, so that less is on disk at a time.
    """
    spark = words.sparkSession
    with collected() as counted:
        each, contexts = count_tables(train)
    cut = discounts(each)
    with collected() as sized:
        contexts = stage(contexts, "contexts")
    d = F.array(*[F.lit(float(x)) for x in cut])[F.col("size")]
    rest, share = d * F.col("kinds") / F.col("n"), F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("n")
    columns, unseen = [], F.coalesce((F.col("c") == 0) & (F.col("n") > 0), F.lit(False))
    for c, name in enumerate(CLASSES):
        known = F.coalesce(f"n_{name}", F.lit(0)) > 0
        seen = ((1 - rest) * F.coalesce(name, F.lit(0)) + PRIOR * share) / (F.col(f"n_{name}") + PRIOR)
        columns += [F.when(known, seen).otherwise(0.0).alias(f"seen{c}"), F.when(known | unseen, rest).otherwise(1.0).alias(f"rest{c}")]
    met, counted = [], counted + sized
    with collected() as sized:
        for part in range(PARTS):
            needed = words.select("word").mapInArrow(
                lambda b, p=part: asked(b, p), "g bigint, context bigint, suffix bigint, size int, start boolean").groupBy("g").agg(
                *[F.first(c).alias(c) for c in ("context", "suffix", "size", "start")])
            mine = each.where(F.shiftright("g", 32).bitwiseAND(PARTS - 1) == part).select("g", *CLASSES)
            joined = (needed.join(mine, "g", "left").withColumn("c", F.coalesce(together(), F.lit(0)))
                      .join(contexts, "context", "left"))
            met.append(stage(joined.select("g", "suffix", "start", "size", *columns), "met", by="size"))
    clear(spark, counted)
    met = reduce(DataFrame.union, met)
    ratio = (F.log(F.col("p1") + 1e-12) - F.log(F.col("p0") + 1e-12)).alias("ratio")
    tops, shorter, last = [], None, []
    for k in range(1, ORDER + 1):
        mine = met.where(F.col("size") == k)
        if shorter is None:
            mine = mine.withColumns({f"p{c}": F.lit(UNSEEN) for c in (0, 1)})
        else:
            mine = mine.join(shorter.select(F.col("g").alias("suffix"), "p0", "p1"), "suffix")
        mine = mine.select("g", "start", *[(F.col(f"seen{c}") + F.col(f"rest{c}") * F.col(f"p{c}")).alias(f"p{c}") for c in (0, 1)])
        with collected() as written:
            shorter = stage(mine if k < ORDER else mine.select("g", ratio), "order")
        clear(spark, last + [f"{path}/size={k}" for path in sized])
        last = written
        if k == ORDER:
            tops.append(shorter)
        elif k > 1:  # the longest expression of a letter is shorter than ORDER at a word's beginning alone
            tops.append(stage(shorter.where("start").select("g", ratio), "tops"))
    tops, ratios = reduce(DataFrame.union, tops), []
    for part in range(PARTS):
        mine = words.where(F.col("w").bitwiseAND(PARTS - 1) == part).select("w", "word")
        letters = mine.mapInArrow(longest, "w bigint, g bigint")
        ratios.append(stage(letters.join(tops, "g").groupBy("w").agg(F.sum("ratio").alias("ratio")), "ratios"))
    clear(spark, last)
    return reduce(DataFrame.union, ratios)


KNOWN = "struct<total:double,letters:bigint,worst:array<double>,rare:array<struct<word:string,n:int>>>"
ARROW_KNOWN = pa.struct([("total", pa.float64()), ("letters", pa.int64()), ("worst", pa.list_(pa.float64())),
                         ("rare", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))])


def lists(ends: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)


def known_parts(texts: list[str | None], ratio: dict[str, float]) -> pa.Array:
    """What the frequent words say of each text, and its other words with their numbers."""
    totals, letters, worst, worst_ends, rare, times, rare_ends = [], [], [], [], [], [], []
    for text in texts:
        words = words_of(text)
        scores = np.fromiter(map(ratio.get, words, repeat(np.nan)), np.float64, len(words))  # nan: the other words
        other = np.isnan(scores)
        if other.any():
            counted = Counter([words[i] for i in np.flatnonzero(other)])
            rare += counted
            times += counted.values()
            scores = scores[~other]
        totals.append(scores.sum())
        letters.append(len("".join(words)) + len(words))
        worst += (np.partition(scores, -WORST)[-WORST:] if len(scores) > WORST else scores).tolist()
        worst_ends.append(len(worst))
        rare_ends.append(len(rare))
    rows = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int32())], names=["word", "n"])
    return pa.StructArray.from_arrays([pa.array(totals, pa.float64()), pa.array(letters, pa.int64()),
                                       lists(worst_ends, pa.array(worst, pa.float64())), lists(rare_ends, rows)],
                                      fields=list(ARROW_KNOWN))


def features(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """``rows`` (with ``at`` and ``f``, the known part) with ``mean`` and ``worst``: rare words' ratios by a join."""
    rare = rows.select("at", F.explode("f.rare").alias("r")).select("at", F.xxhash64("r.word").alias("w"), F.col("r.n").alias("n"))
    found = rare.join(ratios, "w").groupBy("at").agg(
        F.sum(F.col("ratio") * F.col("n")).alias("more"), F.collect_list(F.struct("ratio", "n")).alias("list"))
    most = F.slice(F.sort_array(F.flatten(F.transform("list", lambda x: F.array_repeat(
        x["ratio"], F.least(x["n"], F.lit(WORST))))), asc=False), 1, WORST)
    found = stage(found.select(F.col("at").alias("__at"), "more", most.alias("most")), "rare")
    joined = rows.join(found, F.col("at") == F.col("__at"), "left")
    worst = F.slice(F.sort_array(F.concat("f.worst", F.coalesce("most", F.array().cast("array<double>"))), asc=False), 1, WORST)
    return joined.select(
        *rows.columns, ((F.col("f.total") + F.coalesce("more", F.lit(0.0))) / F.greatest(F.col("f.letters"), F.lit(1))).alias("mean"),
        (F.aggregate(worst, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0))) / WORST).alias("worst"))


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (bias first) of standardised features, by Newton steps with a small ridge."""
    z = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0, *[RIDGE] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   label: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Labelled documents outside the held-out and calibration folds are counted whole: every expression of
    up to ORDER letters inside words, by class, smoothed the Kneser-Ney way; the shortest share their
    counts between classes, and all share the weights of falling back, so rare expressions rest on common ground. No count is shared by hash slots
    or dropped: the tables grow with the input and meet the distinct words by joins. A document's features are its
    log-likelihood ratio (toxic against ordinary) a letter, and that of its worst words. Two weights and
    a bias turn them into the score; they are fitted on at most CALIBRATION_ROWS labelled rows of the
    calibration fold.

    Labels are joined by id and never enter a score otherwise. Several labels of an id count as the highest,
    null labels and ids as none. Null and empty texts have ratio 0 and get the score of that. Without labels
    of both classes every score is 0. Repeated rows get equal scores, an empty table stays empty, and input
    columns named held_out, score or predicted are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    names = [c for c in (keep or df.columns) if c.lower() not in ("held_out", "score", "predicted")]
    marked = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__l"))
              .agg(F.max((F.col(label) > 0).cast("int")).alias("toxic")))
    part = fold(F.col(doc_id))
    counted = df.where(~part.isin(HELD_OUT, CALIBRATION)).select(F.col(doc_id).alias("__d"), F.col(text).alias("text"))
    train = counted.join(marked.where(~fold(F.col("__l")).isin(HELD_OUT, CALIBRATION)), F.col("__d") == F.col("__l"))
    words = (df.select(F.col(text).alias("text")).mapInArrow(all_words, "word string, n bigint").groupBy("word")
             .agg(F.sum("n").alias("n")))
    words = stage(words.select(F.xxhash64("word").alias("w"), "word", "n"), "words")
    ratios = word_ratios(train.select("text", "toxic"), words)
    frequent = words.where(F.length("word") <= LONG).orderBy(F.desc("n"), "word").limit(REMEMBERED).join(ratios, "w")
    frequent = frequent.select("word", "ratio").toArrow()
    held = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), frequent["ratio"].to_pylist())))

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield known_parts(batch.to_pylist(), held.value)

    rows = stage(df.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("__in"), F.col(doc_id).alias("__id"),
                           F.monotonically_increasing_id().alias("at"), F.arrow_udf(scored, KNOWN)(F.col(text)).alias("f")), "features")
    rows = features(rows, ratios)
    sample = (rows.where(fold(F.col("__id")) == CALIBRATION).join(marked, F.col("__id") == F.col("__l"))
              .select(F.xxhash64("__id").alias("h"), "mean", "worst", "toxic")
              .orderBy("h", "mean", "worst").limit(CALIBRATION_ROWS).toPandas())
    x, y = sample[["mean", "worst"]].to_numpy(dtype=float), sample["toxic"].to_numpy(dtype=float)
    if 0 < y.sum() < len(y):
        scale = x.std(axis=0) + 1e-9
        w = calibrate(x / scale, y)
        bias, weights = float(w[0]), w[1:] / scale
        logit = F.lit(bias) + F.col("mean") * float(weights[0]) + F.col("worst") * float(weights[1])
        score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))
    else:
        score = F.lit(0.0)
    out = rows.withColumn("score", score)
    return out.select(*[F.col("__in").getField(c).alias(c) for c in names], (fold(F.col("__id")) == HELD_OUT).alias("held_out"),
                      "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
