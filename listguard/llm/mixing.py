"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listguard.llm.rows import WORD, keyed, uniform, unpacked, without
from listguard.llm.scratch import stage

#: Fractions that one reduction node takes on average, and copies of each source line for its join.
FAN_IN = 128
SALTS = 16


def words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """(source, source_size) with ``target``: the share by weight, at most ``most`` times the size.

    Sources go by code point, null last, and take the weights in turn. In order of size per weight the
    sources under the water line are full, so the line is the first that leaves the next source unfilled.
    One row per source: this table has the size of the list of sources, not of the data.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * F.lit(most)
    line = sizes.withColumn("__w", w).withColumn("__ratio", full / F.col("__w"))
    rising = Window.orderBy("__ratio", F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = line.withColumn("__level", (F.sum("source_size").over(whole) * F.lit(share)
                                       - F.coalesce(F.sum(full).over(before), F.lit(0.0)))
                           / F.sum("__w").over(onward))
    line = line.withColumn("__water", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level")))
                           .over(whole)["__level"])
    return line.select("source", "source_size",
                       F.least(full, F.coalesce(F.col("__water") * F.col("__w"), full)).alias("target"))


def _meet(held: Column, new: Column, seed: int) -> Column:
    """Two fractions meet: mass moves at random until one is 0 or 1, expectations stay.

    The result keeps the other fraction as ``kept`` and adds the settled one to ``done``.
    """
    a, b = held["kept"]["p"], new["p"]
    total = a + b
    u = uniform(held["kept"]["h"], held["kept"]["n"], new["h"], new["n"], seed=seed)
    low = total < 1
    # Which side settles: below 1 the loser falls to 0, else the winner rises to 1.
    held_settles = F.when(low, u * total >= a).otherwise(u * (2 - total) < 1 - b)
    rest = F.when(low, total).otherwise(total - 1)
    out = F.when(low, F.lit(0)).otherwise(F.lit(1))

    def kept(x: Column) -> Column:
        return F.struct(x["c"].alias("c"), x["h"].alias("h"), x["n"].alias("n"), rest.alias("p"))

    def settled(x: Column) -> Column:
        return F.array(F.struct(x["h"].alias("h"), x["n"].alias("n"), out.alias("one")))

    return (F.when(held["kept"].isNull(), F.struct(new.alias("kept"), held["done"].alias("done")))
            .otherwise(F.struct(F.when(held_settles, kept(new)).otherwise(kept(held["kept"])).alias("kept"),
                                F.concat(held["done"], F.when(held_settles, settled(held["kept"]))
                                         .otherwise(settled(new))).alias("done"))))


def _reduce(rows: DataFrame, node: list[str], seed: int) -> DataFrame:
    """One level of the tree: each node's fractions, by size, leave one ``kept`` and the ``done`` others."""
    item = F.struct(F.col("c"), F.col("h"), F.col("n"), F.col("p"))
    start = "struct(cast(null as struct<c:bigint,h:bigint,n:bigint,p:double>) as kept, " \
            "cast(array() as array<struct<h:bigint,n:bigint,one:int>>) as done)"
    gathered = rows.groupBy(*node).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return gathered.select(*node, F.aggregate("items", F.expr(start), lambda s, x: _meet(s, x, seed)).alias("r")) \
                   .select(*node, "r.kept", "r.done")


def mix(df: DataFrame, size: str = "size", source: str = "source", weights: tuple[float, ...] = (3, 1, 2),
        share: float = 1.5, most: float = 2.0, seed: int = 6) -> DataFrame:
    """Every row of ``df`` with ``source_size``, ``target`` (of its source) and ``copies`` (0 to 2).

    A row of a source owes target / source_size copies: the whole part is sure, the fraction is
    rounded. Fractions of rows of like size meet first, in nodes of about FAN_IN rows (source, size
    class, hash). Each node settles all but one; the rest go up the tree by source until each source
    has one left, which is rounded by itself. So a source's taken size keeps near its target.

    Null sources are one source, the last. Null or negative sizes count as 0; rows of size 0 take part
    like others. Equal rows are told apart by a running number. An empty table stays empty. Input
    columns named source_size, target or copies are replaced. All random numbers are hashes of the rows and
    ``seed``, so reruns agree whatever the files and partitions. Hot sources are split by size class and
    hash, and joined by salted keys; nothing is gathered but one node's fractions.
    """
    rows, keys = keyed(df)
    amount = F.greatest(F.coalesce(F.col("__in").getField(size).cast("long"), F.lit(0)), F.lit(0))
    narrow = (rows.select("__at", F.col("__in").getField(source).cast("string").alias("source"), amount.alias("c"))
              .join(keys, "__at").select("__at", F.col("__h").alias("h"), F.col("__n").alias("n"), "source", "c"))
    narrow = narrow.withColumn("band", F.floor(F.log2(F.col("c") + 1) * 4).cast("int"))
    bands = narrow.groupBy("source", "band").agg(F.sum("c").alias("band_size"), F.count(F.lit(1)).alias("band_rows"))
    bands = stage(bands, "bands")
    wanted = targets(bands.groupBy("source").agg(F.sum("band_size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = (bands.join(wanted.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
            .select("source", "band", "source_size", "target", F.floor(rate).cast("int").alias("sure"),
                    (rate - F.floor(rate)).alias("p"),
                    F.ceil(F.col("band_rows") / FAN_IN).alias("nodes"),
                    F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    spread = narrow.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
    facts = spread.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("band") == F.col("__band"))
                        & (F.col("salt") == F.col("__salt")))
    facts = stage(facts.select("__at", "h", "n", "source", "band", "c", F.col("__source_size").alias("source_size"),
                               F.col("__target").alias("target"), F.col("__sure").alias("sure"),
                               F.col("__p").alias("p"),
                               F.pmod(F.xxhash64(F.lit(seed), "h", "n"), F.col("__nodes")).alias("node")), "facts")

    level = stage(_reduce(facts.where("p > 0"), ["source", "band", "node"], seed), "level")
    settled = [level]
    while True:
        open_rows = level.select("source", "kept.*")
        counts = open_rows.groupBy("source").agg(F.count(F.lit(1)).alias("left"))
        most_left = counts.agg(F.max("left")).first()[0] or 0
        if most_left <= 1:
            break
        nodes = counts.select(F.col("source").alias("__s"), F.ceil(F.col("left") / FAN_IN).alias("nodes"))
        seed += 1
        up = (open_rows.join(nodes, F.col("source").eqNullSafe(F.col("__s")))
              .withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "h", "n"), F.col("nodes"))))
        level = stage(_reduce(up, ["source", "node"], seed), "level")
        settled.append(level)
    last = level.select("kept.h", "kept.n", (uniform("kept.h", "kept.n", seed=seed + 1) < F.col("kept.p"))
                        .cast("int").alias("one"))
    ones = last.where("one = 1")
    for each in settled:
        ones = ones.union(each.select(F.explode("done").alias("d")).select("d.h", "d.n", "d.one").where("one = 1"))
    taken = (facts.join(ones, ["h", "n"], "left")
             .select("__at", "source_size", "target",
                     (F.col("sure") + F.coalesce("one", F.lit(0))).alias("copies")))
    out = rows.join(taken, "__at")
    return unpacked(out, without(df, "source_size", "target", "copies"), "source_size", "target", "copies")


def mixture(df: DataFrame, text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mixed corpus: each row of ``df`` as often as :func:`mix` says, sized in words of ``text``."""
    sized = df.withColumn("__words", words(F.col(text)))
    mixed = mix(sized, "__words", source, **settings)
    again = mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return again.select(*df.columns)
