"""Chat formatting after collapse of cumulative snapshots, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listguard.llm.rows import row_hash
from listguard.llm.scratch import stage

#: Turns in one row of rendered text.
TURNS_PER_PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _rendered(role: Column, text: Column) -> Column:
    """One turn between its markers; markers inside the text are broken up, so turns can't be forged."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_(start|end)\|>", "<| im_$1 |>")
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), body, F.lit(CLOSE + "\n"))


def turn_prefixes(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv_id, role, text) with ``pos`` (from 0), ``turns`` and the rolling hash (``p1``, ``p2``) of turns 0 to pos.

    Turns go by number, nulls first, and turns of one number by a hash of role and text, so the order
    is the same for equal turns. Rows are dealt by ranges of that order, so a conversation of any length
    spreads over tasks; positions and rolling sums are taken within each range and moved on by the totals
    of the ranges before. The hash is a sum of hashes of
    (position, role, text), so it rolls on without a look at earlier turns.
    """
    packed = turns.select("conv_id", "turn", "role", "text", row_hash(turns.select("role", "text")).alias("__tie"),
                          F.monotonically_increasing_id().alias("__at"))
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(packed.repartitionByRange(n, "conv_id", "turn", "__tie", "__at")
                  .withColumn("__range", F.spark_partition_id()), "turns")
    keys = ["conv_id", "__range"]
    inside = Window.partitionBy(*keys).orderBy("turn", "__tie", "__at")
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("__c"), F.col("__range").alias("__r"),
                           F.coalesce(F.sum("__count").over(earlier), F.lit(0)).alias("__before"),
                           F.sum("__count").over(whole).alias("turns"))
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__range") == F.col("__r"))
    placed = (dealt.withColumn("__inner", F.row_number().over(inside) - 1).join(counts, same)
              .withColumn("pos", F.col("__before") + F.col("__inner")).drop("__c", "__r", "__before", "__inner"))
    for seed in (1, 2):
        placed = placed.withColumn(f"__t{seed}", F.xxhash64(
            F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)"))
    rolling = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*keys).agg(F.sum("__t1").alias("__s1"), F.sum("__t2").alias("__s2"))
    totals = totals.select(F.col("conv_id").alias("__c"), F.col("__range").alias("__r"),
                           *[F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).cast("decimal(38,0)").alias(f"__b{i}")
                             for i in (1, 2)])
    placed = (placed.withColumn("__w1", F.sum("__t1").over(rolling)).withColumn("__w2", F.sum("__t2").over(rolling))
              .join(totals, same))
    return placed.select("conv_id", "role", "text", "pos", "turns",
                         *[(F.col(f"__b{i}") + F.col(f"__w{i}")).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2)])


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations as rendered text: (conv_id, part, n_turns, total_turns, text).

    A conversation whose turns (role and text) begin a longer one is a snapshot of it and goes; of equal
    conversations the smallest conv_id stays. The rest are rendered in order, TURNS_PER_PART turns to
    a row, so ``part`` 0, 1, ... of a conversation, joined, are its whole text. Rows whose conv_id is null
    are one conversation; null roles are written as unknown, null texts as empty, and both differ from
    ordinary values when conversations are compared. Turns of the same number go by a hash of role and
    text. Repeated rows are turns. Other columns are ignored. An empty table gives no rows.
    """
    rows = stage(turn_prefixes(turns), "prefixes")
    ends = (rows.where(F.col("pos") + 1 == F.col("turns")).groupBy("p1", "p2", "turns")
            # Null ids go last: a null stays only if no equal conversation has an id.
            .agg(F.min("conv_id").alias("conv_id")))
    proper = rows.where(F.col("pos") + 1 < F.col("turns")).select("p1", "p2", (F.col("pos") + 1).alias("turns")).distinct()
    maximal = ends.join(proper, ["p1", "p2", "turns"], "left_anti").select(F.col("conv_id").alias("__keep"))
    kept = rows.join(maximal, F.col("conv_id").eqNullSafe(F.col("__keep")), "left_semi")
    pieces = kept.select("conv_id", F.floor(F.col("pos") / TURNS_PER_PART).alias("part"), "turns",
                         F.struct("pos", _rendered(F.col("role"), F.col("text")).alias("piece")).alias("p"))
    return (pieces.groupBy("conv_id", "part")
            .agg(F.first("turns").alias("total_turns"), F.array_sort(F.collect_list("p")).alias("ps"))
            .select("conv_id", "part", F.size("ps").cast("long").alias("n_turns"), "total_turns",
                    F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("text")))


SQL = """
WITH t AS (SELECT conv_id, role, text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
m AS (SELECT conv_id, n FROM c a
      WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND
                        ((b.n > a.n AND b.turns[1:a.n] = a.turns) OR (b.turns = a.turns AND b.conv_id < a.conv_id))))
SELECT t.conv_id, CAST(floor(pos / 256) AS BIGINT) AS part, count(*) AS n_turns, CAST(any_value(m.n) AS BIGINT) AS total_turns,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10)
                  || regexp_replace(coalesce(text, ''), '<\\|im_(start|end)\\|>', '<| im_\\1 |>', 'g')
                  || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY t.conv_id, CAST(floor(pos / 256) AS BIGINT)
"""
