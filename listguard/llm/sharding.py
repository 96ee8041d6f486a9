"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listguard.llm.rows import keyed, numbered, top_bits, unpacked, without

#: Rows of the communication matrix, and the rows that one ranking task should hold.
PARTITIONS = 256
BLOCK = 16384
#: numpy draws hypergeometric counts from populations below this number.
POPULATION = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One hypergeometric count, for populations of any size.

    Beyond numpy's range the distribution is inverted from its mode outwards.
    """
    if good + bad < POPULATION:
        return int(rng.hypergeometric(good, bad, drawn)) if good and drawn else 0
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    left = rng.random() - peak
    down, up, p_down, p_up = mode, mode, peak, peak
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard: a uniform shuffle's law, exact margins."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    for i, left in enumerate(counts):
        others = sum(room)
        for s in range(shards):
            others -= room[s]
            matrix[i, s] = hypergeometric(rng, room[s], others, left) if others else left
            left -= matrix[i, s]
            room[s] -= int(matrix[i, s])
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0, without gaps).

    Rows are dealt to PARTITIONS partitions by a hash of the row. The driver draws from their
    counts (at most PARTITIONS numbers) how many rows each sends to each shard. Each partition is
    permuted by a keyed hash and cut by its matrix row; rows are exchanged, and each shard is permuted
    again by another hash. Shard sizes differ by at most one.

    Equal rows are told apart by a running number, nulls are ordinary values, an empty table stays
    empty, and input columns named shard or slot are replaced. Rankings run over hash ranges of about
    BLOCK rows, so neither a partition nor a shard meets in one task. The result depends on the rows,
    ``shards`` and ``seed``, not on files or partitions. Whole rows move once, at the end.
    """
    rows, named = keyed(df)
    keys = (named.withColumn("__first", F.xxhash64(F.lit(seed), "__h", "__n"))
            .withColumn("__second", F.xxhash64(F.lit(seed + 1), "__n", "__h"))
            .withColumn("__group", F.pmod(F.xxhash64(F.lit(seed + 2), "__h", "__n"), F.lit(PARTITIONS)).cast("int")))
    found = {r["__group"]: r["count"] for r in keys.groupBy("__group").count().collect()}
    groups = sorted(found)
    matrix = communication_matrix([found[g] for g in groups], shards, seed)
    bounds = df.sparkSession.createDataFrame(
        [(g, np.cumsum(matrix[i]).tolist()) for i, g in enumerate(groups)], "__group int, __bounds array<bigint>")

    total = sum(found.values())
    first_bits = max(0, math.ceil(math.log2(max(1, total / PARTITIONS / BLOCK))))
    second_bits = max(0, math.ceil(math.log2(max(1, total / shards / BLOCK))))
    local = numbered(keys.withColumn("__range", top_bits(F.col("__first"), first_bits)), ["__group"], "__range",
                     ["__first", "__h", "__n"], "__place")
    dealt = (local.join(F.broadcast(bounds), "__group")  # PARTITIONS x shards numbers at most
             .withColumn("__shard", F.size(F.filter("__bounds", lambda b: b <= F.col("__place")))))
    placed = numbered(dealt.withColumn("__range", top_bits(F.col("__second"), second_bits)), ["__shard"], "__range",
                      ["__second", "__h", "__n"], "__slot")
    out = rows.join(placed.select("__at", F.col("__shard").alias("shard"), F.col("__slot").alias("slot")), "__at")
    return unpacked(out, without(df, "shard", "slot"), "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int = 16, seed: int = 20) -> None:
    """Writes the shuffled rows as one folder per shard, in slot order within each file."""
    out = shuffle_into_shards(df, shards, seed)
    parts = F.floor(F.col("slot") / BLOCK)
    (out.repartition(F.col("shard"), parts).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
