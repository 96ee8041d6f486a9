"""Row identity, numbering without large groups, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listguard.llm.scratch import stage

#: Characters between words, and the words themselves.
WORD = r"[^\x20\x09-\x0D]+"


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but for ``names`` (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(df: DataFrame, seed: int = 1) -> Column:
    """64-bit hash of a whole row; nulls are told apart from missing neighbours."""
    parts = []
    for name in df.columns:
        c = F.col(quoted(name))
        parts += [c.isNull(), c]
    return F.xxhash64(F.lit(seed), *parts)


def numbered(df: DataFrame, group: list[str], split: str, order: list[str], name: str) -> DataFrame:
    """Adds the row's number from 0 in its group, by ``split`` and then ``order``.

    Rows are ranked within (group, split) and moved on by the counts of the earlier splits, so no
    task holds a whole group. ``split`` must rise with the wanted order. Group columns hold no nulls.
    """
    keys = [*group, split]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
    earlier = Window.partitionBy(*group).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("__count").over(earlier), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (df.withColumn("__inner", inner).join(counts, keys)
            .withColumn(name, F.col("__before") + F.col("__inner")).drop("__before", "__inner"))


def keyed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` as (``__at``, ``__in``) and their keys as (``__at``, ``__h``, ``__n``), both written.

    ``__in`` is the whole row, ``__at`` its place. ``__h`` hashes the row and ``__n`` counts the rows of equal
    hash, so (``__h``, ``__n``) is unique. Equal rows are interchangeable, so these keys depend on
    the rows alone, not on files or partitions. Equal rows are counted by input partition, so a row
    repeated very often stays spread. Only the narrow keys are shuffled.
    """
    rows = stage(df.select(F.monotonically_increasing_id().alias("__at"), row_hash(df).alias("__h"),
                           F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("__in")), "rows")
    hashes = rows.select("__at", "__h", F.shiftright("__at", 33).alias("__part"))
    keys = numbered(hashes, ["__h"], "__part", ["__at"], "__n").select("__at", "__h", "__n")
    return rows.select("__at", "__in"), stage(keys, "keys")


def unpacked(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The named input columns out of ``__in``, then the columns ``more``."""
    return df.select(*[F.col("__in").getField(n).alias(n) for n in names], *more)


def uniform(*keys: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def top_bits(key: Column, bits: int) -> Column:
    """The leading bits of a 64-bit key as an int that rises with the key read as unsigned."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)
