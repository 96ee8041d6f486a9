"""Joins and windows that stay spread out when one group holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A group above this many rows is handled as hot.  At most rows / HOT_ROWS groups can be
# hot, which bounds every broadcast made from them (1e11 rows: 100,000 keys).
HOT_ROWS = 1_000_000
SALTS = 1024

# Rule and dimension tables up to this many rows are broadcast; larger ones shuffle.
BROADCAST_ROWS = 200_000
ESTIMATED_BYTES = 8 << 20


def columns(df: DataFrame) -> list[Column]:
    """All columns, safe for names with dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def exploded(df: DataFrame, array: str, name: str = "x") -> DataFrame:
    """``df`` with a row per element of the column ``array``, whose elements are never null.

    A plain explode would first filter by the array's size, and there compute it a second time.
    """
    return df.select("*", F.explode_outer(array).alias(name)).where(F.col(name).isNotNull()).drop(array)


def estimated_bytes(df: DataFrame) -> int:
    """Size of the result by the optimizer's statistics; no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, exact: bool = False) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small, else unchanged (Spark shuffles it).

    A plan whose input files are small passes on statistics alone.  Anything else, and plans
    that multiply rows (``exact``), are counted up to the limit.
    """
    if not exact and estimated_bytes(df) <= ESTIMATED_BYTES:
        return F.broadcast(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def attach_group(df: DataFrame, stats: DataFrame, keys: list[str], spread: list[str],
                 count: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join ``stats`` (one row per group, ``count`` its size) to the rows of ``df``.

    Rows of hot groups get their values from a broadcast of the hot groups alone; in the
    shuffle join for the rest they carry a salt taken from ``spread``, so no single task
    receives a hot group.
    """
    values = [c for c in stats.columns if c not in keys]
    hot = F.broadcast(stats.where(F.col(count) > hot_rows)
                      .select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values]))
    cold = (stats.where(F.col(count) <= hot_rows)
            .select(*keys, *[F.col(v).alias(f"_cold_{v}") for v in values], F.lit(0).alias("_salt")))
    salt = F.when(F.col(f"_hot_{count}").isNotNull(),
                  F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    joined = df.join(hot, keys, "left").withColumn("_salt", salt).join(cold, keys + ["_salt"], "left")
    return joined.select(*columns(df),
                         *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])


def attach_some(df: DataFrame, stats: DataFrame, keys: list[str], spread: list[str],
                count: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``attach_group`` for ``stats`` that may well be few: written, and then sent to the rows."""
    from listguard.session import stage

    stats = stage(stats, "groups")
    if estimated_bytes(stats) > ESTIMATED_BYTES and stats.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return attach_group(df, stats, keys, spread, count, hot_rows)
    values = [c for c in stats.columns if c not in keys]
    return df.join(F.broadcast(stats), keys, "left").select(*columns(df), *values)


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row of every group; Spark limits groups to one row before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fill_within(df: DataFrame, key: str, pos: str, cols: list[str], block: str | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Forward, then backward fill of ``cols`` inside each ``key``, ordered by ``pos``.

    ``block`` is a coarse position that never decreases with ``pos`` inside a key (a file
    split, a page number).  Hot keys are filled block by block and the last and first known
    values of the neighbouring blocks are carried in, so that no task holds a whole hot key.
    """
    if block is None:
        cut = df.withColumn("_b", F.lit(None).cast("int"))
    else:
        hot = (df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
               .select(key, F.lit(True).alias("_hot")))
        cut = (df.join(F.broadcast(hot), key, "left")
               .withColumn("_b", F.when(F.col("_hot"), F.col(block))).drop("_hot"))
    w = Window.partitionBy(key, "_b").orderBy(pos)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead runs over the reversed order: a growing frame costs one step per row.
    ahead = Window.partitionBy(key, "_b").orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.last(c, True).over(back).alias(f"_f_{c}") for c in cols],
                       *[F.last(c, True).over(ahead).alias(f"_a_{c}") for c in cols])
    if block is None:
        filled = {c: F.coalesce(f"_f_{c}", f"_a_{c}") for c in cols}
    else:
        aggs = []
        for c in cols:
            at = F.when(F.col(c).isNotNull(), F.col(pos))
            aggs += [F.max_by(c, at).alias(f"_last_{c}"), F.min_by(c, at).alias(f"_first_{c}")]
        edges = cut.where("_b IS NOT NULL").groupBy(key, "_b").agg(*aggs)
        across = Window.partitionBy(key).orderBy("_b")
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
        carried = edges.select(
            key, "_b",
            *[F.last(f"_last_{c}", True).over(before).alias(f"_p_{c}") for c in cols],
            *[F.last(f"_first_{c}", True).over(after).alias(f"_n_{c}") for c in cols])
        local = local.join(carried, [key, "_b"], "left")
        filled = {c: F.coalesce(f"_f_{c}", f"_p_{c}", f"_a_{c}", f"_n_{c}") for c in cols}
    return local.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def number_rows(df: DataFrame, order: Column, unique: str, out: str, cuts: int = 1000, least: int = 1000) -> DataFrame:
    """Number the rows 1..n by ``order`` (a struct that no two rows share).

    At most about ``cuts`` values of ``order``, one for ``least`` rows or more, picked by a hash of
    ``unique``, split the rows into ordered buckets; each bucket is numbered on its own and
    lifted by the sizes of the buckets before it.
    """
    total = df.count()
    keyed = df.withColumn("_o", order)
    picked = keyed.where(F.pmod(F.xxhash64(unique), F.lit(max(total // cuts, least))) == 0)
    bounds = sorted(tuple(r["_o"]) for r in picked.select("_o").collect())
    names = [f.name for f in keyed.schema["_o"].dataType.fields]
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, b)]) for b in bounds])
    bucket = F.size(F.filter(steps, lambda b: b <= F.col("_o"))) if bounds else F.lit(0)
    keyed = keyed.withColumn("_bucket", bucket)
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy("_o")
    return (keyed.join(F.broadcast(starts), "_bucket")
            .withColumn(out, F.col("_start") + F.row_number().over(inside))
            .drop("_o", "_bucket", "_start"))


def map_distinct(df: DataFrame, column: str, derive, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Compute ``derive`` once per distinct value of ``column`` and attach its columns.

    ``derive`` gets a DataFrame with the value and its row count ``_n`` and returns it with
    more columns, one row per value.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    others = [f"`{c}`" for c in df.columns if c != column]
    return attach_some(df, derive(values), [column], others or [column],
                       "_n", hot_rows).drop("_n")
