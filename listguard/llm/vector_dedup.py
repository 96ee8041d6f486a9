"""Near-duplicate vectors by an exact metric range join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.llm.graph import Stars, components
from listguard.llm.rows import quoted
from listguard.llm.vectors import matrix, sampled, spread_sample, usable
from listguard.llm.scratch import stage

#: Pivots of all labels together, and the vectors that they are picked from (by hash).
PIVOTS = 16
SAMPLE = 4096
#: Vectors of a cell's part, and rows compared at a time.
PART = 4096
BLOCK = 256
#: Room for rounding in distances; every pair is verified by its cosine.
SLACK = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, keepdims=True)
    scaled = rows / np.where(largest > 0, largest, 1)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``a`` with all of ``b``."""
    return (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))


def placed(points: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """``points`` with ``at``: its cells, the own first, and the distance to each cell's pivot.

    A vector's own cell is its nearest pivot. Whatever lies within ``reach`` of a vector x of cell i has,
    by the triangle inequality, a distance to pivot i of at most its least distance plus 2 ``reach``, so a
    vector visits just those cells. Vectors of another length than the pivots have one cell of their own.
    """
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("far", pa.float64())]))
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if len(row) != pivots.shape[1]:
                    out.append([{"cell": -1, "far": 0.0}])
                    continue
                x = unit(np.array([row], dtype=np.float64))
                far = np.linalg.norm(pivots - x, axis=1)
                order = np.argsort(far, kind="stable")
                out.append([{"cell": int(c), "far": float(far[c])} for c in order
                            if far[c] <= far[order[0]] + 2 * reach + SLACK])
            yield pa.array(out, kind)

    return points.withColumn("at", F.arrow_udf(cells, "array<struct<cell:int,far:double>>")(F.col("v")))


def links_in_cell(table: pa.Table, reach: float, threshold: float) -> pa.Table:
    """Counts and links of the cell's own vectors with all vectors of two parts ``a`` and ``b`` of the cell.

    One row for each own vector with its links' copies, and spanning links (pid, other). Rows go by
    distance to the pivot, so a block meets only what lies within ``reach`` in that distance too.
    """
    rows = matrix(table["v"])
    pid, copies, far, part, own = (table[c].to_numpy() for c in ("pid", "copies", "far", "part", "own"))
    order = np.lexsort((pid, far))
    rows, pid, copies, far, part, own = rows[order], pid[order], copies[order], far[order], part[order], own[order]
    one = table["a"][0].as_py() == table["b"][0].as_py()
    found, stars = np.zeros(len(rows), dtype=np.int64), Stars(len(rows))
    mine = np.flatnonzero(own)
    for at in range(0, len(mine), BLOCK):
        block = mine[at:at + BLOCK]
        low = np.searchsorted(far, far[block[0]] - reach - SLACK)
        high = np.searchsorted(far, far[block[-1]] + reach + SLACK, side="right")
        near = cosines(rows[block], rows[low:high]) >= threshold
        if not one:  # each part meets itself in a cell of its own
            near &= part[block][:, None] != part[low:high]
        i, j = np.nonzero(near)
        i, j = block[i], j + low
        keep = i != j
        i, j = i[keep], j[keep]
        found += np.bincount(i, copies[j], minlength=len(rows)).astype(np.int64)
        stars.add(i, j)
    a, b = stars.links()
    counted = np.flatnonzero(found)
    nothing = pa.nulls(len(counted), pa.int64())
    return pa.table({"pid": pa.array(np.r_[pid[counted], pid[a]]),
                     "other": pa.concat_arrays([nothing, pa.array(pid[b])]),
                     "links": pa.array(np.r_[found[counted], np.zeros(len(a), dtype=np.int64)])})


def near_vectors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
                 threshold: float = 0.98, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with ``n_links``, ``component_id`` and ``kept``.

    Vectors of equal, non-null labels and lengths are linked when their cosine, in doubles, is ``threshold``
    or more. n_links counts the other rows linked directly, component_id is the smallest id reachable, the
    own included, and ``kept`` says whether that is the own.

    On unit vectors the threshold is a distance. Pivots part the vectors into cells, the triangle inequality
    says which cells a vector must visit besides, and cells are joined independently, each own vector with
    all present: counts are summed up, spanning links go to the components, pairs are never written out.
    Equal vectors of a label are one point with a number of copies. A cell of more than PART vectors is cut
    by hash and each two parts meet by themselves. Pivots only steer the work, whatever sample they are from.

    Vectors that are null, empty or zero, or hold nulls, NaN or infinities, and vectors without a label
    have no links and are their own component. Rows with a null id count as links but give no component id; a
    component without ids has a null one, and its rows are kept. Repeated rows link with each other. An empty
    table stays empty; input columns named n_links, component_id or kept are replaced.
    """
    spark = df.sparkSession
    names = [c for c in (keep or df.columns) if c.lower() not in ("n_links", "component_id", "kept")]
    value = F.col(quoted(vector))
    fit = usable(value) & F.exists(value, lambda x: x != 0) & F.col(quoted(label)).isNotNull()
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("__in"), F.col(quoted(vec_id)).alias("__id"),
                     F.when(fit, F.col(quoted(label))).alias("label"),
                     F.when(fit, F.transform(value, lambda x: x + F.lit(0).cast("float"))).alias("v"))
    points = (rows.where("v is not null").groupBy("label", "v")
              .agg(F.count(F.lit(1)).alias("copies"), F.min("__id").alias("first"))
              .withColumn("pid", F.monotonically_increasing_id()))
    points = stage(points, "points")

    size = points.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    dim = size["n"] if size else 1
    pivots = spread_sample(unit(sampled(points.where(F.size("v") == dim), "v", SAMPLE)), PIVOTS)
    pivots = pivots if len(pivots) else np.zeros((1, dim))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    visits = (placed(points.select("pid", "label", "v", "copies"), pivots, reach)
              .select("pid", "label", "v", "copies", F.size("v").alias("dim"), F.posexplode("at").alias("nth", "at"))
              .select("pid", "label", "v", "copies", "dim", "at.cell", "at.far", (F.col("nth") == 0).alias("own")))
    visits = stage(visits, "visits")
    cell = ["label", "dim", "cell"]
    crowds = (visits.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
              .select(*cell, F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    parted = (visits.join(crowds, cell).withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))
              .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("a", F.least("part", "with")).withColumn("b", F.greatest("part", "with")))

    def solve(table: pa.Table) -> pa.Table:
        return links_in_cell(table, reach, threshold)

    found = stage(parted.select(*cell, "a", "b", "pid", "v", "copies", "far", "part", "own").groupBy(*cell, "a", "b")
                  .applyInArrow(solve, "pid bigint, other bigint, links bigint"), "found")
    counts = found.groupBy("pid").agg(F.sum("links").alias("others"))
    roots = components(found.where("other is not null").select(F.col("pid").alias("a"), F.col("other").alias("b")))
    named = (points.join(counts, "pid", "left").join(roots, F.col("pid") == F.col("node"), "left")
             .select("label", "v", "first", F.coalesce("root", "pid").alias("root"),
                     (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_point = stage(named.join(smallest, "root").select(
        F.col("label").alias("__l"), F.col("v").alias("__v"), "n_links", "component_id"), "components")

    alone: list[Column] = [F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id")]
    linked = rows.where("v is not null").join(of_point, (F.col("label") == F.col("__l")) & (F.col("v") == F.col("__v")))
    out = linked.select("__in", "__id", "n_links", "component_id").union(
        rows.where("v is null").select("__in", "__id", *alone))
    return out.select(*[F.col("__in").getField(c).alias(c) for c in names], "n_links", "component_id",
                      F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))
