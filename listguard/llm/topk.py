"""Exact top-k search by inner product over pairs of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listguard.llm.rows import quoted
from listguard.llm.vectors import matrix, sampled, spread_sample, usable
from listguard.llm.scratch import stage

#: Top nodes of the data tree, and the vectors that they are picked from (by hash).
TOP = 32
SAMPLE = 4096
#: Vectors of a lower data tree, queries of a query tree, and points of a leaf.
CHUNK = (1024, 8192)
QUERIES = 4096
LEAF = 64
#: Products up to this size are exact in doubles.
EXACT = float(1 << 53)


class CoverTree:
    """Points under centres whose radius halves from level to level; a node's first point is its centre.

    Each node covers its points within ``radius`` of its centre; the centres of its children are points
    more than half that radius apart. A node is a leaf when it is small or its children would hardly be
    fewer than its points. Nodes are rows: points ``start`` to ``end`` in tree order, ``below`` its children.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.order, self.centre, self.radius, self.start, self.end = [], [], [], [], []
        self.below: list[list[int]] = []
        self.points = points
        if len(points):
            self._grow(np.arange(len(points)))
        self.order = np.array(self.order, dtype=np.int64)
        self.points = points[self.order]
        self.length = [float(np.linalg.norm(c)) for c in self.centre]

    def _grow(self, rows: np.ndarray) -> int:
        node, points = len(self.centre), self.points[rows]
        distance = np.linalg.norm(points - points[0], axis=1)
        self.centre.append(points[0])
        self.radius.append(float(distance.max()))
        self.start.append(len(self.order))
        self.end.append(0)
        self.below.append([])
        limit, nearest, centres = distance.max() / 2, np.zeros(len(rows), dtype=np.int64), [0]
        while len(rows) > LEAF and distance.max() > limit and len(centres) <= len(rows) // 8:
            centres.append(int(distance.argmax()))
            far = np.linalg.norm(points - points[centres[-1]], axis=1)
            closer = far < distance
            nearest[closer], distance = len(centres) - 1, np.where(closer, far, distance)
        if 1 < len(centres) <= len(rows) // 8:
            for c, centre in enumerate(centres):
                mine = np.flatnonzero(nearest == c)
                self.below[node].append(self._grow(rows[np.r_[centre, mine[mine != centre]]]))
        else:
            self.order.extend(rows.tolist())
        self.end[node] = len(self.order)
        return node


class Best:
    """The k best (score, id) of each query: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int, known: np.ndarray) -> None:
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.known = known  # scores that each query's kth is known to reach

    def worst(self, low: int, high: int) -> float:
        return float(np.maximum(self.score[low:high, -1], self.known[low:high]).min())

    def add(self, low: int, high: int, scores: np.ndarray, ids: np.ndarray) -> None:
        bound = np.maximum(self.score[low:high, -1], self.known[low:high])
        able = ((scores >= bound[:, None]) & (ids != self.ids[low:high, None])).astype(bool)
        some = np.flatnonzero(able.any(axis=0))
        if not len(some):
            return
        score = np.c_[self.score[low:high], np.where(able[:, some], scores[:, some].astype(np.float64), -np.inf)]
        found = np.c_[self.found[low:high], np.where(able[:, some], ids[some], np.iinfo(np.int64).max)]
        best = np.lexsort((found, -score), axis=1)[:, :self.k]
        self.score[low:high] = np.take_along_axis(score, best, 1)
        self.found[low:high] = np.take_along_axis(found, best, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the doubles' exact range in Python integers."""
    largest = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * a.shape[1]
    if largest < EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T


def search(queries: CoverTree, data: CoverTree, ids: np.ndarray, best: Best) -> None:
    """Pairs of nodes, best bound first; a pair goes once its bound falls below the group's worst kth score.

    For centres p, q and radii r, s no product exceeds p.q + |p| s + |q| r + r s.
    """
    def bound(q: int, d: int) -> float:
        r, s, p, c = queries.radius[q], data.radius[d], queries.length[q], data.length[d]
        top = float(queries.centre[q] @ data.centre[d]) + p * s + c * r + r * s
        return top + 1e-9 * (abs(top) + p * c + 1)

    pending = [(0, 0)] if len(queries.order) and len(data.order) else []
    while pending:
        q, d = pending.pop()
        low, high = queries.start[q], queries.end[q]
        if bound(q, d) < best.worst(low, high):
            continue
        if data.below[d] and (data.radius[d] >= queries.radius[q] or not queries.below[q]):
            pending += sorted(((q, x) for x in data.below[d]), key=lambda p: bound(*p))
        elif queries.below[q]:
            pending += [(x, d) for x in queries.below[q]]
        else:
            part = slice(data.start[d], data.end[d])
            best.add(low, high, products(queries.points[low:high], data.points[part]), ids[data.order[part]])


def whole_numbers(rows: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(rows * scale)


def find_best(queries: pa.Table, data: pa.Table, k: int, scale: float) -> pa.Table:
    """(query_id, vec_id, score): the best of one data chunk for one group of queries."""
    if not queries.num_rows or not data.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.int64())})
    asked = CoverTree(whole_numbers(matrix(queries["v"]), scale))
    there = CoverTree(whole_numbers(matrix(data["v"]), scale))
    ids = queries["vec_id"].to_numpy()[asked.order]
    known = np.array([-np.inf if x is None else x for x in queries["known"].to_pylist()], dtype=float)[asked.order]
    best = Best(ids, k, known)
    search(asked, there, data["vec_id"].to_numpy(), best)
    hit = best.score > -np.inf
    return pa.table({"query_id": pa.array(np.repeat(ids, k).reshape(-1, k)[hit]), "vec_id": pa.array(best.found[hit]),
                     "score": pa.array([int(s) for s in best.score[hit]], pa.int64())})


def top_k(df: DataFrame, is_query: Column, vector: str = "embedding", vec_id: str = "vec_id", k: int = 10,
          scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query with all other rows.

    Components become floor(scale * x) in doubles, so scores are whole numbers; ties go to the smaller id.
    ``is_query`` marks the query rows of ``df``.

    The data tree's top level are TOP pivots with their covering radii. Its nodes are cut into chunks of at
    most CHUNK vectors; queries come in groups of about QUERIES. A group and a chunk grow a cover tree each,
    and pairs of their nodes are searched together. First each query meets one chunk of its own node,
    which tells a score its kth reaches. Then it meets the chunks of every node whose radius can still
    beat that. Of equal vectors, k rows of an id and of these the 2k of smallest ids hold the best k for any query,
    whose own id takes at most k of them; copies beyond are left out. Pivots only steer the work; nothing is approximate.

    Vectors that are null or empty or hold nulls, NaN or infinities, and rows without id, take no part; vectors
    meet only others of their length. A query with fewer candidates returns all. Rows that repeat an id
    are candidates each, but never for their own id. Other columns are ignored. Scores beyond 64 bits fail.
    """
    value = F.col(quoted(vector))
    rows = df.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), value.alias("v"), is_query.alias("asks")).where(
        usable(value) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))
    # A query takes at most k equal vectors, and at most k of a repeated id are its own.
    first = rows.select("vec_id", "v", "dim").withColumn(
        "nth", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))).where(F.col("nth") <= k)
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(
        F.col("nth") <= 2 * k)

    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    main = dims["dim"] if dims else 1
    pivots = spread_sample(whole_numbers(sampled(rows.where(F.col("dim") == main), "v", SAMPLE), scale), TOP)
    pivots = pivots if len(pivots) else np.zeros((1, main))

    def nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("node", pa.int32()), ("far", pa.float64())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if len(row) != pivots.shape[1]:
                    out.append({"node": -1, "far": 0.0})
                    continue
                far = np.linalg.norm(pivots - whole_numbers(np.array(row, dtype=np.float64), scale), axis=1)
                out.append({"node": int(far.argmin()), "far": float(far.min())})
            yield pa.array(out, kind)

    at = F.arrow_udf(nodes, "struct<node:int,far:double>")
    data = stage(first.select("vec_id", "v", "dim", at(F.col("v")).alias("at"))
                 .select("vec_id", "v", "dim", "at.node", "at.far"), "data")
    asked = stage(rows.where("asks").select("vec_id", "v", "dim", at(F.col("v")).alias("at"))
                  .select("vec_id", "v", "dim", "at.node").dropDuplicates(["vec_id"]), "queries")
    # One line for each node: TOP for the pivots' length, one for each other length.
    lines = data.groupBy("dim", "node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    size = int(np.clip(np.ceil(sum(r["n"] for r in lines) / TOP), *CHUNK))
    chunks = {(r["dim"], r["node"]): -(-r["n"] // size) for r in lines}
    radii = {r["node"]: r["radius"] for r in lines if r["dim"] == main and r["node"] >= 0}
    groups = max(1, -(-asked.count() // QUERIES))
    sizes = df.sparkSession.createDataFrame([(*key, n) for key, n in chunks.items()], "dim int, node int, chunks int")

    group = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(groups)).cast("int")
    cells = ["dim", "node", "chunk", "part"]
    chunked = (data.join(F.broadcast(sizes), ["dim", "node"])  # TOP + lengths lines
               .withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int")))

    def found(queries: DataFrame) -> DataFrame:
        asked_for = queries.select(*cells[:3], F.col("part").alias("__part")).distinct()
        spread = chunked.join(asked_for, cells[:3]).select(*[F.col(c).alias(c) for c in cells[:3]],
                                                           F.col("__part").alias("part"), "vec_id", "v")
        return (queries.groupBy(*cells).cogroup(spread.groupBy(*cells))
                .applyInArrow(lambda q, d: find_best(q, d, k, scale), "query_id bigint, vec_id bigint, score bigint"))

    start = (asked.join(F.broadcast(sizes), ["dim", "node"]).withColumn("part", group)
             .withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.col("chunks")).cast("int")))
    early = stage(found(start.select(*cells, "vec_id", "v", F.lit(None).cast("double").alias("known"))), "early")
    reached = (early.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s"))
               .select("query_id", F.when(F.col("c") >= k, F.col("s")).cast("double").alias("known")))

    def open_chunks(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("node", pa.int32()), ("chunk", pa.int32())]))
        for vectors, known, own, own_chunk in batches:
            out = []
            for row, least, node, chunk in zip(*(c.to_pylist() for c in (vectors, known, own, own_chunk))):
                if len(row) == pivots.shape[1]:
                    q = whole_numbers(np.array(row, dtype=np.float64), scale)
                    length = float(np.linalg.norm(q))
                    bounds = {n: float(pivots[n] @ q) + length * r for n, r in radii.items()}
                    able = [n for n, b in bounds.items() if least is None or b + 1e-9 * (abs(b) + 1) >= least]
                else:
                    able = [-1]
                out.append([{"node": n, "chunk": c} for n in able for c in range(chunks.get((len(row), n), 0))
                            if (n, c) != (node, chunk)])
            yield pa.array(out, kind)

    able = F.arrow_udf(open_chunks, "array<struct<node:int,chunk:int>>")
    later = (start.join(reached, F.col("vec_id") == F.col("query_id"), "left")
             .select("dim", "part", "vec_id", "v", "known", F.explode(able("v", "known", "node", "chunk")).alias("o"))
             .select("dim", "o.node", "o.chunk", "part", "vec_id", "v", "known"))
    every = early.union(found(later))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
