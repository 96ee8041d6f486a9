"""Connected components of a link table, and links inside a batch of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listguard.llm.scratch import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links`` (a, b); any orderable type.

    Large-star and small-star rounds in turn: every node passes its smallest neighbour to its larger, then
    to its smaller neighbours, until the links are stars around the roots. The number of rounds grows with
    the logarithm of the longest path. Each round is written to the shared folder; only a count and a
    checksum reach the driver. Joins are on the node of one link, so a hub's links can be split.
    """
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now, seen = stage(now, "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v"), F.col("v")).distinct())
        seen = state
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
        large = (both.where("y > x").join(least, F.col("x") == F.col("k"))
                 .select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = (large.join(least, F.col("u") == F.col("k")).where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("k", "m")).distinct())
        now = stage(small, "links")


class Stars:
    """Links among numbered rows, kept as few: each row to the smallest row it reaches."""

    ROOM = 1 << 20

    def __init__(self, rows: int) -> None:
        self.label = np.arange(rows)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.pending.append((i, j))
        self.waiting += len(i)
        if self.waiting > self.ROOM:
            self._settle()

    def _settle(self) -> None:
        if not self.waiting:
            return
        i = np.concatenate([p[0] for p in self.pending])
        j = np.concatenate([p[1] for p in self.pending])
        self.pending, self.waiting = [], 0
        label = self.label
        while True:
            low = np.minimum(label[i], label[j])
            if (low == label[i]).all() and (low == label[j]).all():
                break
            # The roots of both ends learn the smaller root, then every row follows its root.
            np.minimum.at(label, label[i].copy(), low)
            np.minimum.at(label, label[j].copy(), low)
            while (label != label[label]).any():
                label = label[label]
        self.label = label

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, smallest row reached) for every row that reaches a smaller one."""
        self._settle()
        rows = np.flatnonzero(self.label != np.arange(len(self.label)))
        return rows, self.label[rows]
