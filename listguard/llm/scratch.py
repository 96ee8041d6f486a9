"""Tables written on the way, in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from listguard.session import shared_folder, shuffles_removed

_collected: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The tables staged while the context lasts, for ``clear`` once nothing reads them any more."""
    mine: list[str] = []
    _collected.append(mine)
    try:
        yield mine
    finally:
        _collected.pop()


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, in folders ``by`` a column if given, and goes on from the written table.

    Nothing upstream runs twice, a lost executor costs no earlier step, and rows keep their order and places.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/corpus-{uuid.uuid4().hex}-{name}"
    with shuffles_removed(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    for mine in _collected:
        mine.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables; tables of other jobs stay."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop).delete(path, True)
