"""Settings for tasks that read whole texts in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Texts that pass to Python together: few, as any of them may be very long.
TEXTS_PER_BATCH = 256


def small_batches(spark: SparkSession) -> None:
    """Bounds the texts that a Python task holds at once, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))


def byte_batches(spark: SparkSession, size: int = 1 << 20, texts: int = 4096) -> None:
    """Bounds the bytes, not the number, of texts that pass to Python together; one text may be larger."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(texts))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
