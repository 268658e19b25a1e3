"""Shared folders and small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import forget, persist_shared, shared_dir

__all__ = ["arrow_batches", "crc_mod", "forget", "persist_shared", "read", "shared_dir"]

#: Rows in one Arrow batch: long texts then stay far below a worker's memory.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches, since one text may hold megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of an id as text, modulo n: the fold of a row. A null id has fold 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))
