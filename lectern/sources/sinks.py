"""Writers: JSON, CSV, tables with upsert, vector stores with incremental append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in this order, with a header line; nested values as JSON."""
    flat = [F.to_json(F.col(f)).alias(f) if t.startswith(("struct", "array", "map")) else F.col(f) for f, t in ((f, dict(df.dtypes)[f]) for f in fields)]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_evaluation(rows: DataFrame, path: str, measures: list[str], fields: list[str], by: list[str] | None = None) -> None:
    """Two sheets as CSV: ``rows`` with every row, ``summary`` with each measure's mean, median and count."""
    from lectern.operators.quality import evaluation_summary

    write_csv(rows, f"{path}/rows", fields)
    summary = evaluation_summary(rows, measures, by)
    write_csv(summary, f"{path}/summary", summary.columns)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_new(spark: SparkSession, new: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key isn't stored yet; returns those rows. Writing the same rows twice adds nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = new.dropDuplicates([key])
    if fs.exists(p):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def write_vectors(df: DataFrame, path: str, vector: str = "embedding", lists: int | None = None) -> None:
    """Vectors with a bucket column by the sign of their first places, so that a reader may prune; ``lists`` is a power of two."""
    if lists:
        bits = max(1, (lists - 1).bit_length())
        bucket: Column = sum((F.when(F.get(vector, i) > 0, 2**i).otherwise(0) for i in range(bits)), F.lit(0))
        df.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_parents(chunks: DataFrame, path: str) -> None:
    """The parent texts of parent-child chunks, one row each.

    Every task hashes its chunks down to one text a parent. Only these are sorted and move; the count of a text's chunks is asked for, as
    Spark would leave out a mere ``distinct`` before ``dropDuplicates`` and sort the texts of all chunks.
    """
    texts = chunks.groupBy("parent_id", F.col("parent_text").alias("text")).agg(F.count("*").alias("n")).where("n > 0")
    texts.select("parent_id", "text").dropDuplicates(["parent_id"]).write.mode("overwrite").parquet(path)
