"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        alone = master == "local" or master.startswith("local[")
        at = tempfile.mkdtemp(prefix="lectern-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lectern"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def persist_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path  # noqa: SLF001
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``persist_shared`` returned and nothing will read again."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Few rows in an Arrow batch, where one text may hold megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
