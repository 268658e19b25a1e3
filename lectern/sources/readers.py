"""Readers: JSON in its wild forms, texts with headers, CSV, bytes, sheets, vectors, tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

WRAPPERS = ("programs", "items", "results", "data")


def json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One row per element of a JSON array file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def json_wrapped(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Elements of an array, or of the first array that a wrapper object holds under one of WRAPPERS."""
    rows = ArrayType(schema)
    text = spark.read.text(path, wholetext=True)
    holder = StructType()
    for w in WRAPPERS:
        holder = holder.add(w, rows)
    inner = F.from_json("value", holder)
    found = F.when(F.ltrim("value").startswith("["), F.from_json("value", rows)).otherwise(F.coalesce(*[inner[w] for w in WRAPPERS]))
    return text.select(F.explode(found).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_quarantined(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines as text)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = "_bad"
    got = lines.select("value", F.from_json("value", schema.add(bad, "string") if bad not in schema.names else schema, {"columnNameOfCorruptRecord": bad}).alias("r"))
    return got.where(f"r.{bad} is null and r is not null").select("r.*").drop(bad), got.where(f"r.{bad} is not null or r is null").select("value")


_MARK = re.compile(r'"(?:[^"\\\n]|\\.)*"?|[{}]|\n(?=\{)')


def _after_broken(text: str, at: int) -> int:
    """Where a broken object that begins at ``at`` is over: behind its closing brace, or before the next line that begins an object."""
    depth = 0
    for m in _MARK.finditer(text, at):
        if m.group() == "\n":
            return m.end()
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth and m.group() == "}":
            return m.end()
    return len(text)


def json_loose(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Objects of a file that is an array, JSON lines, or objects with commas between them; anything else is skipped.

    A broken object is skipped with all that it holds. Files are read in time linear in their length.
    """

    def objects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = json.JSONDecoder().raw_decode
        for f in frames:
            out = []
            for text in f["value"]:
                at = 0
                while (at := text.find("{", at)) >= 0:
                    try:
                        obj, at = decode(text, at)
                        out.append(json.dumps(obj))
                    except ValueError:
                        at = _after_broken(text, at)
            yield pd.DataFrame({"value": out})

    rows = spark.read.text(path, wholetext=True).mapInPandas(objects, "value string")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def texts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, text) of every *.txt file; names that start with _ are skipped."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=recursive)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header line, with or without a byte order mark."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of files as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def sheet_rows(cells: pd.DataFrame, required: set[str], search: int = 20) -> pd.DataFrame:
    """The table below the first of the first ``search`` rows that has all required names; an error if none has."""
    for i in range(min(search, len(cells))):
        names = [str(x).strip() for x in cells.iloc[i]]
        if required <= set(names):
            out = cells.iloc[i + 1 :].copy()
            out.columns = names
            return out.dropna(how="all").reset_index(drop=True)
    raise ValueError("no header row")


def excel(spark: SparkSession, path: str, required: set[str]) -> DataFrame:
    """A small workbook's first sheet by its discovered header row; needs a reader engine for pandas."""
    return spark.createDataFrame(sheet_rows(pd.read_excel(path, header=None), required).astype(str))


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database, read in ``bounds`` = (low, high, parts) ranges of ``key`` if given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2])
    return r.load()


def has_columns(df: DataFrame, *names: str) -> dict[str, bool]:
    return {n: n in df.columns for n in names}


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors with their texts and metadata."""
    return spark.read.parquet(path)


def with_file_key(df: DataFrame, path_col: str = "path") -> DataFrame:
    """A 40-digit hash at the end of a file name as ``doc_key``; null if there is none."""
    return df.withColumn("doc_key", F.nullif(F.regexp_extract(path_col, r"(?:^|[/_])([0-9a-f]{40})\.[a-z]+$", 1), F.lit("")))
