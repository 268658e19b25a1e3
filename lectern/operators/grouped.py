"""Grouped work in Python without a frame for each group."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def alike(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(classes, members): keys whose rows are equal but for ``key`` are one class.

    ``classes`` has the columns of ``df``, with a class's name for ``key`` and its rows once each; ``members`` has ``key`` and ``class``. A class is
    called by the hash (sha256) of its rows, so that no join is needed to name it.
    """
    rows = F.array_sort(F.collect_set(F.struct(*[c for c in df.columns if c != key])))
    members = df.groupBy(key).agg(rows.alias("_rows")).withColumn("class", F.sha2(F.to_json("_rows"), 256))
    classes = members.select(F.col("class").alias(key), "_rows").distinct().select(key, F.inline("_rows")).select(df.columns)
    return classes, members.select(key, "class")


def per_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list], Iterable[tuple]], schema: str, batch: int = 4096) -> DataFrame:
    """Rows that ``run`` makes of each group's rows, given as named tuples in ``order`` (nulls first).

    Groups are dealt by key and sorted, and pass through one after the other: a task holds one group, whatever
    the number of groups, and no frame is built for any of them. Null keys are one group.
    """
    columns = df.columns
    out_type = StructType.fromDDL(schema)
    n = len(keys)
    ordered = df.select(*keys, *[c for c in columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out_type)
        out: list[tuple] = []
        group: list = []
        key = None
        row_type = None

        def pack() -> pa.RecordBatch:
            cols = zip(*out) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            if row_type is None:
                row_type = namedtuple("Row", b.schema.names, rename=True)  # noqa: PYI024
            for values in zip(*(c.to_pylist() for c in b.columns)):
                if group and values[:n] != key:
                    out.extend(run(group))
                    group = []
                    if len(out) >= batch:
                        yield pack()
                        out.clear()
                key = values[:n]
                group.append(row_type(*values))
        if group:
            out.extend(run(group))
        if out:
            yield pack()

    return ordered.mapInArrow(work, schema)
