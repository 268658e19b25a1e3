"""A stored table with keys: versions are committed by one rename, rows are merged by key when they are read.

``data/<segment>/_bucket=<b>`` holds what one write changed, by the hash of the keys; ``log/<version>.json`` names the segments of
each bucket, in order, and the last batch of each writer. A version counts once its file is there; whatever a lost writer leaves
is named by no version. Writers that meet try again on the version that came first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Versions whose segments stay when others are cleaned up.
KEEP = 5
_OWN = ("_deleted", "_bucket")


class Conflict(RuntimeError):
    """Another writer's version came first."""


class StoredTable:
    """A table in the folder ``path``, with one row for each combination of ``keys``; nulls in keys are one value.

    ``schema`` (a DDL text or type) names all columns. Several writers may work at once, on any file system with a rename that
    doesn't overwrite.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.names
        self.n_buckets = buckets

    # ---- versions ----

    def _path(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")  # noqa: SLF001
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _names(self, folder: str) -> list[str]:
        p, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The version's description; by default the last one's. Version 0 is the empty table."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "buckets": {}, "since": {}, "writers": {}}
        p, fs = self._path(f"log/{version:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # noqa: SLF001
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, version: int, buckets: dict[str, list[str]], since: dict[str, int], writers: dict[str, int]) -> None:
        """Make a version visible, or raise ``Conflict`` if its number is taken. ``since`` has the version of each segment."""
        used = {n for names in buckets.values() for n in names}
        manifest = {"version": version, "buckets": buckets, "since": {n: v for n, v in since.items() if n in used}, "writers": writers}
        source, fs = self._path(f"log/.{uuid.uuid4().hex}")
        out = fs.create(source, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = self._path(f"log/{version:012d}.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE  # noqa: SLF001
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
        options[0] = none
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(source, False)
            if fs.exists(target):
                raise Conflict(f"version {version}") from e
            raise

    # ---- reading ----

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def _segments(self, manifest: dict, chosen: Callable[[list], bool]) -> dict[str, list[int]]:
        """The buckets of each segment, of the buckets whose list of segments is ``chosen``."""
        out: dict[str, list[int]] = {}
        for b, names in manifest["buckets"].items():
            if chosen(names):
                for n in names:
                    out.setdefault(n, []).append(int(b))
        return out

    def _stored(self, segment: str, buckets: list[int]) -> DataFrame:
        kinds = StructType([*self.schema.fields]).add("_deleted", "boolean").add("_bucket", "integer")
        return self.spark.read.schema(kinds).parquet(f"{self.path}/data/{segment}").where(F.col("_bucket").isin(buckets))

    def _merged(self, manifest: dict, chosen: Callable[[list], bool]) -> DataFrame:
        """Rows of the chosen buckets with the last word on each key. Keys are aggregated, so that those written often don't gather."""
        segments = self._segments(manifest, chosen)
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        parts = [self._stored(n, b).withColumn("_at", F.lit(manifest["since"][n])) for n, b in sorted(segments.items())]
        rows = reduce(DataFrame.unionByName, parts)
        others = [c for c in self.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct("_deleted", *others), "_at").alias("r"))
        return last.where(~F.col("r._deleted")).select(*[F.col(c) if c in self.keys else F.col(f"r.`{c}`").alias(c) for c in self.columns])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. Buckets with one segment are read as they are; only buckets that were changed since are merged."""
        m = self.manifest(version)
        whole = [self._stored(n, b).where("not _deleted").select(*self.columns) for n, b in sorted(self._segments(m, lambda names: len(names) == 1).items())]
        return reduce(DataFrame.unionByName, [self._merged(m, lambda names: len(names) > 1), *whole])

    # ---- writing ----

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A new segment of changed rows, and the buckets that it has rows of."""
        name = uuid.uuid4().hex
        placed = rows.withColumn("_bucket", self._bucket())
        placed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return name, [int(n.removeprefix("_bucket=")) for n in self._names(f"data/{name}") if n.startswith("_bucket=")]

    def _change(self, rows_of: Callable[[dict], DataFrame], writer: str | None, batch: int | None, again: bool, tries: int = 20) -> bool:
        """Commit the rows that ``rows_of`` makes of the current version. With ``again`` they depend on that version and are made anew after a conflict."""
        written = None
        for _ in range(tries):
            m = self.manifest()
            if writer is not None and batch is not None and m["writers"].get(writer, -1) >= batch:
                return False
            if written is None or again:
                written = self._write(rows_of(m))
            name, buckets = written
            new = {b: list(s) for b, s in m["buckets"].items()}
            for b in buckets:
                new.setdefault(str(b), []).append(name)
            writers = m["writers"] | ({writer: batch} if writer is not None else {})
            try:
                self._commit(m["version"] + 1, new, m["since"] | {name: m["version"] + 1}, writers)
                return True
            except Conflict:
                continue
        raise Conflict("too many writers")

    def _rows(self, df: DataFrame, seq: str | None) -> DataFrame:
        """One row of each key: the last by ``seq``, or any one."""
        if seq is None:
            return df.select(*self.columns, F.lit(False).alias("_deleted")).dropDuplicates(self.keys)
        others = [c for c in self.columns if c not in self.keys]
        last = df.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(0).alias("_"), *others), F.col(seq)).alias("r"))
        return last.select(*[F.col(c) if c in self.keys else F.col(f"r.`{c}`").alias(c) for c in self.columns], F.lit(False).alias("_deleted"))

    def upsert(self, df: DataFrame, seq: str | None = None, writer: str | None = None, batch: int | None = None) -> bool:
        """Insert rows and replace those of equal keys; of rows that repeat a key the last by ``seq``. False if the writer's batch was committed before."""
        return self._change(lambda _: self._rows(df, seq), writer, batch, again=False)

    def delete(self, keys: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Delete the rows of the keys; keys that aren't there do nothing."""
        return self._change(lambda _: self._gone(keys), writer, batch, again=False)

    def _gone(self, keys: DataFrame) -> DataFrame:
        rows = keys.select(*self.keys).distinct()
        kinds = {f.name: f.dataType for f in self.schema.fields}
        return rows.select(*[F.col(c) if c in self.keys else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns], F.lit(True).alias("_deleted"))

    def insert_new(self, df: DataFrame, seq: str | None = None, writer: str | None = None, batch: int | None = None) -> bool:
        """Insert the rows whose key isn't there. Two writers of one key: the one that commits first has it."""

        def fresh(m: dict) -> DataFrame:
            rows, old = self._rows(df, seq).alias("n"), self.read(m["version"]).select(*self.keys).alias("o")
            return rows.join(old, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.keys], "left_anti")

        return self._change(fresh, writer, batch, again=True)

    def replace(self, where: Column, df: DataFrame, seq: str | None = None) -> bool:
        """Replace all rows for which ``where`` holds by the rows of ``df``, in one step: readers see all of it or nothing."""

        def rows(m: dict) -> DataFrame:
            new = self._rows(df, seq)
            old = self.read(m["version"]).where(where).select(*self.keys)
            gone = self._gone(old).alias("g").join(new.select(*self.keys).alias("n"), [F.col(f"g.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys], "left_anti")
            return new.unionByName(gone)

        return self._change(rows, None, None, again=True)

    def compact(self, segments: int = 2) -> bool:
        """Merge the buckets that have so many segments or more into one each. False if there is none, or another writer came first: then nothing is lost, and the next call does it."""
        m = self.manifest()
        chosen = lambda names: len(names) >= segments
        if not any(map(chosen, m["buckets"].values())):
            return False
        name, buckets = self._write(self._merged(m, chosen).withColumn("_deleted", F.lit(False)))
        new = {b: s for b, s in m["buckets"].items() if not chosen(s)} | {str(b): [name] for b in buckets}
        try:
            self._commit(m["version"] + 1, new, m["since"] | {name: m["version"] + 1}, m["writers"])
        except Conflict:
            return False
        return True

    def clean(self, keep: int = KEEP, spare: list[str] | None = None) -> list[str]:
        """Delete old versions but the last ``keep``, and segments that none of these names; returns the segments' names.

        Segments of writers that still work are named by no version: call this while none works, or name them in ``spare``.
        """
        kept = self.versions()[-keep:]
        used = {n for v in kept for names in self.manifest(v)["buckets"].values() for n in names} | set(spare or [])
        gone = [n for n in self._names("data") if n not in used]
        for folder, names in (("data", gone), ("log", [f"{v:012d}.json" for v in self.versions() if v not in kept])):
            for n in names:
                p, fs = self._path(f"{folder}/{n}")
                fs.delete(p, True)
        return gone

    def ingest(self, stream: DataFrame, checkpoint: str, writer: str, new_only: bool = True):  # noqa: ANN201
        """A running query that puts all that a stream has now into the table, each batch once, even if it is run again after a loss.

        A ``writer`` belongs to one checkpoint: started with a new one, its batches count from 0 again, and those that were
        committed before are left out.
        """

        def put(rows: DataFrame, batch: int) -> None:
            (self.insert_new if new_only else self.upsert)(rows, writer=writer, batch=batch)

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
