"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import packing

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Change rows from rows of (source, lang, tokenizer_version, n_tokens): +1 to insert, -1 to delete.

    A revision is the delete of the old count and the insert of the new one, in one batch. Null keys are
    groups of their own; a null count is 0 tokens of one document.
    """
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    return counts.select(*[F.col(k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("n_docs"), (n * sign).alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change rows that replace the counts ``old`` by ``new``; what is in both cancels out."""
    return signed(old, -1).unionByName(signed(new, 1))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """Additive totals by source, language and tokenizer version, in a folder of any Hadoop file system.

    Every batch is a small folder of its summed changes, written aside and renamed in one step once it is whole. A
    batch that is there is never written again, and of two writers of one batch the first rename counts: a repeated
    commit, after a lost driver or a replayed stream, changes nothing. Totals are sums over the last snapshot and the
    batches after it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, at: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, at: str) -> bool:
        fs, p = self._fs(at)
        return fs.exists(p)

    def _children(self, at: str) -> list[str]:
        """Names of the committed folders in ``at``, by one listing."""
        fs, p = self._fs(f"{at}/*/_SUCCESS")
        return sorted(s.getPath().getParent().getName() for s in fs.globStatus(p) or [])

    def _names(self, at: str) -> list[str]:
        """Names of all folders in ``at``, unfinished ones too."""
        fs, p = self._fs(at)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def sweep(self) -> list[str]:
        """Delete what the last snapshot replaces: the batches that it holds, other snapshots and all that was left aside; their names.

        For when nobody writes, and nobody reads totals of an earlier snapshot. Batches that are deleted still count as committed.
        """
        last = self._snapshot()
        merged = {f"batch={r.batch}" for r in self._merged(last).collect()}
        folders = [("batches", n) for n in self._names(f"{self.path}/batches") if n in merged]
        folders += [("snapshots", n) for n in self._names(f"{self.path}/snapshots") if f"{self.path}/snapshots/{n}" != last]
        folders += [("aside", n) for n in self._names(f"{self.path}/aside")]
        for folder, name in folders:
            fs, p = self._fs(f"{self.path}/{folder}/{name}")
            fs.delete(p, True)
        return [name for _, name in folders]

    def _snapshot(self) -> str | None:
        found = self._children(f"{self.path}/snapshots")
        return f"{self.path}/snapshots/{found[-1]}" if found else None

    def _merged(self, snapshot: str | None) -> DataFrame:
        """Names of the batches that the snapshot holds."""
        return self.spark.read.schema("batch string").parquet(f"{snapshot}/batches") if snapshot else self.spark.createDataFrame([], "batch string")

    def _open(self, snapshot: str | None) -> list[str]:
        """Names of the batches after the snapshot."""
        names = [n.removeprefix("batch=") for n in self._children(f"{self.path}/batches")]
        if not snapshot or not names:
            return names
        listed = self.spark.createDataFrame([(n,) for n in names], "batch string")
        return sorted(r.batch for r in listed.join(self._merged(snapshot), "batch", "left_anti").collect())

    def committed(self) -> list[str]:
        """Names of all batches that count."""
        snapshot = self._snapshot()
        return sorted({*self._open(snapshot), *(r.batch for r in self._merged(snapshot).collect())})

    def _holds(self, name: str) -> bool:
        """Whether a batch counts, without a look at the others."""
        return self._exists(f"{self.path}/batches/batch={name}/_SUCCESS") or not self._merged(self._snapshot()).where(F.col("batch") == name).isEmpty()

    def _publish(self, rows: DataFrame, to: str) -> bool:
        """Write rows aside and rename their folder to ``to``; False, and nothing left, if that is there already."""
        own = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/aside/{own}")
        fs, source = self._fs(f"{self.path}/aside/{own}")
        _, target = self._fs(to)
        fs.mkdirs(target.getParent())
        if not fs.exists(target) and fs.rename(source, target):
            _, nested = self._fs(f"{to}/{own}")  # a rename to a folder that came up meanwhile moves into it
            if not fs.exists(nested):
                return True
            source = nested
        fs.delete(source, True)
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of change rows (see ``signed``); False, and nothing done, if it was committed before.

        The rows are summed by key before they move, so that a key with most of the rows moves as one row a task.
        """
        name = "".join(c if c.isalnum() or c in "._-" else f"%{ord(c):02x}" for c in str(batch))
        return not self._holds(name) and self._publish(_summed(changes), f"{self.path}/batches/batch={name}")

    def commit_stream(self, changes: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: replayed micro-batches keep their id and so count once."""
        self.commit(f"stream-{batch_id:012d}", changes)

    def _deltas(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        # files alone: a folder that lies within a batch is a lost race's copy
        at = [f"{self.path}/batches/batch={n}/*.parquet" for n in batches] + ([f"{snapshot}/totals/*.parquet"] if snapshot else [])
        return self.spark.read.schema(SCHEMA).parquet(*at) if at else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) of all keys whose sums aren't zero."""
        snapshot = self._snapshot()
        return _summed(self._deltas(snapshot, self._open(snapshot))).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Sum all committed batches into one snapshot. A snapshot counts once its own mark is written, last.

        It takes the first number after all that are there, so that one which a lost driver left unfinished stands in nobody's way.
        """
        snapshot = self._snapshot()
        batches = self._open(snapshot)
        at = f"{self.path}/snapshots/{max(map(int, self._names(f'{self.path}/snapshots')), default=-1) + 1:012d}"
        if self._publish(_summed(self._deltas(snapshot, batches)), f"{at}/totals"):
            new = self.spark.createDataFrame([(b,) for b in batches], "batch string")
            self._merged(snapshot).unionByName(new).write.mode("overwrite").parquet(f"{at}/batches")
            fs, p = self._fs(f"{at}/_SUCCESS")
            fs.create(p, True).close()


def whitespace_words(text: Column) -> Column:
    """Words between white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def letter_runs(text: Column) -> Column:
    """Runs of letters and digits; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: SQL-expressible counters by tokenizer version. Others are passed to ``count_tokens`` by name.
COUNTERS = {"words-v1": whitespace_words, "words-v2": letter_runs, "bytes-v1": utf8_bytes}


def count_tokens(docs: DataFrame, counters: dict = COUNTERS) -> DataFrame:
    """(doc_id, source, lang) of every row and one count column for each tokenizer version, in one pass over the texts.

    Null and empty texts have 0 tokens; very long texts are counted whole; repeated rows count each; other columns are
    ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", "lang", *[f(text).alias(k) for k, f in counters.items()])


def vocabulary_tokens(path: str | None = None):  # noqa: ANN201
    """A counter of ``COUNTERS``' kind: ids by the vocabulary file at ``path``; strings of its added tokens are these tokens."""

    def counter(text: Column) -> Column:
        @F.pandas_udf("long")
        def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = packing.Encoder(path, added=True)
            for texts in parts:
                yield pd.Series([len(encoder(t)) if t else 0 for t in texts], dtype="int64")

        return count(text)

    return counter


def version(counts: DataFrame, name: str) -> DataFrame:
    """Rows of one tokenizer version, as ``signed`` takes them."""
    return counts.select("source", "lang", F.lit(name).alias("tokenizer_version"), F.col(f"`{name}`").alias("n_tokens"))


#: The query's totals by plain SQL: all documents but those of under 20 words, non-English words counted anew.
ORACLE_SQL = r"""
WITH d AS (SELECT source, lang, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS w1, len(regexp_extract_all(COALESCE(text, ''), '[\p{L}\p{N}]+')) AS w2,
           strlen(COALESCE(text, '')) AS b FROM documents),
r AS (SELECT source, lang, CASE WHEN COALESCE(lang, '') <> 'en' THEN 'words-v2' ELSE 'words-v1' END AS tokenizer_version, CASE WHEN COALESCE(lang, '') <> 'en' THEN w2 ELSE w1 END AS n FROM d WHERE w1 >= 20
      UNION ALL SELECT source, lang, 'bytes-v1', b FROM d WHERE w1 >= 20)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM r GROUP BY ALL
"""
