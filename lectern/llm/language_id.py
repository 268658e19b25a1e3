"""Language identification: nearest of several centroids per language over TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches, persist_shared

#: Expected number of documents per language that a fit reads, chosen by a hash of their id.
TRAIN_PER_LANGUAGE = 1_500
BUCKETS = 4_096
CENTROIDS = 3
KMEANS_ROUNDS = 15
#: A text is rejected if its cosine distance to the nearest centroid exceeds this quantile of the training distances, widened by a fifth.
REJECT_QUANTILE = 0.995
UNKNOWN = "und"
SEED = 11

_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of one to three letters over the whole lower-cased text.

    Digits and punctuation count as one kind of gap.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_is_letter(codes), codes, np.uint32(32))
    out = np.zeros(BUCKETS)
    h = np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(3):
            if len(codes) <= n:
                break
            h = (h[: len(codes) - n] + codes[n:]) * _MULTIPLIERS[n]
            h ^= h >> np.uint32(15)
            out += np.bincount((h >> np.uint32(7)) % np.uint32(BUCKETS), minlength=BUCKETS)
    return out


def _is_letter(codes: np.ndarray) -> np.ndarray:
    latin = (codes >= 97) & (codes <= 122)
    other = codes >= 0xAA
    if other.any():
        kinds, at = np.unique(codes[other], return_inverse=True)
        latin[other] = np.array([chr(c).isalpha() if c < 0x110000 else False for c in kinds])[at]
    return latin


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages * CENTROIDS) x BUCKETS, of length one
    owner: np.ndarray  # language number of every centroid
    reject: float

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, distance, rejected) of each text; UNKNOWN for texts without letters."""
        out = [(UNKNOWN, 0.0, 1.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for some in (at[k : k + 64] for k in range(0, len(at), 64)):
            near = self.vector(np.stack([ngram_counts(texts[i]) for i in some])) @ self.centroids.T
            by_language = np.full((len(self.languages), len(some)), -1.0)
            np.maximum.at(by_language, self.owner, near.T)
            best = by_language.argmax(0)
            cosine = by_language.max(0)
            score = np.minimum(1.0, 1 / np.exp(30 * (by_language - cosine)).sum(0))
            for i, k, s, d in zip(some, best, score.tolist(), (1 - cosine).tolist()):
                out[i] = (self.languages[k], s, d, d > self.reject)
        return out


def _spherical_clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of up to ``k`` clusters by cosine, started from rows far apart; the order is fixed by SEED."""
    first = int(np.argmax(x @ _unit(x.mean(0))))
    chosen = [first]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen].copy()
    for _ in range(KMEANS_ROUNDS):
        own = (x @ c.T).argmax(1)
        new = np.stack([_unit(x[own == i].mean(0)) if (own == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    big = np.bincount((x @ c.T).argmax(1), minlength=len(c)) >= max(2, 0.01 * len(x))
    return c[big] if big.any() else _unit(x.mean(0))[None, :]


def fit(docs: DataFrame, train: Column | None = None, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """Learn from rows with text and lang under ``train``: about ``per_language`` of each language.

    The sample of a language is what a hash of the ids deals out; all languages that occur are learnt. Every language is
    clustered in a task of its own: the driver sees document frequencies and centroids, never rows.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if train is not None:
        rows = rows.where(train)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0, int), 1.0)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(1_000_000 * min(1.0, per_language / n)))) for k, n in sizes.items()])
    part = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [ngram_counts(t).astype(np.float32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.binary())], names=["lang", "counts"])

    got = part.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, counts binary")
    got = persist_shared(got, "language-sample")

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many rows of a task every n-gram occurs; the last place counts the rows."""
        n = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for c in b.column(0).to_pylist():
                n[:BUCKETS] += np.frombuffer(c, np.float32) > 0
                n[BUCKETS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(n)], names=["bucket", "n"])

    found = np.zeros(BUCKETS + 1, np.int64)
    for r in got.select("counts").mapInArrow(holding, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    idf = np.log((1 + found[BUCKETS]) / (1 + found[:BUCKETS])) + 1

    def cluster(f: pd.DataFrame) -> pd.DataFrame:
        """One language's centroids, from at most about ``per_language`` rows."""
        x = np.stack([np.frombuffer(c, np.float32) for c in sorted(f.counts)])
        c = _spherical_clusters(_unit(np.log1p(x) * idf).astype(np.float32), CENTROIDS)
        return pd.DataFrame({"lang": f.lang.iloc[0], "centroid": [v.astype(float).tobytes() for v in c]})

    rows = got.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary").collect()  # CENTROIDS a language
    rows = sorted(rows, key=lambda r: (r.lang, r.centroid))
    languages = sorted({r.lang for r in rows})
    centroids = np.stack([np.frombuffer(r.centroid) for r in rows]) if rows else np.zeros((0, BUCKETS))
    model = LanguageModel(languages, idf, centroids, np.array([languages.index(r.lang) for r in rows], int), 1.0)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.frombuffer(c, np.float32) for c in b.column(0).to_pylist()]) if b.num_rows else np.zeros((0, BUCKETS))
            yield pa.RecordBatch.from_arrays([pa.array(1 - (model.vector(x) @ centroids.T).max(1) if len(x) else [], pa.float64())], names=["d"])

    if languages:
        model.reject = 1.2 * got.select("counts").mapInArrow(apart, "d double").agg(F.percentile("d", REJECT_QUANTILE)).first()[0]
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All rows of ``docs`` with lang_pred, score (0 to 1), distance and rejected (the text is far from all centroids).

    Texts that are null or hold no letter are UNKNOWN with score 0. A rejected text keeps the nearest language
    in ``lang_pred``. Ties go to the language that comes first in the alphabet. Very long texts are read whole; repeated
    rows are predicted each; columns of those names are replaced; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("struct<lang_pred:string,score:double,distance:double,rejected:boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict(list(texts)), columns=["lang_pred", "score", "distance", "rejected"])

    new = ("lang_pred", "score", "distance", "rejected")
    out = docs.withColumn("_language", predict(F.col("text").cast("string")))
    return out.select(*[c for c in docs.columns if c not in new], *[F.col(f"_language.{c}").alias(c) for c in new])
