"""Document quality: ridge regression on random Fourier features, calibrated by isotonic regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches, persist_shared

#: Labelled rows, chosen by a hash of their id, that a fit reads at most.
MAX_TRAIN_ROWS = 20_000
N_FOURIER = 128
RIDGE = 0.3
FOLDS = 5
#: Squared distances of standardised statistics are divided by 2 * (WIDTH ** 2) * their number.
WIDTH = 1.0
THRESHOLD = 0.7
SEED = 20_240

STATISTICS = (
    "log_words", "log_chars", "word_length", "word_length_spread", "distinct_words", "top_word", "adjacent_equal", "distinct_pairs", "repeated_lines",
    "log_line_words", "ended_lines", "upper", "digit", "space", "stop_punctuation", "comma", "symbol", "bar", "mark", "other_ascii", "non_ascii",
    "byte_entropy", "one_char_words", "ended_words", "symbol_words", "upper_words",
)

_END = (".", "!", "?", ":", '"', "”", "»", "…")


def _byte_class(chars: str) -> np.ndarray:
    mask = np.zeros(256)
    mask[[ord(c) for c in chars]] = 1
    return mask


_CLASSES = np.stack([
    _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_class("0123456789"), _byte_class(" \t\n\r\f\v"), _byte_class("."), _byte_class(","),
    _byte_class("#*$%&<>@^~=+_{}[]\\/"), _byte_class("|"), _byte_class("!?"), _byte_class("\"'`():;-"),
])


def statistics(text: str | None) -> list[float]:
    """The numbers in ``STATISTICS`` of one whole text; a null text counts as empty."""
    text = text or ""
    words = text.split()
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(float)
    n, total = len(words), max(1.0, hist.sum())
    shares = _CLASSES @ hist / total
    p = hist[hist > 0] / total
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    m, k = max(1, n), max(1, len(lines))
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    counts = Counter(words)
    return [
        np.log1p(n), np.log1p(len(text)), float(lengths.mean()), float(lengths.std()), len(counts) / m, max(counts.values(), default=0) / m,
        sum(map(str.__eq__, words, words[1:])) / m, len(set(zip(words, words[1:]))) / m, 1 - len(set(lines)) / k,
        np.log1p(n / k), sum(x.rstrip().endswith(_END) for x in lines) / k, *shares.tolist(), float(hist[128:].sum() / total),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, float((lengths == 1).mean()) if n else 0.0,
        sum(w[-1] in ".!?" for w in words) / m, sum(not w[-1].isalnum() and w[-1] not in ".,!?;:" for w in words) / m, sum(map(str.isupper, words)) / m,
    ]


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots_x: np.ndarray
    knots_y: np.ndarray

    @staticmethod
    def fourier(z: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel, and a constant; the frequencies come from SEED."""
        rng = np.random.RandomState(SEED)
        freq = rng.normal(size=(z.shape[1], N_FOURIER)) / (WIDTH * np.sqrt(z.shape[1]))
        shift = rng.uniform(0, 2 * np.pi, N_FOURIER)
        return np.hstack([np.sqrt(2 / N_FOURIER) * np.cos(z @ freq + shift), np.ones((len(z), 1))])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(self.scaled(x)) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots_x, self.knots_y), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool equal x, then adjacent violators; returns the centres and means of the blocks. The order of the rows does not matter."""
    values, at = np.unique(x, return_inverse=True)
    sums, counts = np.bincount(at, y, len(values)), np.bincount(at, minlength=len(values)).astype(float)
    blocks: list[list[float]] = []  # sum of x, sum of y, count
    for v, total, n in zip(values, sums, counts):
        blocks.append([v * n, total, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _summed(rows: DataFrame, partial) -> np.ndarray | None:
    """Sum of the matrices that ``partial`` makes of each partition's pandas frames, summed row by row in Spark."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                m = partial(f)
                total = m if total is None else total + m
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [f.i.iloc[0]], "v": [np.sum(np.stack(f.v.to_list()), axis=0)]})

    parts = rows.mapInPandas(emit, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
    got = parts.orderBy("i").collect()  # as many rows as there are features
    return np.array([r.v for r in got]) if got else None


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_rows: int = MAX_TRAIN_ROWS) -> QualityModel | None:
    """Fit on at most ``max_rows`` labelled documents; ``train`` is a condition on ``doc_id``.

    Rows with a null id or null quality teach nothing; an id with several labels takes their mean,
    1 from a half on. The normal equations, which every partition sums for itself, are kept by fold: each
    fold's scores for the calibration come from the weights of the other folds, at every size. None if no labelled document
    exists; labels that all agree give that label's score to all.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if train is not None:
        ok = ok.where(train)
    chosen = ok.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # chosen has max_rows rows of two numbers at most, so that it is sent to all tasks
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"y": f.y, "fold": f.fold, "x": list(_matrix(f.text))})

    folds = sample.select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS))).cast("int").alias("fold"))
    rows = persist_shared(folds.mapInPandas(measured, "y double, fold int, x array<double>"), "quality-sample")

    def moments(f: pd.DataFrame) -> np.ndarray:
        x = np.stack(f.x.to_list())
        return np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)])

    m = _summed(rows, moments)
    if m is None:
        return None
    mean = m[1] / m[0]
    model = QualityModel(mean, np.sqrt(np.maximum(m[2] / m[0] - mean**2, 1e-8)), np.zeros(0), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def normal(f: pd.DataFrame) -> np.ndarray:
        z, y, fold = model.fourier(model.scaled(np.stack(f.x.to_list()))), f.y.to_numpy(), f.fold.to_numpy()
        return np.vstack([np.hstack([z[fold == k].T @ z[fold == k], (z[fold == k].T @ y[fold == k])[:, None]]) for k in range(FOLDS)])

    def solved(eq: np.ndarray) -> np.ndarray:
        return np.linalg.solve(eq[:, :-1] + RIDGE * np.eye(len(eq)), eq[:, -1])

    eq = np.stack(np.split(_summed(rows, normal), FOLDS))
    model.weights = solved(eq.sum(0))
    others = np.stack([solved(eq.sum(0) - eq[k]) for k in range(FOLDS)])

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                z = model.fourier(model.scaled(np.stack(f.x.to_list())))
                yield pd.DataFrame({"s": (z * others[f.fold.to_numpy()]).sum(1), "y": f.y})

    held = rows.mapInPandas(raw, "s double, y double").toPandas()  # max_rows pairs of numbers at most
    if len(held):
        model.knots_x, model.knots_y = isotonic(held.s.to_numpy(), held.y.to_numpy())
    return model


def score_column(model: QualityModel | None, text: str = "text") -> Column:
    """The calibrated score of a text column; 0.5 for all if there is no model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    return score(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts are scored as texts without words, very long ones whole. Columns of those names are replaced.
    Repeated rows are scored each; equal raw scores have one calibrated score; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    model = fit(docs, labels, train)
    scored = docs.withColumn("score", score_column(model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
