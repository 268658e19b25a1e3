import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality_classifier as Q
from lectern.llm.common import crc_mod


def test_held_out_accuracy(spark, sf_dir):
    at = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.classify(docs, labels, crc_mod("doc_id", 4) != 2).where(crc_mod("doc_id", 4) == 2).select("doc_id", "score", "predicted").join(labels, "doc_id")
    kept = {r.quality: r.kept for r in out.groupBy("quality").agg(F.avg("predicted").alias("kept")).collect()}
    assert kept[1] > 0.95 and kept[0] < 0.1 and out.where("score < 0 or score > 1").count() == 0


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    cx, cy = Q.isotonic(x, y)
    assert list(cy) == [0, 0.5, 1, 1] or (np.diff(cy) >= 0).all()
    assert np.isclose((np.interp(x, cx, cy) - y).sum(), 0, atol=1.0)


def test_edges(docs_of, spark):
    docs = docs_of([(i, "plain words of a good text here. " * 3 if i % 2 else "%%% ### ||| " * 5) for i in range(60)] + [(None, "x"), (100, None), (101, ""), (102, "y" * 300_000), (1, "again")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels)
    assert got.count() == 65 and got.where("score is null or score < 0 or score > 1").count() == 0
    by_id = {r.doc_id: r.predicted for r in got.where("doc_id between 10 and 59").collect()}
    assert all(v == k % 2 for k, v in by_id.items())
    assert Q.classify(docs, labels.limit(0)).first().score == 0.5 and Q.classify(docs.limit(0), labels).count() == 0
    assert Q.classify(docs, labels.withColumn("quality", F.lit(1))).where("score is null").count() == 0


def test_calibration_is_held_out_at_every_size(docs_of, spark):
    r = np.random.RandomState(3)
    n = 400
    docs = docs_of([(i, " ".join("abcdefgh"[: r.randint(1, 9)] for _ in range(r.randint(5, 60)))) for i in range(n)])
    labels = spark.createDataFrame([(i, int(r.randint(2)), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    # nothing can be learnt from labels by chance, so no score may be sure of them
    assert Q.classify(docs, labels).where("score >= 0.7 or score <= 0.3").count() < n / 4


def plain_isotonic(x, y):
    """Best non-decreasing fit of pooled points by the max-min formula."""
    vs = sorted(set(x))
    of = {v: [b for a, b in zip(x, y) if a == v] for v in vs}
    mean = lambda i, j: sum(sum(of[v]) for v in vs[i : j + 1]) / sum(len(of[v]) for v in vs[i : j + 1])
    return {v: max(min(mean(i, j) for j in range(k, len(vs))) for i in range(k + 1)) for k, v in enumerate(vs)}


def test_isotonic_pools_ties_in_any_order():
    assert [list(v) for v in Q.isotonic(np.array([1.0] * 4), np.array([0.0, 1, 0, 1]))] == [[1.0], [0.5]]
    r = np.random.RandomState(5)
    for _ in range(30):
        x, y = r.randint(0, 8, 40).astype(float), r.randint(0, 2, 40).astype(float)
        cx, cy = Q.isotonic(x, y)
        order = r.permutation(40)
        assert all(np.allclose(a, b) for a, b in zip((cx, cy), Q.isotonic(x[order], y[order])))
        want = plain_isotonic(x, y)
        blocks = sorted(set(np.round(list(want.values()), 9)))
        assert np.allclose(blocks, cy)


def test_same_as_dense_ridge(docs_of, spark):
    """Scores by one dense solution over all rows, with cross-fitted calibration, equal those of the summed equations."""
    r = np.random.RandomState(11)
    texts = {i: " ".join("".join(r.choice(list("abcdefghij .#1"), r.randint(1, 9))) for _ in range(r.randint(3, 50))) for i in range(120)}
    y = {i: int(("#" in t[:12]) ^ (r.rand() < 0.1)) for i, t in texts.items()}
    docs = docs_of(list(texts.items())).repartition(7)
    labels = spark.createDataFrame([(i, v, 0) for i, v in y.items()], "doc_id long, quality int, toxic int")
    fold = {k.doc_id: k.f for k in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(Q.FOLDS)).cast("int").alias("f")).collect()}
    ids = sorted(texts)
    x = np.array([Q.statistics(texts[i]) for i in ids])
    model = Q.QualityModel(x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8)), np.zeros(0), np.zeros(0), np.zeros(0))
    z, t, f = model.fourier(model.scaled(x)), np.array([float(y[i]) for i in ids]), np.array([fold[i] for i in ids])
    ridge = lambda keep: np.linalg.solve(z[keep].T @ z[keep] + Q.RIDGE * np.eye(z.shape[1]), z[keep].T @ t[keep])
    held = np.zeros(len(ids))
    for k in range(Q.FOLDS):
        held[f == k] = z[f == k] @ ridge(f != k)
    cx, cy = Q.isotonic(held, t)
    want = np.clip(np.interp(z @ ridge(f >= 0), cx, cy), 0, 1)
    got = {k.doc_id: k.score for k in Q.classify(docs, labels).select("doc_id", "score").collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-6)
