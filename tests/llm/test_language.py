import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import language_id as L
from lectern.llm.common import crc_mod


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    model = L.fit(docs, crc_mod("doc_id", 3) != 1)
    out = L.identify(docs, model).where(crc_mod("doc_id", 3) == 1)
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97 and out.where("score < 0 or score > 1").count() == 0


def test_edges(docs_of, spark):
    docs = docs_of([(i, f"the quick brown fox number {i}") for i in range(40)])
    german = docs_of([(i, f"der schnelle braune Fuchs Nummer {i}") for i in range(40, 80)]).withColumn("lang", F.lit("de"))
    model = L.fit(docs.unionByName(german))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in L.identify(docs_of([(1, None), (2, ""), (3, "123 !? ²"), (4, "a brown fox"), (5, "x" * 200_000), (None, "der Fuchs")]), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == L.UNKNOWN and got[1].score == 0
    assert got[4].lang_pred == "en" and got[None].lang_pred == "de" and got[5].rejected
    none = L.fit(docs.limit(0))
    assert L.identify(docs.limit(3), none).first().lang_pred == L.UNKNOWN and L.identify(docs.limit(0), model).count() == 0
    assert L.fit(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_same_as_plain_tf_idf(docs_of, monkeypatch):
    """With one centroid a language, predictions are those of plain TF-IDF means."""
    monkeypatch.setattr(L, "CENTROIDS", 1)
    said = {"en": "the cat and the dog sat on mat number {}", "de": "der Hund und die Katze auf der Matte {}", "fr": "le chat et le chien sur le tapis {}"}
    rows = {(k, i): t.format("xyz"[i % 3] * (1 + i % 4)) for k, t in said.items() for i in range(20)}
    df = None
    for n, k in enumerate(said):
        part = docs_of([(100 * n + i, rows[k, i]) for i in range(20)]).withColumn("lang", F.lit(k))
        df = part if df is None else df.unionByName(part)
    model = L.fit(df)
    counts = {k: Counter(dict(enumerate(L.ngram_counts(t)))) for k, t in rows.items()}
    idf = [math.log((1 + len(rows)) / (1 + sum(c[b] > 0 for c in counts.values()))) + 1 for b in range(L.BUCKETS)]
    assert np.allclose(model.idf, idf)

    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    def vector(text):
        return unit([math.log1p(c) * w for c, w in zip(L.ngram_counts(text), idf)])

    means = {}
    for k in said:
        vs = [vector(rows[k, i]) for i in range(20)]
        means[k] = unit([sum(v[b] for v in vs) for b in range(L.BUCKETS)])
    for text in ("a dog on the mat", "die Katze", "le chien et le chat", "der the le", "zzz"):
        cosine = {k: sum(a * b for a, b in zip(vector(text), m)) for k, m in means.items()}
        lang, _, distance, rejected = model.predict([text])[0]
        assert lang == max(sorted(cosine), key=cosine.get) and math.isclose(distance, 1 - max(cosine.values()), abs_tol=1e-5)
        assert rejected == (distance > model.reject)
