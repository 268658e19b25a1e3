import re
from collections import defaultdict

import corpus_pipeline as P
import pytest
from test_minhash import classes
from test_pii import PATTERNS, plain_luhn

from lectern.llm import decontamination, minhash, packing, pii, quality_classifier
from lectern.llm.common import crc_mod


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "pii", "packing"]
    now = docs
    for name, stage in P.STAGES[:-1]:
        before = now.count()
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns, name
        assert (now.count() == before) if name == "pii" else (0 < now.count() < before), name
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    kept = docs.where(docs.doc_id.isin(list(ids)))
    assert minhash.near_duplicates(kept).where("doc_id <> class_id").count() == 0
    assert decontamination.overlaps(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert pii.find(now).where("exists(spans, s -> s.base)").count() == 0
    got = P.run(spark, sf_dir)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == ids
    assert got.selectExpr("sum(length) n").first().n == packing.pack_documents(now).selectExpr("sum(length) n").first().n


def holds(text, items):
    """Whether a text holds a window of an item, by every diagonal."""
    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    for own in items:
        n = min(13, len(own))
        need = n - (2 if n >= 13 else 1 if n >= 9 else 0)
        if len(set(own) & set(w)) * 3 < need:
            continue
        for shift in range(-len(own), len(w)):
            same = [0 <= shift + j < len(w) and w[shift + j] == t for j, t in enumerate(own)]
            if sum(same) >= need and any(sum(same[k : k + n]) >= need for k in range(len(own) - n + 1)):
                return True
    return False


def masked(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and plain_luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                found.append((m.start(), k, m.end(), kind))
    out, at = "", 0
    for s, _, e, kind in sorted(found):
        if e > at:
            out += text[at : max(at, s)] + (f"<{kind}>" if s >= at else "")
            at = e
    return out + text[at:]


def test_same_as_plain_versions(spark, sf_dir):
    """Every stage on what the one before kept, in plain Python; only the quality scores are the classifier's own."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    rows = sorted((r.doc_id, r.text) for r in scored.where("score >= 0.7").collect())
    of = classes(rows)
    rows = [(i, t) for i, t in rows if of[i] == i]
    items = [[x for x in re.split(r"[^\w]+|_", r.text.lower()) if x] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(i, masked(t)) for i, t in rows if not holds(t, items)]
    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    got, places = defaultdict(dict), defaultdict(list)
    for r in P.run(spark, sf_dir).collect():
        ids = [int.from_bytes(r.ids_le[k : k + 4], "little") for k in range(0, len(r.ids_le), 4)]
        assert len(ids) == r.length
        got[r.doc_id][r.start] = ids
        places[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()} == want
    for p in places.values():
        ends = 0
        for at, n in sorted(p):
            assert at == ends
            ends += n
        assert ends <= 1024


@pytest.mark.parametrize("rows", [0, 1])
def test_edge_tables(spark, docs_of, tmp_path, rows):
    clean = "Plain words of a good text stand here, one after the other, and nothing else is to be said of them today. "
    cases = [(1, clean * 3), (1, clean * 3), (2, None), (3, ""), (None, "no id " + clean), (4, "%% ## || " * 30), (5, "long " + " ".join(f"word{i}" for i in range(60_000))), (6, "mail me at a.b@c.de " + clean), (7, "other text of the id " + clean), (7, clean * 3)]
    docs = docs_of(cases).withColumnRenamed("n", "_key0")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in (1, 2, 3, 4, 5, 6)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "never said here in any of the texts at all by anyone")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        (df if rows else df.limit(0)).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[1:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    kept = sorted(((r.doc_id, r.text and r.text[:12]) for r in now.collect()), key=str)
    assert kept == (sorted([(1, "Plain words "), (2, None), (3, ""), (None, "no id Plain "), (4, "%% ## || %% "), (5, "long word0 w"), (6, "mail me at <"), (7, "other text o")], key=str) if rows else [])
    first = P.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert first.columns == docs.columns and (rows or first.count() == 0)
    assert {r.score for r in first.collect()} <= {0.5}  # the table's own column of that name
    if not rows:
        assert P.run(spark, str(tmp_path)).count() == 0
