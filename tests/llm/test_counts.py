import uuid
from collections import Counter

import pytest
from compare import assert_same

from lectern.llm import queries
from lectern.llm import token_rollup as K
from lectern.storage import shared_dir


def test_same_as_sql(spark, sf_dir, duck):
    assert_same(queries.op4_token_counts(spark, sf_dir), duck.sql(K.ORACLE_SQL))


def test_commits(spark):
    r = K.TokenRollup(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    rows = lambda: sorted(map(tuple, r.totals().collect()), key=str)
    assert rows() == [] and r.committed() == []
    c = spark.createDataFrame([("a", "en", "v1", 3), ("a", "en", "v1", 4), (None, None, "v1", None)], "source string, lang string, tokenizer_version string, n_tokens long")
    assert r.commit("1", K.signed(c, 1)) and not r.commit("1", K.signed(c, 1))
    assert rows() == sorted([("a", "en", "v1", 2, 7), (None, None, "v1", 1, 0)], key=str)
    new = spark.createDataFrame([("a", "en", "v2", 9)], "source string, lang string, tokenizer_version string, n_tokens long")
    r.commit("2", K.revised(c.where("n_tokens = 4"), new))
    r.compact()
    assert not r.commit("2", K.signed(new, 1)) and r.committed() == ["1", "2"]
    r.commit_stream(K.signed(c.where("n_tokens = 3"), -1), 0)
    r.commit_stream(K.signed(c.where("n_tokens = 3"), -1), 0)
    assert rows() == sorted([("a", "en", "v2", 1, 9), (None, None, "v1", 1, 0)], key=str)
    r.compact()
    assert rows() == sorted([("a", "en", "v2", 1, 9), (None, None, "v1", 1, 0)], key=str)
    half = K.TokenRollup(spark, r.path)
    K.signed(new, 1).write.parquet(f"{r.path}/batches/batch=lost/_temporary/0")  # a batch that never finished counts nothing
    assert sorted(map(tuple, half.totals().collect()), key=str) == rows()


def test_real_tokens(spark, sf_dir):
    from tokenizers import Tokenizer

    from lectern.llm import packing

    tok, want = Tokenizer.from_file(packing.vocabulary_path()), Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        if r.source != "src1":
            want[r.source, r.lang] += len(tok.encode(r.text or "", add_special_tokens=False).ids)
    got = queries.token_counts_vocabulary(spark, sf_dir).collect()
    assert {(r.source, r.lang): r.n_tokens for r in got if r.tokenizer_version == "byte-bpe-50k"} == dict(want)
    assert all(r.tokenizer_version == "words-v2" for r in got if r.source == "src1") and any(r.source == "src1" for r in got)


def test_counting_edges(docs_of):
    df = docs_of([(1, None), (2, ""), (2, "two words"), (2, "two words"), (None, "x" * 500_000), (3, "a " * 100_000), (4, "<|endoftext|>")])
    at = K.COUNTERS | {"bpe": K.vocabulary_tokens()}
    got = sorted(((r.doc_id, r["words-v1"], r["bytes-v1"]) for r in K.count_tokens(df, at).collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (2, 2, 9), (2, 2, 9), (None, 1, 500_000), (3, 100_000, 200_000), (4, 1, 13)], key=str)
    ids = {(r.doc_id, r["words-v1"]): r.bpe for r in K.count_tokens(df, at).collect()}
    assert ids[1, 0] == 0 and ids[2, 2] == 2 and ids[4, 1] == 1 and ids[None, 1] > 1000
    assert K.count_tokens(df.limit(0)).count() == 0


def test_two_writers_of_one_batch(spark):
    r = K.TokenRollup(spark, f"{shared_dir(spark)}/w-{uuid.uuid4().hex}")
    c = spark.createDataFrame([("a", "en", "v1", 3)], "source string, lang string, tokenizer_version string, n_tokens long")
    at = f"{r.path}/batches/batch=one"
    assert r._publish(K._summed(K.signed(c, 1)), at) and not r._publish(K._summed(K.signed(c, 1)), at)
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 1, 3)] and r.committed() == ["one"]


def test_a_compaction_that_dies_is_done_again(spark, monkeypatch):
    """Killed before and after each of its steps, a compaction leaves the totals as they are, and the next one works."""
    c = spark.createDataFrame([("a", "en", "v1", 3)], "source string, lang string, tokenizer_version string, n_tokens long")
    r = K.TokenRollup(spark, f"{shared_dir(spark)}/w-{uuid.uuid4().hex}")
    assert [tuple(x) for x in r.totals().collect()] == [] and r.committed() == []
    total = lambda: [tuple(x) for x in r.totals().collect()]
    for k in range(3):
        r.commit(f"b{k}", K.signed(c, 1))
        with monkeypatch.context() as m:
            keep, calls = K.TokenRollup._fs, []

            def dies(self, at, k=k, calls=calls, keep=keep):
                calls.append(at)
                if "snapshots/0" in at and sum("snapshots/0" in x for x in calls) > k:
                    raise KeyboardInterrupt
                return keep(self, at)

            m.setattr(K.TokenRollup, "_fs", dies)
            with pytest.raises(KeyboardInterrupt):
                r.compact()
        assert total() == [("a", "en", "v1", k + 1, 3 * (k + 1))]
    r.compact()
    assert total() == [("a", "en", "v1", 3, 9)] and r._open(r._snapshot()) == []
    assert r.sweep() and not r._names(f"{r.path}/batches") and len(r._names(f"{r.path}/snapshots")) == 1
    assert not r.commit("b0", K.signed(c, 1)) and r.commit("b9", K.signed(c, 1)) and total() == [("a", "en", "v1", 4, 12)]


def test_copies_within_a_batch_do_not_count(spark):
    """A lost race leaves its folder within the batch until it is cleared away."""
    c = spark.createDataFrame([("a", "en", "v1", 3)], "source string, lang string, tokenizer_version string, n_tokens long")
    r = K.TokenRollup(spark, f"{shared_dir(spark)}/w-{uuid.uuid4().hex}")
    r.commit("one", K.signed(c, 1))
    K._summed(K.signed(c, 1)).write.parquet(f"{r.path}/batches/batch=one/{uuid.uuid4().hex}")
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 1, 3)]
