import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import packing as P


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(P.vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, texts, plain, window=P.WINDOW):
    """Every id of every document lies in one piece; every sequence is gapless and within the window."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    assert set(by_doc) == set(texts)
    for doc, ps in by_doc.items():
        ids = np.array(plain(texts[doc]), "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    return sum(p.length for p in pieces) / len(by_seq) / window


def test_table(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fill = check(P.digest(P.pack_documents(docs)).collect(), {r.doc_id: r.text for r in docs.collect()}, plain)
    assert fill > 0.97


def test_edges(docs_of, plain):
    texts = {1: None, 2: "", 3: "word " * 1023, 4: "word " * 5000, 5: "x <|endoftext|> y", 6: "\n" * 3000}
    check(P.digest(P.pack_documents(docs_of(list(texts.items())))).collect(), texts, plain)
    check(P.digest(P.pack_documents(docs_of(list(texts.items())), group_tokens=500)).collect(), texts, plain)
    df = docs_of([(1, "a"), (1, "a"), (None, "b")])
    assert P.pack_documents(df).count() == 3 and P.pack_documents(df.limit(0)).count() == 0


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_best_fit(lengths):
    places = P.best_fit_decreasing(lengths, 64)
    used = defaultdict(int)
    slow: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        no, offset = places[k]
        assert used[no] == offset
        used[no] += lengths[k]
        fits = [r for r in slow if r >= lengths[k]]  # brute force: the least remaining capacity that fits
        if fits:
            slow.remove(min(fits))
        slow.append((min(fits) if fits else 64) - lengths[k])
    assert all(v <= 64 for v in used.values()) and len(used) == len(slow)


def test_query_finds_added_tokens(docs_of, tmp_path, spark):
    from lectern.llm import queries

    texts = {1: "x <|endoftext|> y", 2: "<|endoftext|><|endoftext|>", 3: "a<|endoftext|>b <|endoftext |>\n"}
    docs_of(list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(P.vocabulary_path())
    check(queries.op6_packing(spark, str(tmp_path)).collect(), texts, lambda t: [*own.encode(t, add_special_tokens=False).ids, 0])
