import hashlib
import itertools
import random
import re

import numpy as np

from lectern.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TRICKY = [
    "a@b.c@d.e x@y.z. é@q.de", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 01.002.0003.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+41 (26) 300 71 11, +1+2 345 678 901",
    "@@@@ @a.b a@ a@b .@-.-", "1" * 40, "+" * 20, "", "0 0 0 0 0 0 0 0 0 0 0 0", "x1.2.3.4@5.6",
]


def test_base_is_what_the_patterns_find(docs_of, spark, sf_dir):
    for df in (docs_of(list(enumerate(TRICKY))), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in pii.digest(pii.find(df)).collect():
            assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest() and r.spans == brute(texts[r.doc_id])


def test_long_runs_stay_linear():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" * 50_000 + "." * 50_000) == []


def test_field_adds_repeated_mentions(docs_of):
    train = docs_of([(i, f"call me at +4126300{7000 + i} or write to ab{i}@mail.example.org about item {i}.") for i in range(300)])
    model = pii.fit(train)
    text = "Phone +41263001234 today. " + "Filler words here. " * 20 + "Again 41263001234 works."
    found = pii.find(docs_of([(1, text), (2, "Again 17 of 4 works."), (3, None)]), model)
    spans = {r.doc_id: r.spans for r in found.collect()}
    assert [s.base for s in spans[1]] == [True, False] and spans[1][1].kind == "phone"
    assert text[spans[1][1].start : spans[1][1].end] == "41263001234"
    assert spans[2] == [] and spans[3] == []


def test_mask(docs_of):
    df = docs_of([(1, "mail a.b@c.de now"), (2, None), (3, "clean")])
    got = {r.doc_id: r for r in pii.mask(df).collect()}
    assert got[1].text == "mail <email> now" and got[1].n_chars == 16 and got[2].text is None and got[3].text == "clean"
    assert pii.mask(df).columns == df.columns and pii.find(df.limit(0)).count() == 0
    assert pii.fit(df.limit(0)) is not None


def annotated(r, n, first):
    """Documents with mentions that no pattern matches, each told, and with numbers that are none: [(id, text)], [(id, kind, start, end)]."""
    docs, told = [], []
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choices("abcdefghijklm", k=r.randint(3, 8)))
    for i in range(first, first + n):
        text, spans = "", []
        for _ in range(r.randint(2, 5)):
            text += " ".join(word() for _ in range(r.randint(4, 15))) + " "
            pick = r.random()
            if pick < 0.3:
                lead, kind, what = r.choice(["call ", "phone: ", "tel. "]), "phone", f"0{digits(2)} {digits(3)} {digits(2)} {digits(2)}"
            elif pick < 0.5:
                lead, kind, what = r.choice(["mail ", "write to "]), "email", f"{word()}(at){word()}.{r.choice(['org', 'com', 'net'])}"
            elif pick < 0.7:
                lead, kind, what = r.choice(["paid ", "in ", "about "]), None, digits(r.randint(2, 4))
            elif pick < 0.85:
                lead, kind, what = r.choice(["scores ", "rows "]), None, " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(2, 4)))
            else:
                lead, kind, what = "mail ", None, f"{word()}@{word()}.org"  # the patterns have this one
            text += lead
            if kind:
                spans.append((i, kind, len(text), len(text) + len(what)))
            text += what + " "
        docs.append((i, text))
        told += spans
    return docs, told


def test_field_finds_what_no_pattern_does(docs_of, spark):
    r = random.Random(12)
    docs, told = annotated(r, 400, 0)
    model = pii.fit(docs_of(docs), spark.createDataFrame(told, "doc_id long, kind string, start long, end long"))
    docs, told = annotated(r, 150, 1000)
    found = {(x.doc_id, s.kind, s.start, s.end) for x in pii.find(docs_of(docs), model).collect() for s in x.spans if not s.base}
    right = found & set(told)
    print("added spans: precision", len(right) / len(found), "recall", len(right) / len(told))
    assert len(right) > 0.9 * len(found) and len(right) > 0.9 * len(told)


def test_marginals_by_enumeration(docs_of):
    """On graphs without loops messages give the exact marginals, whatever else stands in the batch."""
    r = np.random.RandomState(3)
    k = 1 + len(pii.KINDS)
    model = pii.SkipChain({f"f{i}": r.normal(size=k) for i in range(6)}, r.normal(size=k), r.normal(size=(k, k)), 1.3)
    g = pii.Nodes(text=[0] * 4 + [1] * 3, start=[0] * 7, end=[1] * 7, features=[(f"f{i % 6}", f"f{i * 5 % 6}") for i in range(7)], label=[0] * 7, chain=[(0, 1), (4, 5)], skip=[(1, 2), (2, 3), (5, 6)])
    u, got = model.unary(g.features), model.marginals(g)
    want = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        w = np.exp(sum(u[i, y[i]] for i in range(4)) + model.chain[y[0], y[1]] + model.agree * ((y[1] == y[2]) + (y[2] == y[3])))
        for i in range(4):
            want[i, y[i]] += w
    assert np.allclose(got[:4], want / want.sum(1, keepdims=True), atol=1e-3)
    alone = pii.Nodes(text=[0] * 3, start=[0] * 3, end=[1] * 3, features=g.features[4:], label=[0] * 3, chain=[(0, 1)], skip=[(1, 2)])
    assert np.array_equal(model.marginals(alone), got[4:])


def test_evidence_reaches_far(docs_of):
    k = 1 + len(pii.KINDS)
    model = pii.SkipChain({"phone": 8 * np.eye(k)[4]}, np.zeros(k), 3 * np.eye(k) - 1, 5.0)
    n = 60
    g = pii.Nodes(text=[0] * n, start=list(range(n)), end=list(range(1, n + 1)), features=[("phone",)] + [("none",)] * (n - 1), label=[0] * n, skip=[(i, i + 1) for i in range(n - 1)])
    kept = (np.exp(5.0) - 1) / (np.exp(5.0) + k - 1)  # what a link keeps of the evidence
    first = np.exp(8.0) / (np.exp(8.0) + k - 1)
    assert np.allclose(model.marginals(g)[:, 4], 1 / k + (first - 1 / k) * kept ** np.arange(n), atol=5e-3)
