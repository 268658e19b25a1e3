"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches, persist_shared

KINDS = ("email", "ip", "card", "phone")
#: Documents, chosen by a hash of their text, that potentials are estimated from (as expected number).
TRAIN_DOCS = 20_000
#: Distinct feature rows that a fit takes at most, chosen by a hash.
TRAIN_ROWS = 50_000
DAMPING = 0.3
#: Messages of a document rest once none changes by more than this.
REST = 1e-4
#: Marginal probability from which a token belongs to an entity.
ACCEPT = 0.6
SPAN_TYPE = "array<struct<kind:string,start:long,end:long,base:boolean>>"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEEN = re.compile(r"[0-9@]|[\[({]at[\])}]", re.I)
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    """Whether a string of digits ends in the right check digit."""
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from left to right; every @ is visited once, so that long runs stay linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all matches of the fixed patterns, ascending."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Nodes:
    """Tokens with a digit, an @ or a bracketed "at" of some texts, as the nodes of one graph."""

    text: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    features: list[tuple[str, ...]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)  # 0: outside, else 1 + kind number by the patterns
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def _features(token: str, before: str) -> tuple[str, ...]:
    d = _digits(token)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token))[:16]
    parts = token.strip(".,;:()").split(".")
    ip = len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) <= 255 for p in parts)
    known = "luhn" if 12 <= len(d) <= 19 and luhn(d) else "address" if ip else "mail" if _DOMAIN.search(token.rpartition("@")[2]) and "@" in token else "plain"
    ahead = re.sub("[0-9]", "9", before)[-6:].lower()
    return (f"s:{shape}", f"n:{min(len(d), 20)}", f"k:{known}", f"b:{ahead}", f"j:{shape}:{ahead}", f"p:{token[0] if not token[0].isalnum() else 'w'}", f"m:{known}:{min(len(d), 20)}")


def _key(token: str) -> str | None:
    """What repeated or similar mentions of one thing share: their digits, or the letters of an address."""
    d = _digits(token)
    if "@" in token:
        return token.strip(".,;:()<>\"'").lower()
    return d if len(d) >= 7 else None


def nodes_of(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Nodes:
    """Neighbouring tokens are linked in a chain; mentions of one key, however far apart, to the next mention."""
    g = Nodes()
    for i, text in enumerate(texts):
        if not _SEEN.search(text):
            continue
        own, k, last_word, last_node, seen = spans[i], 0, "", -1, {}
        for word_no, m in enumerate(_WORD.finditer(text)):
            w = m.group()
            if _SEEN.search(w):
                n, a, b = len(g.text), m.start(), m.end()
                while k < len(own) and own[k][2] <= a:
                    k += 1
                hit = next((s for s in own[k : k + 8] if s[0] < b and s[2] > a), None)
                g.text.append(i), g.start.append(a), g.end.append(b)
                g.features.append(_features(w, last_word))
                g.label.append(0 if hit is None else 1 + hit[1])
                if last_node == word_no - 1 and word_no:
                    g.chain.append((n - 1, n))
                if (key := _key(w)) is not None:
                    if key in seen:
                        g.skip.append((seen[key], n))
                    seen[key] = n
                last_node = word_no
            last_word = w
    return g


@dataclass
class SkipChain:
    """Potentials of the field: log weights of features, of neighbours' labels, of agreement over a skip."""

    weights: dict[str, np.ndarray]
    prior: np.ndarray
    chain: np.ndarray
    agree: float

    def unary(self, features: list[tuple[str, ...]]) -> np.ndarray:
        out = np.tile(self.prior, (len(features), 1))
        for i, fs in enumerate(features):
            for f in fs:
                if (w := self.weights.get(f)) is not None:
                    out[i] += w
        return out

    def marginals(self, g: Nodes) -> np.ndarray:
        """Loopy sum-product: damped messages step together, and each document's stop once they rest.

        A document's messages never depend on others. Evidence moves one link a step; messages that go round without
        ever resting are stopped after 50 steps and twice the document's nodes.
        """
        u = self.unary(g.features)
        n_labels = u.shape[1]
        edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
        if len(edges):
            pair = np.concatenate([np.tile(np.exp(self.chain), (len(g.chain), 1, 1)), np.tile(np.exp(self.agree * np.eye(n_labels)), (len(g.skip), 1, 1))])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            doc = np.array(g.text, np.int64)[source]
            most = 50 + 2 * np.bincount(np.array(g.text, np.int64))
            message, total = np.zeros((len(source), n_labels)), u.copy()
            live, steps = np.arange(len(source)), 0
            while len(live):
                steps += 1
                belief = total[source[live]] - message[back[live]]
                belief = np.exp(belief - belief.max(1, keepdims=True))
                new = np.log(np.einsum("el,elk->ek", belief, pair[live]))
                new -= new.max(1, keepdims=True)
                moved = np.zeros(len(most))
                np.maximum.at(moved, doc[live], np.abs(new - message[live]).max(1))
                message[live] = DAMPING * message[live] + (1 - DAMPING) * new
                at = target[live]
                fresh = u + np.stack([np.bincount(at, message[live][:, k], len(u)) for k in range(n_labels)], 1)
                total[at] = fresh[at]
                live = live[(moved[doc[live]] >= REST) & (steps < most[doc[live]])]
            u = total
        p = np.exp(u - u.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, annotations: DataFrame | None = None, train_docs: int = TRAIN_DOCS, train_rows: int = TRAIN_ROWS) -> SkipChain:
    """Potentials by piecewise estimation from about ``train_docs`` documents, chosen by a hash of their text.

    Labels are the matches of the fixed patterns and, where given, ``annotations``: (doc_id, kind, start, end) of mentions
    that the patterns miss, such as numbers in parts or addresses that are written out. Each factor is estimated for
    itself: feature weights by logistic regression on counted rows of features, at most ``train_rows`` distinct ones,
    chosen by a hash; the chain by smoothed label pairs and the skip edges by how often mentions of one key agree, both
    counted over the whole sample. Null texts teach nothing; repeated rows count each; without rows all potentials are flat.
    """
    arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            spans = []
            for t, more in zip(texts, b.column(1).to_pylist()):
                base = base_spans(t)
                extra = [(m["start"], KINDS.index(m["kind"]), m["end"]) for m in more or [] if m["kind"] in KINDS and not any(a < m["end"] and e > m["start"] for a, _, e in base)]
                spans.append(sorted(base + extra))
            g = nodes_of(texts, spans)
            seen.update(("f", "\x1f".join(f), y) for f, y in zip(g.features, g.label))
            for what, edges in (("c", g.chain), ("s", g.skip)):
                seen.update((what, str(g.label[i]), g.label[j]) for i, j in edges)
        rows = list(seen.items())
        cols = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [k[2] for k, _ in rows], [n for _, n in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["what", "feature", "label", "n"])

    total = max(1, docs.count())
    text = F.col("text").cast("string").alias("text")
    mention = "array<struct<kind:string,start:long,end:long>>"
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, train_docs / total)))
    if annotations is None:
        part = part.select(text, F.lit(None).cast(mention).alias("more"))
    else:
        known = annotations.groupBy("doc_id").agg(F.collect_list(F.struct("kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("more"))
        part = part.select("doc_id", text).join(known, "doc_id", "left").select("text", "more")
    counted = part.mapInArrow(count, "what string, feature string, label int, n long").groupBy("what", "feature", "label").agg(F.sum("n").alias("n"))
    counted = persist_shared(counted, "field-counts")
    pairs = counted.where("what <> 'f'").collect()  # label pairs
    rows = pairs + counted.where("what = 'f'").orderBy(F.xxhash64("feature"), "feature", "label").limit(train_rows).collect()
    n_labels = 1 + len(KINDS)
    chain, agree = np.ones((n_labels, n_labels)), [1.0, 1.0]
    features: dict[str, int] = {}
    index, label, weight = [], [], []
    for r in rows:
        if r.what == "f":
            index.append([features.setdefault(f, len(features)) for f in r.feature.split("\x1f")])
            label.append(r.label), weight.append(float(r.n))
        elif r.what == "c":
            chain[int(r.feature), r.label] += r.n
        else:
            agree[int(int(r.feature) == r.label)] += r.n
    w = np.zeros((len(features) + 1, n_labels))
    w[-1, 0] = 1.0
    if index:
        x, y, c = np.array(index), np.eye(n_labels)[label], np.array(weight)
        speed = np.full_like(w, 1e-8)
        for _ in range(150):
            z = w[x].sum(1) + w[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - y) * c[:, None]
            grad = 0.05 * w
            np.add.at(grad, x, np.repeat(g[:, None, :], x.shape[1], 1))
            grad[-1] += g.sum(0)
            speed += grad**2
            w -= 0.5 * grad / np.sqrt(speed)
    joint = chain / chain.sum()
    pmi = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    return SkipChain({f: w[i] for f, i in features.items()}, w[-1], np.clip(pmi, -3, 3), float(np.clip(np.log(agree[1] / agree[0]), 0, 6)))


def all_spans(texts: list[str], model: SkipChain | None) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind number, end, by the patterns) of every text; a span of the field never meets one of the patterns."""
    base = [base_spans(t) for t in texts]
    out: list[list] = [[(*s, True) for s in b] for b in base]
    if model is None:
        return out
    g = nodes_of(texts, base)
    if not g.text:
        return out
    p = model.marginals(g)
    best = p[:, 1:].argmax(1)
    taken = (p[:, 1:].sum(1) >= ACCEPT) & (np.array(g.label) == 0)
    joined = {j for _, j in g.chain}
    runs: dict[int, list[list[int]]] = defaultdict(list)
    last = -2
    for i in np.flatnonzero(taken):
        t, k = g.text[i], int(best[i])
        if last == i - 1 and i in joined and runs[t] and runs[t][-1][1] == k:
            runs[t][-1][2] = g.end[i]
        else:
            runs[t].append([g.start[i], k, g.end[i]])
        last = i
    for t, found in runs.items():
        for s, k, e in found:
            token = texts[t][s:e]
            s, e = s + len(token) - len(token.lstrip(" .,;:()<>\"'[]")), e - (len(token) - len(token.rstrip(" .,;:()<>\"'[]")))
            if s < e and not any(a < e and b > s for a, _, b in base[t]):
                out[t].append((s, k, e, False))
        out[t].sort()
    return out


def find(docs: DataFrame, model: SkipChain | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every row: spans holds kind, start, end (code points, end exclusive) and base, by start then kind.

    ``base`` marks matches of the fixed patterns; the others are the field's. Without a model there are only
    base spans. A null or empty text has none, a very long one is searched whole. Repeated rows are searched each;
    where two labels are as likely the first kind wins; further columns are ignored; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = all_spans([t or "" for t in b.column(1).to_pylist()], model)
            spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": own} for s, k, e, own in x] for x in found], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), spans], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(search, f"doc_id long, spans {SPAN_TYPE}")


def mask(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and ``n_chars`` (if there) counted anew."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def hidden(texts):  # noqa: ANN001, ANN202
        whole = [t or "" for t in texts]
        out = []
        for t, text, spans in zip(texts, whole, all_spans(whole, model)):
            parts, at = [], 0
            for s, k, e, _ in spans:
                if e > at:
                    parts += [text[at : max(at, s)], f"<{KINDS[k]}>" if s >= at else ""]
                    at = e
            out.append(None if t is None else "".join(parts) + text[at:] if spans else text)
        return type(texts)(out, dtype=object)

    masked = docs.withColumn("text", hidden(F.col("text").cast("string")))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and a hash of the base spans, and all spans as text."""

    def joined(spans):  # noqa: ANN001, ANN202
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
