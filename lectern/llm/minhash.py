"""Near-duplicate documents: ProbMinHash of weighted word shingles, banding, exact verification."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import arrow_batches, forget, persist_shared
from lectern.operators.graph import connected_components
from lectern.operators.skew import dealt_join

SHINGLE = 5
SIMILARITY = 0.8
#: Signature places; 25 bands of 5 miss a pair at the threshold with a probability of 5e-5.
PLACES = 128
BANDS, ROWS = 25, 5
#: Places of the sketches (a byte each) that compare the members of mixed buckets. At the threshold a pair's
#: estimate has a standard error of 0.0125; pairs estimated SLACK of these below it are not verified.
SKETCH_PLACES, SLACK = 1024, 4.5
#: Members of one block of a bucket, on average, and blocks of one side of a task's share of a bucket.
BLOCK, SHARE = 64, 16
#: Up to so many ids (8 bytes each) are sent to all tasks; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Pairs of one hub are dealt out in groups of about this many.
HUB_GROUP = 256
#: Words whose hashes a task remembers.
WORDS_KEPT = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word, computed once while it is remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def weighted_shingles(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times it occurs), by text and hash.

    A text of one to four words has one shingle of all its words; one without words has none.
    """
    parts, lengths = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = (t or "").split()
        if words:
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            if len(h) < SHINGLE:
                h = np.concatenate([h, np.zeros(SHINGLE - len(h), np.uint64)])
            parts.append(h)
            lengths[i] = len(h)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    w = np.concatenate(parts)
    n = len(w) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s = mix(s + w[k : k + n] * _ODD[k])
    ends = np.cumsum(lengths)
    whole = np.ones(len(w), bool)
    for k in range(1, SHINGLE):
        whole[ends[lengths > 0] - k] = False
    s, doc = s[whole[:n]], np.repeat(np.arange(len(texts)), lengths)[:n][whole[:n]]
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(at[:-1], at[1:]):
        s[a:b].sort()
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    places = np.flatnonzero(first)
    return doc[places], s[places], np.diff(np.append(places, len(s))).astype(float)


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, places: int = PLACES) -> np.ndarray:
    """Signatures (documents x places): each place holds the element that arrives there first.

    Every element is a Poisson process of its weight's rate, driven by its own hash; arrival j falls on a
    random place. All processes step together, and one ends as soon as its next arrival is later than the
    latest first arrival of its document, for it can't win a place any more.
    """
    best = np.full(n_docs * places, np.inf)
    winner = np.zeros(n_docs * places, np.uint64)
    latest = np.full(n_docs, np.inf)
    time = np.zeros(len(element))
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(element):
            step += np.uint64(1)
            r = mix(element + step * _GOLD)
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
            alive = time < latest[doc]
            doc, element, weight, time, r = doc[alive], element[alive], weight[alive], time[alive], r[alive]
            place = doc * places + (r & np.uint64(places - 1)).astype(np.int64)
            np.minimum.at(best, place, time)
            won = best[place] == time
            winner[place[won]] = element[won]
            latest = best.reshape(n_docs, places).max(1)
    return winner.reshape(n_docs, places)


def band_values(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of each signature; different bands never share a value by place."""
    parts = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS)
    v = np.arange(BANDS, dtype=np.uint64)[None, :] * _GOLD
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            v = mix(v + parts[:, :, k] * _ODD[k])
    return v.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights); equal weights: plain Jaccard."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][ia], b[1][ib]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    lower = np.searchsorted(r, ratio, "left")  # common elements whose ratio is below one's own
    sum_b = np.concatenate([[0.0], np.cumsum(wb[order])])[lower]
    above_a = wa.sum() - np.concatenate([[0.0], np.cumsum(wa[order])])[lower]
    return float((wa / (above_a + only_a + ratio * (sum_b + only_b))).sum())


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, bands): key tells equal texts; bands is null for texts without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for b in batches:
                texts = b.column(2).to_pylist()
                doc, s, w = weighted_shingles(texts, hashes)
                has = np.zeros(len(texts), bool)
                has[doc] = True
                v = band_values(probminhash(doc, s, w, len(texts))) if len(texts) else np.zeros((0, BANDS), np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)), pa.array(v[has].ravel()))
                bands = pa.array([x if h else None for x, h in zip(bands.to_pylist(), has)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bands], names=["doc_id", "key", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text_col).cast("binary")).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.where("key is not null").mapInArrow(sign, "doc_id long, key string, bands array<long>")


def by_id(rows: DataFrame, ids: DataFrame, how: str, column: str | list[str] = "doc_id") -> DataFrame:
    """Join the wide ``rows`` with ids: sent to all tasks if their counted number is small, else shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), column, how)


def _node_texts(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the nodes in ``ids``, by the name of the node: of a document with several texts each node has its own."""
    wanted = nodes.join(ids.select(F.col("doc_id").alias("node")), "node").select(F.col("doc_id"), F.col("key").alias("_key"), F.col("node").alias("_node"))
    rows = by_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "inner")
    return rows.where(F.md5(F.col("text").cast("binary")) == F.col("_key")).select(F.col("_node").alias("doc_id"), "text")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts have a probability Jaccard of at least ``similarity``.

    Texts of the documents in pairs are fetched once for b and once for a. The pairs of one a are dealt
    out in groups, so that a hub with many partners is no single task's work.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = persist_shared(_node_texts(docs, nodes, ids), "candidate-texts")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / HUB_GROUP)).cast("int")
    dealt = dealt_join(pairs, sizes, "a", "b", pairs.count(), few=0).select("a", "b", part.alias("part"))
    left = texts.join(dealt.select(F.col("a").alias("doc_id"), "part").distinct(), "doc_id").select(F.col("doc_id").alias("a"), "part", F.col("text").alias("text_a"))
    rows = dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(left, ["a", "part"]).select("a", "b", "text_a", "text_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, own = WordHashes(), None, None
        with np.errstate(over="ignore"):
            for batch in batches:
                kept = []
                for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                    if ta != last:
                        last, own = ta, weighted_shingles([ta], hashes)[1:]
                    if probability_jaccard(own, weighted_shingles([tb], hashes)[1:]) >= similarity:
                        kept.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = persist_shared(rows.mapInArrow(test, "a long, b long").distinct(), "links-found")
    forget(texts)
    return found


def _blocked_candidates(member: DataFrame, docs: DataFrame, nodes: DataFrame, labels: DataFrame, similarity: float) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Pairs (a, b) of different components that share a bucket and whose sketches are close enough to verify.

    Members of a bucket are dealt into blocks and every two blocks of a bucket meet in one row, so that a
    bucket of any size is compared whole, block by block, without a row for each pair. A bucket's blocks are dealt in
    groups of SHARE, and every two groups meet in a task's share of their own, so that a large bucket is many tasks' work.
    A pair that shares several buckets is looked at in the first of them. The tables that the pairs are read from come with them.
    """
    at = member.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("n")).where("lo <> hi").select("bucket", "n")
    at = persist_shared(dealt_join(at.drop("n"), mixed, "bucket", "id", member.count()), "mixed-buckets")
    ids = at.select(F.col("id").alias("doc_id")).distinct()
    sketched = _sketches(_node_texts(docs, nodes, ids))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")
    one = F.struct("id", "component", "buckets", "sketch")
    blocks = at.join(sketched, "id").groupBy("bucket", block).agg(F.collect_list(one).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("n"))
    blocks = persist_shared(blocks, "blocks")
    share = F.floor(F.col("block") / SHARE).cast("int")
    last = F.floor((F.ceil(F.col("n") / BLOCK) - 1) / SHARE).cast("int")
    held = ["bucket", "block", "m", "lo", "hi"]
    left, right = (
        blocks.select(*held, share.alias(f"share_{own}"), F.explode(others).alias(f"share_{other}")).select("bucket", "share_x", "share_y", *[F.col(c).alias(f"{c}_{own}") for c in held[1:]])
        for own, other, others in (("x", "y", F.sequence(share, last)), ("y", "x", F.sequence(F.lit(0), share)))
    )
    rows = left.join(right, ["bucket", "share_x", "share_y"]).where("block_x <= block_y and (lo_x <> hi_x or lo_y <> hi_y or lo_x <> lo_y)").select("bucket", "m_x", "m_y")
    least = similarity - SLACK * (similarity * (1 - similarity) / SKETCH_PLACES) ** 0.5

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(members: list[dict]) -> tuple[np.ndarray, ...]:
            columns = [np.array([m[c] for m in members], np.int64) for c in ("id", "component", "buckets")]
            return (*columns, np.stack([np.frombuffer(m["sketch"], np.uint8) for m in members]))

        for batch in batches:
            found: list[np.ndarray] = []
            for k in range(batch.num_rows):
                bucket, mx, my = (c[k].as_py() for c in batch.columns)
                (ix, cx, bx, sx), (iy, cy, by, sy) = arrays(mx), arrays(my)
                for i in range(len(ix)):
                    close = (cy != cx[i]) & ((sy == sx[i]).mean(1) >= least)
                    for j in np.flatnonzero(close):
                        shared = bx[i][bx[i] == by[j]]
                        if len(shared) and shared[0] == bucket:
                            found.append(np.array([min(ix[i], iy[j]), max(ix[i], iy[j])]))
            pairs = np.stack(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long").distinct(), (at, blocks)


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, buckets, sketch) of each id: its bands and one byte of each of SKETCH_PLACES places."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for b in batches:
                ids, whole = b.column(0).to_pylist(), b.column(1).to_pylist()
                doc, s, w = weighted_shingles(whole, hashes)
                bands = band_values(probminhash(doc, s, w, len(whole)))
                bytes_ = (mix(probminhash(doc, s, w, len(whole), SKETCH_PLACES)) >> np.uint64(56)).astype(np.uint8)
                has = sorted(set(doc.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in has], pa.int64()), pa.array([bands[i].tolist() for i in has], pa.list_(pa.int64())), pa.array([bytes_[i].tobytes() for i in has], pa.binary())],
                    names=["id", "buckets", "sketch"],
                )

    return texts.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(sketch, "id long, buckets array<long>, sketch binary").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``: class_id is the least id of the row's class.

    Documents are linked if their texts are equal or the probability Jaccard of their shingles of five
    words, weighted by how often each occurs, is at least ``similarity``; classes are the connected
    components. Equal texts are one node, so copies never meet as pairs. First every member of a band's
    bucket is verified against the bucket's hub, the member that shares most buckets with others. Buckets
    whose members still fall in different components are then compared whole, in blocks, by sketches, and
    close pairs are verified. No bucket is capped.

    Null texts are linked to nothing; a null id takes the class of its text, or null. An id with several texts
    is as many documents, which may fall in different classes. Empty tables give no rows; further columns are ignored.
    """
    return _classes(docs, similarity).select("doc_id", "class_id")


def _nodes(signed: DataFrame) -> DataFrame:
    """(key, doc_id, node, n): the least id of each text, the text's own number (the id itself for the id's first text) and its rows."""
    least = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("doc_id is not null")
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")))
    for salt in itertools.count():
        nodes = persist_shared(ranked.select("key", "doc_id", F.when(F.col("rank") == 1, F.col("doc_id")).otherwise(F.xxhash64("key", F.lit(salt))).alias("node"), "n"), "nodes")
        if nodes.where("node <> doc_id").isEmpty() or nodes.groupBy("node").count().where("count > 1").isEmpty():
            return nodes
        forget(nodes)


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, key, component, class_id) of every row: its text's key ('' for a null text) and component (null for null texts)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    signed = persist_shared(signatures(docs), "signatures")
    nodes = _nodes(signed)
    node = signed.where("bands is not null and doc_id is not null").join(nodes.drop("n"), ["key", "doc_id"]).select(F.col("node").alias("id"), F.explode("bands").alias("bucket")).distinct()
    crowded = persist_shared(node.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    member = persist_shared(dealt_join(node, crowded, "bucket", "id", BANDS * nodes.count()), "buckets")
    n_members = member.count()
    scored = member.join(member.groupBy("id").agg(F.sum("n").alias("score")), "id")
    hub = scored.groupBy("bucket").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("hub"), F.max("n").alias("n"))
    pairs = persist_shared(dealt_join(member.drop("n"), hub, "bucket", "id", n_members).where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "hub-pairs")
    links = verified(pairs, docs, nodes, similarity)
    labels = connected_components(links)
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near, used = _blocked_candidates(member, docs, nodes, labels, similarity)
    close = persist_shared(near.join(tested, ["a", "b"], "left_anti"), "close-pairs")
    forget(member, crowded, pairs, *used)
    if not close.isEmpty():
        more = verified(close, docs, nodes, similarity)
        if not more.isEmpty():
            # links between the components found so far
            named = more
            for c in ("a", "b"):
                named = named.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(c, F.coalesce(f"c{c}", c)).drop(f"c{c}")
            joined = connected_components(named).select(F.col("id").alias("component"), F.col("component").alias("whole"))
            known = labels.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
            # a document without a link to its hub was its own component
            new = joined.join(labels.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("whole").alias("component"))
            labels = persist_shared(known.unionByName(new), "components")
    names = nodes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("key", "doc_id", "n", F.coalesce("component", "node").alias("component"))
    names = persist_shared(names, "text-components")
    least = names.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("texts"))
    named = dealt_join(names.select("key", "n", "component"), least, "component", "key", nodes.count(), n="texts").drop("texts")
    classed = dealt_join(signed.select("doc_id", "key"), named, "key", "doc_id", signed.count(), "left").select("doc_id", "key", "component", "class_id")
    rest = docs.where("text is null").select(F.col("doc_id").cast("long").alias("doc_id"))
    return classed.unionByName(rest.select("doc_id", F.lit("").alias("key"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id")))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one of the least id, and of its texts the one of the least key.

    Rows of a null id stay, and so do rows of null text. Of rows that repeat both id and text one stays, the least by its columns.
    """
    classes = persist_shared(_classes(docs, similarity), "classes")
    chosen = classes.where("doc_id is not null and component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("c"), F.count("*").alias("n"))
    losers = dealt_join(classes.where("doc_id is not null"), chosen, "component", ["doc_id", "key"], classes.count()).where("doc_id <> c.doc_id or key <> c.key").select("doc_id", F.col("key").alias("_key")).distinct()
    keyed = docs.withColumn("_key", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    both = ["doc_id", "_key"]
    kept = by_id(keyed, losers, "left_anti", both)
    repeated = classes.where("doc_id is not null").groupBy("doc_id", F.col("key").alias("_key")).count().where("count > 1").select(both)
    if repeated.isEmpty():
        return kept.select(docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = by_id(kept, repeated, "left_semi", both).groupBy(both).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return by_id(kept, repeated, "left_anti", both).select(docs.columns).unionByName(one)
