"""Ranked lexical search: Fagin's threshold algorithm over shards of the documents.

The texts are read once, into a forward index of the terms that the items hold. Each task then cuts its part of that index into
shards, sorts a shard's postings by impact, and answers every item on them; the best of all tasks meet at the end. An item's
best documents of all are among the best of each task, so that no shard's result depends on the others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import arrow_batches, forget, persist_shared

#: Documents given for each item.
TOP = 50
#: Postings of one shard (about 60 bytes each while it is sorted); a shard holds at least one Arrow batch.
SHARD_POSTINGS = 1_000_000
#: Bytes of item texts that one reading of the documents answers; more items go in blocks.
BLOCK_BYTES = 8_000_000
#: Rows of each list read in the first turn of the round robin; later turns double it up to the second number.
TURN, LONGEST_TURN = 16, 4096
#: The last of the ranking is shared by so many tasks an item, so that many tasks' best don't meet in one.
PARTS = 32

#: What each byte of a text is to the index: letters, digits and all bytes of characters beyond ASCII stay, A-Z become small, others part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long"


def split_terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    """A term's weight by the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def forward_index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with at least one term: its length, and the numbered terms that it holds."""
    arrow_batches(docs.sparkSession)
    texts = docs.where("text is not null").select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, lengths, ends, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = split_terms(text)
                if words:
                    held = Counter(map(number.get, words))
                    held.pop(None, None)
                    keep.append(i)
                    lengths.append(len(words))
                    terms.extend(held)
                    tfs.extend(held.values())
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return texts.mapInArrow(work, FORWARD)


class Shard:
    """Some documents' postings twice: as lists sorted by impact, and by document."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """``doc`` numbers documents in ``ids`` and is sorted; ``null`` marks documents without an id, which come last among equals."""
        self.ids, self.null, self.term, self.impact = ids, null, term, impact
        self.starts = np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.lexsort((-impact, term))
        self.listed, self.falling = doc[order], impact[order]
        self.list_terms, at = np.unique(term[order], return_index=True)
        self.list_ends = np.append(at, len(order))

    def scores(self, docs: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Random access: full scores of documents, each of which holds a posting."""
        first, size = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
        begin = np.cumsum(size) - size
        at = np.repeat(first - begin, size) + np.arange(size.sum())
        return np.add.reduceat(np.where(member[self.term[at]], self.impact[at], 0), begin)

    def search(self, terms: np.ndarray, member: np.ndarray, best: np.ndarray, top: int) -> tuple[np.ndarray, int]:
        """The best of ``best`` and of this shard's documents for the terms that ``member`` marks, and how many list rows were read.

        ``best`` has rows (-score, without id, id) in order. The lists are read in turn, from their largest impacts on;
        each new document is looked up in the forward index. No document not yet seen can score more than the sum of the
        next impacts of all lists: once that is strictly below the last score of a full ``best``, or zero, the rest is left.
        """
        at = np.searchsorted(self.list_terms, terms)
        at = at[(at < len(self.list_terms)) & (self.list_terms[np.minimum(at, len(self.list_terms) - 1)] == terms)] if len(self.list_terms) else at[:0]
        begin, end = self.list_ends[at], self.list_ends[at + 1]
        seen = np.zeros(len(self.ids), bool)
        depth, turn, read = 0, TURN, 0
        while len(begin):
            threshold = int(self.falling[begin + depth].sum())
            if not threshold or (len(best) == top and threshold < -best[-1, 0]):
                break
            took = np.minimum(end - begin - depth, turn)
            offset = np.cumsum(took) - took
            docs = self.listed[np.repeat(begin + depth - offset, took) + np.arange(took.sum())]
            read += len(docs)
            docs = np.unique(docs[~seen[docs]])
            if len(docs):
                seen[docs] = True
                found = self.scores(docs, member)
                good = found > (0 if len(best) < top else -best[-1, 0] - 1)
                docs, found = docs[good], found[good]
                best = np.concatenate([best, np.stack([-found, self.null[docs], self.ids[docs]], 1)])
                best = best[np.lexsort((best[:, 2], best[:, 1], best[:, 0]))][:top]
            depth += turn
            turn = min(2 * turn, LONGEST_TURN)
            left = end - begin > depth
            begin, end = begin[left], end[left]
        return best, read


def best_of_tasks(forward: DataFrame, items: Sequence[Sequence[int]], weights: Sequence[int], n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): each task's best documents for each item, by its number; at most ``top`` a task and item."""
    arrow_batches(forward.sparkSession)
    wanted, w, length = [np.array(sorted(set(t)), np.int64) for t in items], np.array(weights, np.int64), max(n_terms, 1)

    def shard_of(parts: list[tuple]) -> Shard:
        ids, null, n, sizes, term, tf = (np.concatenate(x) for x in zip(*parts))
        doc = np.repeat(np.arange(len(ids)), sizes)
        m = 100 - 50 + 50 * n * n_docs // length
        return Shard(ids, null, doc, term, w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((0, 3), np.int64) for _ in wanted]
        parts: list[tuple] = []

        def flush() -> None:
            shard = shard_of(parts)
            parts.clear()
            member = np.zeros(len(w), bool)
            for i, terms in enumerate(wanted):
                member[terms] = True
                best[i], _ = shard.search(terms, member, best[i], top)
                member[terms] = False

        postings = 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, terms, tfs = b.column(0), b.column(2), b.column(3)
            flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            parts.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(), sizes, flat, tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            postings += len(flat)
            if postings >= SHARD_POSTINGS:
                flush()
                postings = 0
        if parts:
            flush()
        for i, rows in enumerate(best):
            if len(rows):
                ids = pa.array(rows[:, 2], pa.int64(), mask=rows[:, 1] == 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), ids, pa.array(-rows[:, 0])], names=["item", "doc_id", "score"])

    return forward.mapInArrow(work, FOUND)


def _first(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, those of score above 0 only.

    Scores are whole numbers, so that results are equal whatever the tasks. Null and empty texts of either side hold no term;
    very long ones are read whole. An item is a row of ``items``; rows that repeat id and text count once, and an id with
    several texts has a ranking for each, one after the other. Rows of ``docs`` that repeat an id are ranked each; documents
    without an id come last among equal scores. Without items, or documents with terms, there are no rows. Other columns are
    ignored. Items go to all tasks, in blocks of about ``block_bytes`` of their texts; each block reads the documents again.
    """
    spark = docs.sparkSession
    texts = items.where("text is not null").select("item_id", F.col("text").cast("string").cast("binary").alias("text")).distinct()
    blocks = 1 + int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    results = []
    for k in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        number: dict[bytes, int] = {}
        terms = [sorted({number.setdefault(t, len(number)) for t in split_terms(bytes(r.text))}) for r in rows]
        forward = persist_shared(forward_index(docs, number), "forward-index")
        n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
        df = {r.term: r.n for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        weights = [weight(n_docs, df.get(t, 0)) for t in range(len(number))]
        found = best_of_tasks(forward, terms, weights, n_docs, n_terms or 0, top)
        found = _first(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ["item", "part"], top).drop("part", "rank")
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], items.select(F.lit(0).alias("item"), "item_id").schema)
        results.append(persist_shared(_first(found, ["item"], top).join(F.broadcast(names), "item").select("item_id", "item", "rank", "doc_id", "score"), "ranked"))
        forget(forward)
    ranked = results[0]
    for r in results[1:]:
        ranked = ranked.unionByName(r)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("item", "rank"))).select("item_id", "rank", "doc_id", "score")


#: The same ranking by plain SQL: every document that shares a term with an item is scored.
ORACLE_SQL = r"""
WITH dt AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS MATERIALIZED (SELECT row_id, doc_id, terms, len(terms)::BIGINT AS n FROM dt WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT row_id, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
s AS (SELECT item_id, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score FROM tf JOIN w USING (term) JOIN q USING (term), total GROUP BY item_id, row_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
