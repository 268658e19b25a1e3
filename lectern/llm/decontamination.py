"""Benchmark decontamination by spaced seeds, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a mask; the ones between them are ignored. Together they hit every window of 13 tokens
#: with up to two substitutions and every window of 9 to 12 tokens with one.
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 4, 7, 8))
#: Tokens of an overlap that counts, or the whole of a shorter item.
WINDOW = 13
#: Items of fewer tokens than the widest mask spans must occur unchanged.
SPAN = 1 + max(m[-1] for m in MASKS)
#: Seeds of test items that are sent to all tasks at once (about 40 bytes each); more items go in blocks.
BLOCK_SEEDS = 2_000_000
#: Contaminated ids that are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty string may stand first and last."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def masked_hash(hashes: Column, at: Column, mask: tuple[int, ...], mask_no: int) -> Column:
    """Hash of the tokens that a mask keeps when laid at position ``at`` (from 0); null beyond the end."""
    whole = at + mask[-1] < F.size(hashes)
    return F.when(whole, F.xxhash64(F.lit(mask_no), *[F.get(hashes, at + k) for k in mask]))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, own, length): own holds the hashes of an item's tokens; items without tokens are left out."""
    real = F.filter(tokens(F.col("text")), lambda t: t != "")
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.transform(real, lambda t: F.xxhash64(t)).alias("own"))
    return rows.select("item_id", "own", F.size("own").alias("length")).where("length > 0").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, text_key, item_id) of every document that holds a window of a test item.

    A window is 13 tokens of the item (the whole item if shorter) that stand in the document in the same
    order and distance with at most two tokens substituted (one below 13 tokens, none below 9). Masks laid
    on every position of both sides find candidates by equal hashes; each is verified on its diagonal, with the tokens
    around it alone, so that the work on a very long text grows with its length. Items of equal tokens are searched once.
    Items are counted first and go to the tasks in blocks of ``block_seeds`` seeds: documents are never
    shuffled for the search. Null and empty texts and items without tokens overlap nothing; repeated rows and rows of
    one id are searched by their texts; further columns are ignored; an empty table on either side finds nothing.
    """
    named = _items(benchmark)
    items = named.groupBy("own", "length").agg(F.min("item_id").alias("item_id"))
    n_tokens, n_short = items.agg(F.coalesce(F.sum("length"), F.lit(0)), F.array_sort(F.collect_set(F.when(F.col("length") < SPAN, F.col("length"))))).first()
    masks = [*MASKS, *(tuple(range(k)) for k in n_short)]
    blocks = max(1, math.ceil(n_tokens * len(masks) / block_seeds))
    text = F.col("text").cast("string")
    hashed = docs.where("text is not null").select("doc_id", F.xxhash64(text).alias("text_key"), token_hashes(text).alias("hashes"))
    at = hashed.select("doc_id", "text_key", "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)).alias("q"))
    seeds = at.select("doc_id", "text_key", "hashes", "q", F.explode(F.array(*[masked_hash(F.col("hashes"), F.col("q"), m, k) for k, m in enumerate(masks)])).alias("seed"))
    before, after = WINDOW - 1, SPAN + WINDOW - 2  # tokens around a hit that its windows can cover
    left = F.greatest(F.lit(0), F.col("q") - before)
    found = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("own"), F.lit(blocks)) == k)
        where = part.select("item_id", "own", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("p"))
        long = F.col("length") >= SPAN
        own = [F.when(long if n < len(MASKS) else F.col("length") == len(m), masked_hash(F.col("own"), F.col("p"), m, n)) for n, m in enumerate(masks)]
        known = where.select("item_id", "p", F.explode(F.array(*own)).alias("seed")).where("seed is not null")
        hits = seeds.join(F.broadcast(known), "seed").select("doc_id", "text_key", "item_id", "p", "q", left.alias("left"), F.slice("hashes", left + 1, before + after + 1).alias("near"))
        ok = hits.join(F.broadcast(part), "item_id").where(_verified()).select("doc_id", "text_key", "item_id")
        found = ok if found is None else found.unionByName(ok)
    same = named.select("own", F.col("item_id").alias("named")).join(items.select("own", "item_id"), "own").select("item_id", "named")
    few = named.count() <= BROADCAST_IDS
    out = found.distinct().join(F.broadcast(same) if few else same, "item_id")
    return out.select("doc_id", "text_key", F.col("named").alias("item_id")).distinct()


def _verified() -> Column:
    """Whether a window of the item that covers the hit fits the document at the hit's diagonal; ``near`` starts at ``left``."""
    length, shift = F.col("length"), F.col("q") - F.col("p")
    window = F.least(length, F.lit(WINDOW))
    need = window - F.when(window >= WINDOW, 2).when(window >= SPAN, 1).otherwise(0)
    first, last = F.greatest(F.lit(0), F.col("p") - WINDOW + 1), F.least(length - 1, F.col("p") + SPAN + WINDOW - 2)
    place = lambda j: shift + j - F.col("left")
    equal = F.transform(
        F.sequence(first, last),
        lambda j: F.when((place(j) >= 0) & F.coalesce(F.get("near", F.when(place(j) >= 0, place(j))) == F.get("own", j), F.lit(False)), 1).otherwise(0),
    )
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), last - first + 2 - window))
    return F.exists(starts, lambda s: F.aggregate(F.slice(equal, s, window), F.lit(0), lambda a, x: a + x) >= need)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every row of ``docs``: doc_id, contaminated, n_items, items (ids of the items found, ascending).

    Rows of equal id are judged by their own texts, very long ones whole; null and empty texts are clean; repeated rows stay.
    An empty benchmark finds nothing, and an empty table gives no rows.
    """
    by_doc = overlaps(docs, benchmark).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item_id")).alias("ids"))
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key")).alias("d")
    out = rows.join(by_doc.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.text_key = f.text_key"), "left")
    return out.select(F.col("d.doc_id"), F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"))


def drop_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``found`` (see ``overlaps``) names; ``found`` should be written already."""
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    few = bad.count() <= BROADCAST_IDS
    match = docs["doc_id"].eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("bad_key"))
    return docs.join(F.broadcast(bad) if few else bad, match, "left_anti")


#: The same result by plain SQL: an overlap of 13 tokens with two substitutions keeps a run of four.
ORACLE_SQL = r"""
WITH it AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS own
            FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
items AS (SELECT DISTINCT item_id, own, len(own) AS n FROM it WHERE len(own) > 0),
item_pos AS (SELECT item_id, n, unnest(range(1, n + 1)) AS p, unnest(own) AS t FROM items),
docs AS (SELECT DISTINCT doc_id, text, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
doc_pos AS (SELECT doc_id, text, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS t FROM docs),
doc_run AS (SELECT doc_id, text, q, t, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(t, 3) OVER d AS t3
            FROM doc_pos WINDOW d AS (PARTITION BY doc_id, text ORDER BY q)),
item_run AS (SELECT item_id, n, p, t, lead(t, 1) OVER i AS t1, lead(t, 2) OVER i AS t2, lead(t, 3) OVER i AS t3
             FROM item_pos WINDOW i AS (PARTITION BY item_id ORDER BY p)),
hits AS (SELECT DISTINCT d.doc_id, d.text, i.item_id, i.n, d.q - i.p AS shift FROM doc_run d JOIN item_run i
         ON d.t = i.t AND (i.n < 4 OR (d.t1 = i.t1 AND d.t2 = i.t2 AND d.t3 = i.t3))),
eq AS (SELECT h.doc_id, h.text, h.item_id, h.n, h.shift, i.p, CAST(COALESCE(d.t = i.t, FALSE) AS INT) AS e
       FROM hits h JOIN item_pos i ON h.item_id = i.item_id LEFT JOIN doc_pos d ON d.doc_id = h.doc_id AND d.text = h.text AND d.q = i.p + h.shift),
win AS (SELECT a.doc_id, a.text, a.item_id, a.n, a.shift, a.p, sum(b.e) AS same FROM eq a JOIN eq b
        ON a.doc_id = b.doc_id AND a.text = b.text AND a.item_id = b.item_id AND a.shift = b.shift AND b.p >= a.p AND b.p < a.p + least(a.n, 13)
        WHERE a.p + least(a.n, 13) - 1 <= a.n GROUP BY ALL),
found AS (SELECT doc_id, text, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, text, item_id FROM win
                WHERE same >= least(n, 13) - CASE WHEN n >= 13 THEN 2 WHEN n >= 9 THEN 1 ELSE 0 END) GROUP BY doc_id, text)
SELECT d.doc_id, f.n IS NOT NULL AS contaminated, COALESCE(f.n, 0) AS n_items, COALESCE(f.items, '') AS items
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id AND d.text = f.text
"""
