"""Which texts hold which names: automata over names, and postings of short substrings for the mirrored question."""

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.operators.relational import lookup

#: Bytes of names in one automaton (about fifty times that in memory); more names go in blocks, each of which reads the texts again.
AUTOMATON_BYTES = 4_000_000
#: Length of the substrings by which names are posted.
GRAM = 4


def automaton(names: Sequence[str]):  # noqa: ANN201
    """Aho-Corasick automaton of distinct names; its hits carry a name's place in ``names``."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, name in enumerate(names):
        if name:
            a.add_word(name, i)
    a.make_automaton()
    return a


def _held(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``rows`` but the last, which is the text, with one of a block of names that the text holds."""
    schema = StructType([*rows.schema.fields[:-1], StructField("name", StringType())])
    if not names:
        return rows.sparkSession.createDataFrame([], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(names)
        for b in batches:
            rows, found = [], []
            for k, text in enumerate(b.columns[-1].to_pylist()):
                hits = {i for _, i in a.iter(text)}
                rows += [k] * len(hits)
                found += [names[i] for i in hits]
            kept = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=[*b.schema.names[:-1], "name"])

    return rows.mapInArrow(work, schema)


def names_held(rows: DataFrame, text: str, names: DataFrame, keep: list[str], block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The columns ``keep`` of ``rows`` with each distinct name of ``names.name`` that the row's text holds, as ``name``.

    The names' bytes are measured; an automaton of at most about ``block_bytes`` of them goes to all tasks and runs over the
    texts in Arrow batches, in time linear in the texts and what they hold; nothing is shuffled but the names. More names go in blocks
    by hash. Null texts hold nothing, empty names are held by nothing; repeated names count once, repeated rows each.
    """
    n = names.select(F.col("name").cast("string").alias("name")).where("name <> ''").distinct()
    t = rows.select(*keep, F.col(text).cast("string").alias("_text")).where("_text is not null")
    blocks = 1 + int(n.agg(F.sum(F.octet_length("name"))).first()[0] or 0) // block_bytes
    out = None
    for k in range(blocks):
        some = [r.name for r in n.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()]  # a measured block
        one = _held(t, some)
        out = one if out is None else out.unionByName(one)
    return out


def first_held(rows: DataFrame, text: str, names: Sequence[str], to: str) -> DataFrame:
    """``rows`` with the least number (from 0) of the ``names`` that the text holds, as ``to``; null if none.

    ``names`` is a list of bounded size, such as a small dimension in its order of priority; the rows stay where they are.
    """
    first: dict[str, int] = {}
    for i, n in enumerate(names):
        if n:
            first.setdefault(n, i)
    if not first:
        return rows.withColumn(to, F.lit(None).cast("int"))

    @F.pandas_udf("int")
    def least(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, at = automaton(list(first)), list(first.values())
        for p in parts:
            yield pd.Series([min((at[i] for _, i in a.iter(t)), default=None) if t else None for t in p], dtype="Int32")

    return rows.withColumn(to, least(F.col(text)))


def _grams(c: Column, lengths: Sequence[int]) -> Column:
    """Distinct substrings of the given lengths."""

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(c) - (n - 1))), lambda i: F.substring(c, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of(n) for n in lengths]))


def names_that_hold(names: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(text, name): each distinct text with the distinct names that hold it. Both sides are short and may be many.

    A name is posted under all its substrings of ``gram`` characters (and shorter ones, as long as some text is); a text is looked up under
    the one of its substrings that the fewest names have, or, if it is shorter than ``gram``, under itself. So every name that holds the
    text is met, by an equal join; what meets is verified. Nulls and empty texts are held by nothing.
    """
    n = names.select(F.col("name").cast("string").alias("name")).where("name <> ''").distinct()
    t = texts.select(F.col("text").cast("string").alias("text")).where("text <> ''").distinct()
    postings = n.select("name", F.explode(_grams(F.col("name"), range(1, gram + 1))).alias("gram"))
    sizes = postings.groupBy("gram").agg(F.count("*").alias("n"))
    own = t.select("text", F.explode(F.when(F.char_length("text") < gram, F.array("text")).otherwise(_grams(F.col("text"), [gram]))).alias("gram"))
    rarest = own.join(sizes, "gram", "left").groupBy("text").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    wanted = lookup(postings, rarest.select("gram").distinct(), "gram", "left_semi")
    return rarest.join(wanted, "gram").where(F.contains("name", F.col("text"))).select("text", "name")
