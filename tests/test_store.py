"""Stored tables against a plain dictionary, with writers that are lost between steps, replayed batches and writers that meet."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.sources.store import Conflict, StoredTable

SCHEMA = "program long, code string, name string, extra array<int>"
KEYS = ["program", "code"]


def rows(spark, values):
    return spark.createDataFrame([(*v, None) for v in values], SCHEMA)


def content(table, version=None):
    return {(r.program, r.code): r.name for r in table.read(version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, KEYS, buckets=4)


def test_same_as_a_dictionary(spark, table):
    r, want = random.Random(2), {}
    for _ in range(12):
        new = [(r.choice([1, 2, None]), r.choice([None, *"abcdef"]), str(r.random())) for _ in range(5)]
        new = list({v[:2]: v for v in new}.values())
        what = r.choice(["upsert", "delete", "new", "replace", "compact"])
        if what == "upsert":
            table.upsert(rows(spark, new))
            want |= {v[:2]: v[2] for v in new}
        elif what == "delete":
            table.delete(rows(spark, new))
            want = {k: v for k, v in want.items() if k not in {x[:2] for x in new}}
        elif what == "new":
            table.insert_new(rows(spark, new))
            want = {v[:2]: v[2] for v in new} | want
        elif what == "replace":
            new = [v for v in new if v[0] == 2]
            table.replace(F.col("program") == 2, rows(spark, new))
            want = {k: v for k, v in want.items() if k[0] != 2} | {v[:2]: v[2] for v in new}
        else:
            table.compact()
        assert content(table) == want, what
    table.compact()
    table.clean(1)
    assert content(table) == want and len(table.versions()) == 1


def test_last_of_a_batch(spark, table):
    seq = spark.createDataFrame([(1, "a", "x", None, 1), (1, "a", None, None, 3), (1, "a", "z", None, 2)], SCHEMA + ", seq int")
    table.upsert(seq, "seq")
    assert content(table) == {(1, "a"): None} and table.manifest(0)["buckets"] == {}
    assert content(StoredTable(spark, table.path + "-none", SCHEMA, KEYS)) == {}


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_lost_writer_changes_nothing(spark, table, monkeypatch, step):
    table.upsert(rows(spark, [(1, "a", "old"), (2, "b", "old")]))
    with monkeypatch.context() as m:
        keep = getattr(StoredTable, step)

        def lost(self, *a):
            if step == "_write":
                keep(self, *a)  # written, never committed
            raise KeyboardInterrupt

        m.setattr(StoredTable, step, lost)
        for change in (lambda: table.upsert(rows(spark, [(1, "a", "new")])), lambda: table.replace(F.col("program") == 1, rows(spark, []))):
            with pytest.raises(KeyboardInterrupt):
                change()
    assert content(table) == {(1, "a"): "old", (2, "b"): "old"}
    table.upsert(rows(spark, [(1, "a", "new")]))
    assert content(table) == {(1, "a"): "new", (2, "b"): "old"} and content(table, 1)[1, "a"] == "old"
    assert len(table.clean()) == 2 and content(table) == {(1, "a"): "new", (2, "b"): "old"}


def test_a_lost_compaction_is_done_again(spark, table, monkeypatch):
    for n in "xyz":
        table.upsert(rows(spark, [(1, "a", n)]))
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.compact()
    assert content(table) == {(1, "a"): "z"} and table.compact() and content(table) == {(1, "a"): "z"} and not table.compact()


def test_writers_that_meet(spark, table, monkeypatch):
    """Another writer's version comes between the reading and the commit: an insert of the same key gives way."""
    keep, done = StoredTable._write, []

    def write(self, df):
        out = keep(self, df)
        if not done:
            done.append(1)
            table.upsert(rows(spark, [(1, "a", "first")]))
        return out

    monkeypatch.setattr(StoredTable, "_write", write)
    assert table.insert_new(rows(spark, [(1, "a", "second"), (1, "b", "second")]))
    assert content(table) == {(1, "a"): "first", (1, "b"): "second"}
    with pytest.raises(Conflict):
        table._commit(1, {}, {}, {})


def test_batches_count_once(spark, table):
    for _ in range(2):
        table.upsert(rows(spark, [(1, "a", "one")]), writer="w", batch=0)
        table.delete(rows(spark, [(1, "a", "")]), writer="w", batch=1)
        table.upsert(rows(spark, [(2, "a", "two")]), writer="v", batch=0)
    assert content(table) == {(2, "a"): "two"} and table.versions() == [1, 2, 3]


def test_a_killed_stream_goes_on(spark, table, tmp_path, monkeypatch):
    for k in range(3):
        rows(spark, [(k, "a", str(k)), (9, "z", str(k))]).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    with monkeypatch.context() as m:
        keep = StoredTable.insert_new

        def lost(self, df, **a):  # the second batch is committed, but the stream dies before it notes that
            keep(self, df, **a)
            if a["batch"] == 1:
                raise RuntimeError("lost")

        m.setattr(StoredTable, "insert_new", lost)
        with pytest.raises(Exception, match="lost"):
            table.ingest(stream, f"{tmp_path}/cp", "s").awaitTermination(100)
    assert table.versions() == [1, 2]
    assert table.ingest(stream, f"{tmp_path}/cp", "s").awaitTermination(100)
    assert table.versions() == [1, 2, 3] and sorted(content(table)) == [(0, "a"), (1, "a"), (2, "a"), (9, "z")] and table.manifest()["writers"] == {"s": 2}
