"""Archives: exact round trips, a plain reading of the files, and lookups against a plain index."""

import glob
import gzip
import hashlib
import uuid

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from lectern.llm import queries
from lectern.llm import web_archive as wa
from lectern.storage import shared_dir

PAGES = "page_id long, url string, html string, digest string, first long, file string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "f") for r in rows], PAGES).repartition(4)


def stored(spark, rows, lines=3, **args):
    at = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    captures = wa.write(pages_of(spark, rows), at, **args)
    return at, captures, wa.write_index(captures, f"{at}/index", lines)


def through(spark, rows, lines=3, **args):
    at, _, shards = stored(spark, rows, lines, **args)
    keys = pages_of(spark, rows).select(wa.url_key(F.col("url")).alias("url_key"))
    return wa.read_records(wa.find(keys, shards, f"{at}/index"), at)


def plain(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        equal = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(equal) if equal and len(data) >= 100 else None
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "https://www.example.org/a?b#c", "é" * 50),
    (2, "https://www.example.org/a?b", "é" * 50),
    (3, None, "short"),
    (4, "not an address", "short"),
    (5, "http://u:p@Example.org:8080", None),
    (6, "http://x.org/" + "y" * 3000, ""),
    (7, "http://x.org/\r\nWARC/1.1\r\n \t", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 9),
    (8, "http://x.org/", "long <p>" * 200_000),
    (9, "http://x.org/", "é" * 50),
    (9, "http://x.org/", "é" * 50),
    (1, "http://x.org/", "é" * 50),
    (None, "http://x.org/", "é" * 50),
    (None, "http://x.org/none", "z" * 100),
    (11, "http://x.org/9", "q" * 99),
    (12, "http://x.org/9", "q" * 99),
]


@pytest.mark.parametrize(("lines", "size"), [(1, 10**9), (2, 200), (1000, 10**9)])
def test_round_trip(spark, lines, size):
    records = through(spark, ROWS, lines, file_bytes=size)
    assert sorted((tuple(r) for r in wa.resolved(records).collect()), key=repr) == plain(ROWS)
    back = {(r.page_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect()}
    kept = {(p[0], p[2]) for p in plain(ROWS) if p[3] == "response"}
    assert back == {(i, (h or "").encode()) for i, _, h in ROWS if (i, hashlib.sha256((h or "").encode()).hexdigest()) in kept}


def test_one_address_and_one_payload_hold_most_rows(spark, monkeypatch):
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/", "same payload " * 20 if i % 2 else f"page {i}") for i in range(400)]
    got = sorted((tuple(r) for r in wa.resolved(through(spark, rows, 5)).collect()), key=repr)
    assert got == plain(rows)
    monkeypatch.setattr(wa, "small", lambda df: False)  # the join of a large table of repeated payloads
    assert sorted((tuple(r) for r in wa.resolved(through(spark, rows, 5)).collect()), key=repr) == plain(rows)


def test_files_are_plain_archives(spark):
    """Any reader that goes through the gzip members in order finds every record."""
    at, captures, _ = stored(spark, ROWS)
    ids = []
    for f in glob.glob(at.removeprefix("file://") + "/*.warc.gz"):
        data = gzip.open(f).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            ids += [fields.get("Page-Id")] if fields["WARC-Type"] != "warcinfo" else []
            data = rest[n + 4 :]
    assert sorted(map(str, ids)) == sorted(str(i) for i, *_ in ROWS) and captures.count() == len(ROWS)


def test_lookups_read_few_blocks(spark):
    rows = [(i, f"http://h{i % 50}.org/p{i}", f"page {i}") for i in range(500)]
    at, _, shards = stored(spark, rows, 10)
    keys = spark.createDataFrame([("org,h7)/p57",), ("org,h7)/p57",), ("org,h7)/p5",), ("a",), ("zzz",), (None,)], "url_key string")
    assert [r.page_id for r in wa.find(keys, shards, f"{at}/index").collect()] == [57]
    assert wa.find_blocks(keys, shards, f"{at}/index").count() <= 6


def test_keys(spark):
    want = {
        "https://Www.Example.org/a?b#c": "org,example,www)/a?b",
        "http://u:p@Example.org:8080": "org,example:8080)/",
        "https://x.org:443?q= 1\n": "org,x)?q=%201%20",
        "not an address": "not%20an%20address",
        None: "-",
    }
    rows = spark.createDataFrame([(u,) for u in want], "url string").select("url", wa.url_key(F.col("url"))).collect()
    assert {u: k for u, k in rows} == want
    long = spark.createDataFrame([("http://x.org/" + "y" * 3000 + c,) for c in "ab"], "url string").select(wa.url_key(F.col("url"))).collect()
    assert len({k for (k,) in long}) == 2 and all(len(k) < 1000 for (k,) in long)


def test_damage_ends_the_job(spark):
    at, captures, _ = stored(spark, [(1, "http://a.org", "x" * 200), (2, "http://b.org", "y" * 200)])
    with pytest.raises(Exception, match="header|record|error|decompress"):
        wa.read_records(captures.withColumn("begin", F.col("begin") + 1), at).collect()
    data = wa.page_record(1, None, b"abc", "0" * 64, None)
    with pytest.raises(ValueError, match="whole"):
        wa.parsed(data[:-5])


def test_empty(spark):
    assert wa.resolved(through(spark, [])).count() == 0


def test_same_as_sql(spark, sf_dir, duck):
    assert_same(queries.op13_web_archive(spark, sf_dir), duck.sql(queries.ORACLE_SQL["op13_web_archive"]))
