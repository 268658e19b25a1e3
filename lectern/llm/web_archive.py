"""WARC archives with a two-level capture index.

Tasks write records to archive files in the shared folder, one gzip member a record, and return where each lies; a file counts
only through the rows of the attempt that Spark committed, so that a lost task leaves nothing but a file which no row names. The
captures, sorted by reversed-host keys, form index files: compressed blocks of lines, and behind them a directory with the first
key of each block. A search looks keys up in the list of index files (a row each), finds blocks in a file's directory, and only
then reads blocks and records by their ranges. Keys, blocks and records are dealt out over tasks, a key of many captures by its
blocks.

Files are read and written by ``pyarrow.fs``, from ``file``, ``hdfs``, ``s3`` and ``gs`` addresses.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import persist_shared
from lectern.operators.relational import small
from lectern.operators.skew import dealt_join

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: An archive file is closed beyond this size.
FILE_BYTES = 1_000_000_000
#: Lines of an index block, and bytes of longer ones.
BLOCK_LINES, BLOCK_BYTES = 3000, 1_000_000
#: Records that lie next to each other are read at once, up to so many bytes.
READ_BYTES = 8_000_000
#: Records of one file that one task reads are within stretches of this length.
STRETCH = 1_000_000
#: Bytes of records, or of index blocks, that a task reads, about.
TASK_BYTES = 16_000_000
#: Bytes of payload in one Arrow batch, about.
OUT_BYTES = 16_000_000
#: Longer keys end with a hash of the whole.
KEY_CHARS = 900
LEVEL = 3
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "1970-01-01T00:00:00Z"

CAPTURE = "url_key string, page_id long, record_type string, digest string, file string, begin long, size long"
RECORD = "page_id long, url string, record_id string, record_type string, refers_to string, digest string, payload binary"
SHARD = "file string, first_key binary, last_key binary, directory long, size long"


def url_key(url: Column) -> Column:
    """Sort key of an address: host parts reversed, then port, path and query; scheme, user and fragment are left out.

    Host and key parts are as given but for a lower-case host; blanks and control characters are escaped. A null address has the
    key ``-``, one without scheme is its own key; of keys over 900 characters the rest is a hash.
    """
    scheme = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"
    host, port = F.lower(F.regexp_extract(url, scheme + r"([^/?#:]*)", 1)), F.regexp_extract(url, scheme + r"[^/?#:]*:([0-9]+)", 1)
    rest = F.regexp_replace(F.regexp_replace(url, scheme + r"[^/?#]*", ""), "(?s)#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    key = F.regexp_replace(F.when(url.rlike(scheme), key).otherwise(url), r"[\x00-\x20\x7F]", "%20")
    return F.coalesce(F.when(F.length(key) > KEY_CHARS, F.concat(F.left(key, F.lit(KEY_CHARS)), F.lit("~"), F.sha2(url, 256))).otherwise(key), F.lit("-"))


def _address(spark: SparkSession, path: str) -> str:
    """``path`` as tasks open it: whole, and plain for local files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()  # noqa: SLF001
    return uri.getPath() if uri.getScheme() == "file" else uri.toString()


class Files:
    """Files of one folder, opened in a task."""

    def __init__(self, at: str) -> None:
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(at)
        self.open: tuple[str, object] | None = None

    def create(self, name: str):  # noqa: ANN201
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, begin: int, size: int) -> bytes:
        """A range of a file; the file read last stays open."""
        if not self.open or self.open[0] != name:
            if self.open:
                self.open[1].close()
            self.open = name, self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[1].read_at(size, begin)


def gzipped(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def gunzipped(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


# ---- records ----


def record_id(page_id: int | None, digest: str, kind: str = "response") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{kind}')}>"


def _escaped(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(kind: str, block: bytes, fields: list[tuple[str, str | None]], captured: str = CAPTURED) -> bytes:
    """A record with its header lines; fields of null are left out."""
    head = [("WARC-Type", kind), ("WARC-Date", captured), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record; raises where it isn't whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not one whole record")
    return fields, rest[:size]


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, captured: str = CAPTURED) -> bytes:
    """A response, or, where ``first`` names another page, a revisit of that page's equal payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if first is None else "revisit"
    fields = [
        ("WARC-Record-ID", record_id(page_id, digest, kind)),
        ("WARC-Target-URI", None if url is None else _escaped(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if first is None else REVISIT_PROFILE),
        ("WARC-Refers-To", None if first is None else record_id(first, digest)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Page-Id", None if page_id is None else str(page_id)),
    ]
    return record(kind, head + payload if first is None else head, fields, captured)


def with_first(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, first): ``first`` is the least id of equal payloads where that is another page.

    Hashes are counted before they move; the table of those that repeat goes to all tasks if its bytes are few, else a hash of a
    large part of all pages is dealt over several tasks.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    repeated = persist_shared(repeated, "repeated-payloads")
    few = small(repeated)
    joined = rows.join(F.broadcast(repeated), "digest", "left") if few else dealt_join(rows, repeated, "digest", ["page_id", "url"], rows.count(), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.coalesce(F.col("page_id") != F.col("least"), F.col("least").isNotNull()), F.col("least")).alias("first"))


def write(pages: DataFrame, at: str, file_bytes: int = FILE_BYTES, captured: str = CAPTURED) -> DataFrame:
    """Write a record for each row of ``pages`` to archive files in the folder ``at``: their captures, one a row.

    Null html is empty, null addresses are left out of the record, null ids too (such pages revisit others, and
    others revisit them only if they have an id); very long pages are one record. Rows that repeat id and payload are
    written each: with the least id of a group all are responses. Other columns are ignored. Without pages nothing is written.
    """
    spark = pages.sparkSession
    folder = _address(spark, at)
    rows = with_first(pages).withColumn("url_key", url_key(F.col("url")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, name, size = Files(folder), None, "", 0
        for b in batches:
            found = []
            for page_id, url, payload, digest, first, key in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.create(name)
                    info = gzipped(record("warcinfo", b"software: lectern\r\nformat: WARC File Format 1.1\r\n", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], captured))
                    size += out.write(info)
                data = gzipped(page_record(page_id, url, payload, digest, first, captured))
                out.write(data)
                found.append((key, page_id, "response" if first is None else "revisit", digest, name, size, len(data)))
                size += len(data)
            if found:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*found)), kinds)], names=["url_key", "page_id", "record_type", "digest", "file", "begin", "size"])
        if out is not None:
            out.close()

    return persist_shared(rows.mapInArrow(work, CAPTURE), "captures")


def read_records(captures: DataFrame, at: str) -> DataFrame:
    """(page_id, url, record_id, record_type, refers_to, digest, payload) of the records where ``captures`` say, by range reads.

    ``captures`` is read twice: for its bytes, which tell the number of tasks, and for its places.

    Neighbouring records are read together. Revisits have no payload of their own (null). A response whose payload doesn't have its
    digest, or a range that isn't one record, ends the job. Rows that repeat are read each.
    """
    folder = _address(captures.sparkSession, at)
    # few bytes of places stand for many of records, so the records' bytes tell the number of tasks
    tasks = 1 + int(captures.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES
    places = captures.select("file", "begin", "size").repartition(tasks, "file", F.floor(F.col("begin") / STRETCH)).sortWithinPartitions("file", "begin")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        """Records in order of their places, read in stretches without gaps."""
        files, name, begin, sizes = Files(folder), None, 0, []

        def flush() -> Iterator[bytes]:
            data, p = files.read(name, begin, sum(sizes)), 0
            for n in sizes:
                yield data[p : p + n]
                p += n

        for b in batches:
            for file, start, size in zip(*(c.to_pylist() for c in b.columns)):
                if sizes and (file != name or start != begin + sum(sizes) or sum(sizes) + size > READ_BYTES or len(sizes) >= 512):
                    yield from flush()
                    sizes = []
                if not sizes:
                    name, begin = file, start
                sizes.append(size)
        if sizes:
            yield from flush()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_id", "record_type", "refers_to", "digest", "payload"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.binary()]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), kinds)], names=names)

        for data in parts(batches):
            fields, block = parsed(gunzipped(data))
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
            if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
            page = fields.get("Page-Id")
            rows.append((None if page is None else int(page), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"], kind, fields.get("WARC-Refers-To"), digest, payload))
            held += len(payload or b"")
            if held >= OUT_BYTES or len(rows) >= 4096:
                yield batch()
                rows.clear()
                held = 0
        if rows:
            yield batch()

    return places.mapInArrow(work, RECORD)


# ---- the index ----


def write_index(captures: DataFrame, at: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the captures, sorted by key, to index files in the folder ``at``: a row for each file with its first and last key.

    Ranges are over key and place, so that a key of many captures goes over several files. A file is its blocks, its directory (first key,
    begin and size of each block), and the directory's place.
    """
    folder = _address(captures.sparkSession, at)
    order = ["url_key", "file", "begin"]
    lines = captures.select(F.col("url_key").cast("binary").alias("url_key"), "page_id", "record_type", "digest", "file", "begin", "size")
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, name, size = Files(folder), None, f"index-{uuid.uuid4().hex}.gz", 0
        block: list[bytes] = []
        held, first, last, directory = 0, b"", b"", []

        def flush() -> None:
            nonlocal size, held
            data = gzipped(b"\n".join(block))
            directory.append(b"%b\t%d\t%d" % (block[0].partition(b"\t")[0], size, len(data)))
            size += out.write(data)
            block.clear()
            held = 0

        for b in batches:
            for key, page_id, kind, digest, file, begin, length in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out, first = files.create(name), key
                line = b"\t".join((key, b"" if page_id is None else b"%d" % page_id, kind.encode(), digest.encode(), file.encode(), b"%d" % begin, b"%d" % length))
                block.append(line)
                held, last = held + len(line), key
                if len(block) >= block_lines or held >= BLOCK_BYTES:
                    flush()
        if out is not None:
            if block:
                flush()
            data = gzipped(b"\n".join(directory))
            out.write(data)
            out.write(struct.pack("<qq", size, len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([size]), pa.array([len(data)])], names=["file", "first_key", "last_key", "directory", "size"])

    return persist_shared(lines.mapInArrow(work, SHARD), "index-files")


def _keys(lines: list[bytes]) -> list[bytes]:
    return [x.partition(b"\t")[0] for x in lines]


def find_blocks(keys: DataFrame, shards: DataFrame, at: str) -> DataFrame:
    """(url_key, file, begin, size): for each key the index blocks that can hold it, by binary search in files and directories.

    ``shards`` has a row of about two keys, at most 2 kB, for each index file; these go to all tasks. A directory stays in a task until a key lies in
    another file; keys come in order.
    """
    folder = _address(keys.sparkSession, at)
    known = sorted((bytes(r.first_key), bytes(r.last_key), r.file, r.directory, r.size) for r in shards.collect())
    wanted = keys.select(F.col("url_key").cast("binary").alias("url_key")).where("url_key is not null").distinct()
    wanted = wanted.repartitionByRange("url_key").sortWithinPartitions("url_key")
    # files are disjoint ranges, but for keys that end one and begin the next
    firsts, lasts = [x[0] for x in known], [x[1] for x in known]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, entries, starts = Files(folder), None, [], []
        for b in batches:
            found = []
            for key in b.column(0).to_pylist():
                for _, _, file, directory, size in known[bisect_left(lasts, key) : bisect_right(firsts, key)]:
                    if file != name:
                        name, entries = file, gunzipped(files.read(file, directory, size)).split(b"\n")
                        starts = _keys(entries)
                    # a key's first lines may end the block before the first one that begins with it
                    for entry in entries[max(bisect_left(starts, key) - 1, 0) : bisect_right(starts, key)]:
                        _, begin, length = entry.split(b"\t")
                        found.append((key, file, int(begin), int(length)))
            if found:
                kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*found)), kinds)], names=["url_key", "file", "begin", "size"])

    return wanted.mapInArrow(work, "url_key binary, file string, begin long, size long")


def find(keys: DataFrame, shards: DataFrame, at: str) -> DataFrame:
    """Captures of the keys in the column ``url_key`` of ``keys``; each key counts once, keys without captures give no row.

    Blocks are dealt out by place, so that each is read once and a key of many captures is read by many tasks.
    """
    folder = _address(keys.sparkSession, at)
    tasks = 1 + int(shards.agg(F.sum("directory")).first()[0] or 0) // TASK_BYTES  # a directory begins where the blocks end
    blocks = find_blocks(keys, shards, at).repartition(tasks, "file", "begin").sortWithinPartitions("file", "begin", "url_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place, lines, starts = Files(folder), None, [], []
        for b in batches:
            found = []
            for key, file, begin, size in zip(*(c.to_pylist() for c in b.columns)):
                if place != (file, begin):
                    place, lines = (file, begin), gunzipped(files.read(file, begin, size)).split(b"\n")
                    starts = _keys(lines)
                found += [x.decode().split("\t") for x in lines[bisect_left(starts, key) : bisect_right(starts, key)]]
            if found:
                k, page, kind, digest, name, at_, n = map(list, zip(*found))
                arrays = [pa.array(k), pa.array([int(x) if x else None for x in page], pa.int64()), pa.array(kind), pa.array(digest), pa.array(name), pa.array([int(x) for x in at_], pa.int64()), pa.array([int(x) for x in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["url_key", "page_id", "record_type", "digest", "file", "begin", "size"])

    return blocks.mapInArrow(work, CAPTURE)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records: revisits as the response that they refer to.

    A response that many records refer to is dealt over several tasks. A revisit whose response isn't among ``records`` has nulls.
    """
    slim = records.select("page_id", "record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    slim = persist_shared(slim, "records")
    responses, revisits = slim.where("record_type = 'response'"), slim.where("record_type <> 'response'").select("page_id", "record_type", "refers_to")
    counts = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    wanted = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), "payload_bytes", "payload_digest").join(counts, "refers_to").dropDuplicates(["refers_to"])
    again = dealt_join(revisits, persist_shared(wanted, "revisited"), "refers_to", "page_id", slim.count(), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(again.select(*columns, F.col("first").alias("refers_to")))


#: What the archives hold, by plain SQL.
ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(COALESCE(html, ''))::BIGINT AS n, sha256(COALESCE(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id IS DISTINCT FROM COALESCE(first, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM COALESCE(first, page_id) THEN first END AS refers_to FROM f
"""
