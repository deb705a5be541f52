"""WARC archives with a two-level capture index.

Writing: each task writes archives of about ARCHIVE_BYTES, one gzip member a record, to the shared folder, under
a name of its own attempt: a repeated task never touches a file that an index row of another attempt names.
Records with equal payloads of at least REVISIT_BYTES bytes: the one with the smallest page_id is a response,
the others are revisits without a body that name the response's url and page.

Index: entries (key, page_id, archive, offset, length) are range-partitioned and sorted by reversed-host url key
(`com,example)/path`). Blocks of BLOCK entries are compressed into index files; each file ends with its sparse
directory (first entry and place of every block). The list of the files, one row a partition, is all that is sent
to every executor. A lookup takes three binary searches: in that list, in a file's directory, in one block; then
one range read fetches the record. Lookups are grouped by index file, then by archive, so each block and
directory is read once and archives are read in order.

Reading back parses every record and hashes its payload anew; a revisit gets length and digest from the payload
of the response that it names.

The shared folder is opened through pyarrow's file systems, so it can be any that executors share.

Defined cases: null html is empty, a null url has the key '' and no target. Repeated rows (same page_id, url and
html) are records of their own; those with the smallest page_id of a payload are all responses. A null page_id
comes before all others in the index and is never referred to while a number has the same payload; where all
page_ids of a payload are null its records are responses. Very long payloads are one record. Empty table: no
archives, no rows. Extra columns are ignored. page_ids are integers. A revisit whose response isn't in the archives
raises an error.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stored, tasks

REVISIT_BYTES = 100
ARCHIVE_BYTES, BLOCK = 64 << 20, 2000
#: Range reads of one archive are dealt to tasks in stretches of this size.
STRETCH = 8 << 20
DATE = "2024-01-01T00:00:00Z"
NO_ID = -(1 << 63)


def _fs(root: str):
    """root is a full URI, as shared() makes it, so executors open the store that the driver means."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def shared(spark: SparkSession, path: str) -> str:
    """path with the scheme of the default file system, where it names none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def url_key(url: str = "url") -> Column:
    """Reversed-host key: `https://a.example.com:80/x?y` gives `com,example,a:80)/x?y`."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(u, r"(?s)^.*?://(?:[^/?#@]*@)?[^/?#:]*(.*)$", 1)
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_extract(rest, r"^(:\d+)?", 0), F.lit(")"), F.regexp_replace(rest, r"^:\d+", "")))


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, is_revisit: bool) -> bytes:
    """One WARC record as a gzip member. Header values are percent-free: line breaks in urls are escaped as in JSON."""
    clean = lambda s: json.dumps(s, ensure_ascii=False)[1:-1]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Date: {DATE}"]
        head += [f"WARC-Refers-To-Target-URI: {clean(refers_url)}"] if refers_url is not None else []
    head += [f"Content-Length: {len(body)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    page_id: int | None
    url: str | None
    type: str
    digest: str
    payload: bytes
    refers_to: int | None


def decode_record(member: bytes) -> Record:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(body) != int(fields["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut")
    number = lambda s: None if s in (None, "<urn:page:none>") else int(re.fullmatch(r"<urn:page:(-?\d+)>", s)[1])
    url = fields.get("WARC-Target-URI")
    return Record(number(fields["WARC-Record-ID"]), None if url is None else json.loads(f'"{url}"'), fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), body.partition(b"\r\n\r\n")[2], number(fields.get("WARC-Refers-To")))


@dataclass
class Captures:
    """Written archives. files: (first key, first page_id, index file), sorted: one a partition."""

    root: str
    files: list[tuple[str, int, str]]


def _planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, key, digest, first_id, first_url: the response that a page's payload has (null: its own).

    Pages under REVISIT_BYTES can't be revisits and meet nothing. The others meet the first pages of their digests:
    those are found without payloads and written, so a payload that many pages share can be split over tasks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    big = rows.where(F.octet_length("html") >= REVISIT_BYTES).withColumn("digest", F.sha2("html", 256))
    first = big.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "warc-firsts", compression="zstd")
    small = rows.where(F.octet_length("html") < REVISIT_BYTES).select("*", F.sha2("html", 256).alias("digest"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    return big.join(first, "digest", "left").select(*small.columns).union(small).select("page_id", "url", "html", url_key().alias("key"), "digest", "first_id", "first_url")


def write_archives(pages: DataFrame) -> Captures:
    spark = pages.sparkSession
    root = shared(spark, scratch(spark, "warc"))
    fs, path = _fs(root)
    fs.create_dir(path, recursive=True)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(root)
        names, sink, name, at, part = ["key", "page_id", "archive", "offset", "length"], None, "", 0, 0
        for b in batches:
            for k in range(0, b.num_rows, 500):
                out = []
                for page_id, url, html, key, digest, first_id, first_url in zip(*(c.to_pylist() for c in b.slice(k, 500).columns), strict=True):
                    if sink is None or at >= ARCHIVE_BYTES:
                        if sink:
                            sink.close()
                        name = f"{TaskContext.get().partitionId():06d}-{part:04d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                        sink, at, part = fs.open_output_stream(f"{path}/{name}", compression=None), 0, part + 1
                    revisit = first_id is not None and first_id != page_id
                    member = encode_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first_id, first_url, revisit)
                    sink.write(member)
                    out.append((key, NO_ID if page_id is None else page_id, name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)
        if sink:
            sink.close()

    entries = stored(_planned(pages).mapInArrow(archive, "key string, page_id long, archive string, offset long, length long"), "warc-entries", compression="zstd")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(root)
        name = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.cdx"
        held, directory, at, sink = [], [], 0, None

        def flush() -> None:
            nonlocal at, sink
            sink = sink or fs.open_output_stream(f"{path}/{name}", compression=None)
            block = zlib.compress("\n".join(map(json.dumps, held)).encode())
            sink.write(block)
            directory.append([held[0][0], held[0][1], at, len(block)])
            at += len(block)
            held.clear()

        for b in batches:
            for e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(e)
                if len(held) >= BLOCK:
                    flush()
        if held:
            flush()
        if sink:
            tail = zlib.compress("\n".join(map(json.dumps, directory)).encode())
            sink.write(tail + struct.pack("<Q", len(tail)))
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])], ["key", "page_id", "file"])

    ordered = entries.repartitionByRange("key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")
    files = stored(ordered.mapInArrow(index, "key string, page_id long, file string"), "warc-files").collect()
    return Captures(root, sorted((r.key, r.page_id, r.file) for r in files))


class IndexReader:
    """One index file: its directory in memory, one block at a time."""

    def __init__(self, fs, path: str):
        self.source = fs.open_input_file(path)
        end = self.source.size()
        (n,) = struct.unpack("<Q", self.source.read_at(8, end - 8))
        self.directory = [json.loads(x) for x in zlib.decompress(self.source.read_at(n, end - 8 - n)).decode().split("\n")]
        self.firsts = [(d[0], d[1]) for d in self.directory]
        self.at, self.block, self.keys = -1, [], []

    def load(self, i: int) -> None:
        if i != self.at:
            _, _, offset, length = self.directory[i]
            self.block = [json.loads(x) for x in zlib.decompress(self.source.read_at(length, offset)).decode().split("\n")]
            self.keys, self.at = [(e[0], e[1]) for e in self.block], i

    def find(self, key: str, page_id: int) -> Iterator[list]:
        """Entries with this key and page_id."""
        want = (key, page_id)
        i = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while i < len(self.firsts) and self.firsts[i] <= want:
            self.load(i)
            k = bisect.bisect_left(self.keys, want)
            while k < len(self.keys) and self.keys[k] == want:
                yield self.block[k]
                k += 1
            i += 1


def lookup(captures: Captures, wanted: DataFrame) -> DataFrame:
    """archive, offset, length of every record for distinct (key, page_id) rows of wanted (null page_id: NO_ID)."""
    root, files = captures.root, captures.files  # one file a partition of the index: bounded
    firsts = [(k, p) for k, p, _ in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, page_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i = max(0, bisect.bisect_left(firsts, (key, page_id)) - 1)
                while i < len(firsts) and firsts[i] <= (key, page_id):  # equal entries may lie in several files
                    out.append((files[i][2], key, page_id))
                    i += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["file", "key", "page_id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(root)
        name, reader = None, None
        for b in batches:
            out = []
            for file, key, page_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    name, reader = file, IndexReader(fs, f"{path}/{file}")
                out += [e[2:] for e in reader.find(key, page_id)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "offset", "length"])

    routed = wanted.select("key", "page_id").mapInArrow(route, "file string, key string, page_id long")
    return routed.repartition("file").sortWithinPartitions("file", "key", "page_id").mapInArrow(search, "archive string, offset long, length long")


def read_records(captures: Captures, places: DataFrame) -> DataFrame:
    """page_id, url, record_type, header_digest, refers_to, payload, payload_digest (of the payload as read) of records by range reads."""
    root = captures.root
    names = ["page_id", "url", "record_type", "header_digest", "refers_to", "payload", "payload_digest"]
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(root)
        opened = lru_cache(16)(lambda name: fs.open_input_file(f"{path}/{name}"))
        for b in batches:
            for k in range(0, b.num_rows, 200):
                out = []
                for name, offset, length in zip(*(c.to_pylist() for c in b.slice(k, 200).columns), strict=True):
                    r = decode_record(opened(name).read_at(length, offset))
                    out.append((r.page_id, r.url, r.type, r.digest, r.refers_to, r.payload, hashlib.sha256(r.payload).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    # a place is a few bytes and stands for a whole record: the number of tasks is given, not left to the size of the places
    places = places.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).repartition(tasks(places.sparkSession), "archive", "stretch").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return places.mapInArrow(run, "page_id long, url string, record_type string, header_digest string, refers_to long, payload binary, payload_digest string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, read back from the archives."""
    captures = write_archives(pages)
    wanted = pages.select(url_key().alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id")).distinct()
    read = read_records(captures, lookup(captures, wanted)).select("page_id", "record_type", "header_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")
    read = stored(read, "warc-read", compression="zstd")
    bad = read.where("record_type = 'response' AND payload_digest <> header_digest").limit(1).count()
    if bad:
        raise ValueError("a payload read back has another digest than its header")
    return resolved(read)


def resolved(read: DataFrame) -> DataFrame:
    """Revisits get length and digest from the response that they name; one whose response isn't there raises."""
    # only responses that a revisit may name; written, so that one that many revisits name can be split
    source = read.where(F.expr(f"record_type = 'response' AND page_id IS NOT NULL AND payload_bytes >= {REVISIT_BYTES}")).groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest")).agg(F.first("payload_bytes").alias("payload_bytes"))
    source = stored(source, "warc-responses", compression="zstd")
    own = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    again = read.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "header_digest").join(source, ["refers_to", "header_digest"], "left")
    again = again.withColumn("payload_bytes", F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")))
    return own.unionByName(again.select("page_id", "payload_bytes", F.col("header_digest").alias("payload_digest"), "record_type", "refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::bigint AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT q.page_id, q.payload_bytes, q.payload_digest, CASE WHEN f.first_id <> q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> q.page_id THEN f.first_id END AS refers_to
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest
"""
