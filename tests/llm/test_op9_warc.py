"""Records, index files and whole archives against plain Python."""

import gzip
import hashlib

import pytest

from tessera.llm import op9_warc as op
from tessera.llm.common import scratch

LONG = "<p>" + "x" * 200 + "é</p>"
ROWS = [
    (5, "https://b.example.com/x?q=1#f", LONG), (3, "http://a.example.com", LONG), (9, None, LONG), (1, "no scheme", "short"), (2, "http://a.example.com/", "short"),
    (4, "http://é.org/\nline", None), (6, "http://a.example.com/", ""), (7, "http://U@Host.NET:80/p", "z" * 99), (8, "http://host.net/p", "z" * 100), (10, "http://host.net/p", "z" * 100),
    (11, "http://big/", "w " * 500000), (12, "http://same/", "one page twice" * 20), (12, "http://same/", "one page twice" * 20), (None, "http://none/", LONG), (None, "http://none/2", "q" * 300), (None, "http://none/3", "q" * 300),
]


def brute(rows):
    big = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            big[p] = min(i, big.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = big.get(p) is not None and big[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", big[p] if again else None))
    return sorted(out, key=repr)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 3)
    monkeypatch.setattr(op, "ARCHIVE_BYTES", 400)
    rows = ROWS + [(100 + k, f"http://h{k % 5}.org/{k}", f"page {k % 50} " * 20) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS digest")
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in op.archive_and_read(df).collect()), key=repr)
    assert got == brute(rows)
    assert op.archive_and_read(df.limit(0)).collect() == []


def test_lookup_reads_single_records(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 4)
    rows = [(k, f"http://h{k % 7}.org/{k}", f"page {k} " * 30) for k in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = op.write_archives(df)
    wanted = df.where("page_id % 17 = 3").select(op.url_key().alias("key"), "page_id").unionByName(spark.sql("SELECT 'org,none)/' AS key, 1L AS page_id"))
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in op.read_records(captures, op.lookup(captures, wanted)).collect()}
    assert got == {i: (u, h) for i, u, h in rows if i % 17 == 3}
    fs, path = op._fs(captures.root)
    from pyarrow import fs as pafs

    names = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".warc.gz")]
    whole = b"".join(gzip.decompress(fs.open_input_file(n).read()) for n in names)
    assert whole.count(b"WARC/1.1\r\n") == 100


def test_keys(spark):
    df = spark.createDataFrame([(u,) for _, u, _ in ROWS], "url string")
    keys = [r.k for r in df.select(op.url_key().alias("k")).collect()]
    assert keys[:5] == ["com,example,b)/x?q=1#f", "com,example,a)", "", "no scheme", "com,example,a)/"]
    assert keys[7] == "net,host:80)/p"


def test_record_round_trip(spark):
    m = op.encode_record(-5, 'a"\\\r\nb', b"\x00\r\n\r\nx", "d" * 64, None, None, False)
    r = op.decode_record(m)
    assert (r.page_id, r.url, r.type, r.payload, r.refers_to) == (-5, 'a"\\\r\nb', "response", b"\x00\r\n\r\nx", None)
    assert scratch(spark, "x") != scratch(spark, "x")


def test_a_lost_response_is_an_error(spark):
    kind = "page_id long, record_type string, header_digest string, refers_to long, payload_bytes long, payload_digest string"
    rows = [(1, "response", "a", None, 200, "a"), (2, "revisit", "a", 1, 0, "none"), (3, "revisit", "b", 9, 0, "none")]
    assert {r.page_id: r.payload_bytes for r in op.resolved(spark.createDataFrame(rows[:2], kind)).collect()} == {1: 200, 2: 200}
    with pytest.raises(Exception, match="no response for the revisit of page 3"):
        op.resolved(spark.createDataFrame(rows, kind)).collect()


def test_small_pages_meet_nothing(spark):
    """Payloads that can't be revisits aren't in the join, so equal ones don't gather in one task."""
    df = spark.createDataFrame([(k, "u", "short" if k % 2 else None) for k in range(50)] + [(90, "u", "x" * 200), (91, "u", "x" * 200)], "page_id long, url string, html string")
    rows = op._planned(df).collect()
    assert len(rows) == 52 and {r.page_id: r.first_id for r in rows if r.first_id is not None} == {90: 90, 91: 90}


def test_shared_paths_have_a_scheme(spark):
    assert op.shared(spark, "/some/where") == "file:///some/where" and op.shared(spark, "file:///x") == "file:///x"
