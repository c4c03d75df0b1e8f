"""Archives: round trips, both ARC versions, revisits and damage."""

import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from readprism.llm import archive as A

BIG = "é" * 600
SCHEMA = "id long, url string, payload string, html int"


def expected(rows):
    out = []
    tops = {}
    for i, (key, _, payload, _) in enumerate(rows):
        data = (payload or "").encode()
        tops.setdefault(data, []).append((key is not None, key or 0, i))
    for i, (key, _, payload, _) in enumerate(rows):
        data = (payload or "").encode()
        top = max(tops[data])
        again = len(data) >= 1000 and (key is not None, key or 0) != top[:2]
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[1] if again else None))
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    rows = [(1, "http://a/ b", BIG, 1), (2, None, BIG, 1), (9, "http://c", BIG, 2), (None, "http://n", BIG, 0), (3, "", None, 0), (4, "http://d", "", 0), (5, "http://e", "small", 0), (6, "http://e", "small", 0), (7, "x", "line\r\n\r\nWARC/1.1\r\nhttp://x 1 2 3 4\n", 0), (8, "y", "z" * 1000, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = A.archive_round_trip(df.select("id", "url", "payload"), version=version).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(expected(rows), key=key)
    ids = {r.record_id: r.id for r in got}
    assert len(ids) == len(rows) and all(ids[r.refers_to_record] == r.refers_to for r in got if r.record_type == "revisit")


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "u", BIG)] * 4, "id long, url string, payload string")
    got = A.archive_round_trip(df).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit", "revisit"]
    assert len({r.record_id for r in got}) == 4 and {r.refers_to_record for r in got if r.refers_to_record} == {r.record_id for r in got if r.record_type == "response"}
    assert A.archive_round_trip(df.where("id < 0")).count() == 0


def test_very_long_payload_and_clashing_columns(spark):
    big = "<p>" + "é" * 3_000_000
    df = spark.createDataFrame([(1, "u", big, "x"), (2, "u", big, "y")], "id long, url string, payload string, place string").withColumn("digest", F.lit(1)).withColumn("refer_id", F.lit(2))
    got = {r.id: r for r in A.archive_round_trip(df, version=2).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].payload_bytes == got[1].payload_bytes == 6_000_003


def test_foreign_arc():
    v1 = b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 0
    body = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    v1 = b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain %d\n" % len(body) + body + b"\n"
    one = b"http://a/ 1.2.3.4 19970102030405 text/html 5\nhello\n" + b"dns:b 0.0.0.0 19970102030405 text/dns 3\na\nb\n"
    got = list(A.arc_records(A.inflate(gzip.compress(v1) + gzip.compress(one))))
    assert [(r.url, r.block, r.date) for r in got] == [("http://a/", b"hello", "19970102030405"), ("dns:b", b"a\nb", "19970102030405")]
    row = {"id": None, "url": "dns:b", "date": got[1].date, "mime": "text/dns", "ip": "0.0.0.0", "head": b"", "payload": b"a\nb", "place": "x:1", "digest": hashlib.sha1(b"a\nb").digest(), "refer_url": None}
    (head, block), = A.warc_records(A.warc_record(row) + b"\r\n\r\n")
    assert b"WARC-Type: resource" in head and b"WARC-Date: 1997-01-02T03:04:05Z" in head and block == b"a\nb"


@pytest.mark.parametrize("data", [b"http://a 1 2 3\n", b"filedesc://x 0 1 text/plain 900\n1 0 O\n", b"nonsense"])
def test_damage(data):
    with pytest.raises(ValueError):
        list(A.arc_records(data, "f"))
    with pytest.raises(ValueError):
        list(A.warc_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nxx"))


def test_repeated_captures_of_a_foreign_arc(spark, tmp_path):
    """HTTP/1.0 without a length, a DNS record and bare content, each twice and long; odd values under our header's name."""
    intro = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain %d\n" % len(intro) + intro
    old = b"HTTP/1.0 200 OK\r\nContent-type: text/html\r\nX-Source-Id: none of ours\r\n\r\n" + b"<p>old page</p>" * 100
    for url, block in (("http://a/", old), ("http://b/", old), ("dns:c", b"c. 300 IN A 1.2.3.4\n" * 80), ("dns:d", b"c. 300 IN A 1.2.3.4\n" * 80), ("ftp://e", b"\xff\xfe" * 800), ("ftp://f", b"\xff\xfe" * 800)):
        data += f"{url} 1.2.3.4 19970102030405 text/html {len(block)}\n".encode() + block + b"\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "x.arc.gz").write_bytes(gzip.compress(data))
    A.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {r.url: r for r in A.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert len(got) == 6 and all(r.id is None for r in got.values())
    for a, b, kind, size in (("http://a/", "http://b/", "response", 1500), ("dns:c", "dns:d", "resource", 1600), ("ftp://e", "ftp://f", "resource", 1600)):
        assert sorted([got[a].record_type, got[b].record_type]) == sorted([kind, "revisit"])
        assert got[a].payload_bytes == got[b].payload_bytes == size and got[a].payload_digest == got[b].payload_digest


def test_odd_version_blocks_and_dates(spark, tmp_path):
    body = b"1 0 Org\nURL Host Archive-date Kind Archive-length\n"
    data = b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain %d\n" % len(body) + body + b"http://a/ 1.2.3.4 19970102030405 text/html 2\nhi\n"
    with pytest.raises(ValueError, match="no Content-type, IP-address"):
        list(A.arc_records(data, "x.arc"))
    with pytest.raises(ValueError, match="no ARC date"):
        A.warc_record({"date": "yesterday", "place": "x:0", "refer_url": None, "head": b"", "payload": b""})


def test_payloads_cross_to_python_once_a_read(spark, tmp_path, monkeypatch):
    """One pass finds digests, one makes the records; writing ARC needs no Python. Files, headers and both joins are held against the rows."""
    passes = []
    df = spark.createDataFrame([(i, f"http://h/{i}", f"{i % 40} {BIG}" if i % 2 else str(i)) for i in range(1, 101)], "id long, url string, payload string").coalesce(1)
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: passes.append(1) or plain(self, *a, **k))
    arc = str(tmp_path / "arc")
    A.write_arc(df, arc, file_records=30)
    assert len(passes) == 0
    files = [list(A.arc_records(gzip.decompress(f.read_bytes()), f.name)) for f in sorted((tmp_path / "arc").glob("*.gz"))]
    assert [len(f) for f in files] == [30, 30, 30, 10] and [r.url for f in files for r in f] == [f"http://h/{i}" for i in range(1, 101)]
    found = []
    for k, most in enumerate((A.BROADCAST_BYTES, -1)):
        monkeypatch.setattr(A, "BROADCAST_BYTES", most)
        A.convert_arc(spark, arc, str(tmp_path / f"warc{k}"), file_records=30)
        records = [r for f in (tmp_path / f"warc{k}").glob("*.gz") for r in A.warc_records(gzip.decompress(f.read_bytes()))]
        for head, block in records:
            assert b"WARC-Block-Digest: " + A._sha1(hashlib.sha1(block).digest()).encode() + b"\r\n" in head
            assert (b"WARC-Type: revisit" in head) == block.endswith(b"\r\n\r\n") == (b"WARC-Refers-To: " in head)
        found.append(sorted(records))
    assert len(passes) == 4 and found[0] == found[1] and len(found[0]) == 100
    assert sum(b"WARC-Type: revisit" in head for head, _ in found[0]) == 30


def test_archives_take_the_cheap_gzip_level(spark, tmp_path):
    """Two fifths of the round trip's CPU time were gzip at its default level."""
    text = " ".join(hashlib.sha1(b"%d" % (i * i % 3001)).hexdigest()[: 3 + i % 5] for i in range(60_000))
    A.write_arc(spark.createDataFrame([(1, "u", text)], "id long, url string, payload string"), str(tmp_path / "arc"))
    (stored,) = [f.read_bytes() for f in (tmp_path / "arc").glob("*.gz") if f.stat().st_size > 1000]
    cheap, usual = (len(zlib.compress(gzip.decompress(stored), level)) for level in (4, 6))
    assert usual < cheap and abs(len(stored) - cheap) < (cheap - usual) / 2


def test_header_fields():
    fields = A._fields(b"HTTP/1.1 200 OK\r\nX-a:  1 \r\nx-A: 2\n  X-b: 3\r\nX-c:\r\nno field\r\n\r\n")
    assert [A._field(fields, name) for name in ("X-A", "X-b", "X-c", "no field")] == ["1 ", None, "", None]
