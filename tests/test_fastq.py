"""The FASTQ source against a line-by-line reader, at many split sizes."""

import gzip
import random
import time

import pytest

from readprism.operators.quality import phred_offset
from readprism.sources import bgzf
from readprism.sources import fastq as S


def drawn(rng, n, long=60):
    """Reads whose qualities and names look like other lines."""
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 30, long])
        name = rng.choice([f"r{i}", f"r{i}@x +", "", f"é{i}" if i % 7 == 0 else "@", "+"])
        rows.append((name, "".join(rng.choice("ACGTNacgt") for _ in range(size)), "".join(rng.choice("@+I!#~") for _ in range(size))))
    return rows


def text(rows, end=b"\n"):
    return b"".join(b"@" + n.encode("latin-1") + end + s.encode() + end + b"+" + end + q.encode() + end for n, s, q in rows)


def read(path, split, columns=("read_idx", "id", "seq", "qual"), most=None):
    reader = S.FastqReader(str(path), split, list(columns), most)
    return [[r for batch in reader.read(p) for r in zip(*(c.to_pylist() for c in batch.columns))] for p in reader.partitions()]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
def test_plain_at_every_split(tmp_path, monkeypatch, block, end):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    for trial in range(12):
        rows = drawn(rng, rng.randint(1, 25))
        data = text(rows, end)
        data = data[: -len(end)] if trial % 3 == 0 and rows[-1][1] else data + end * (trial % 4)
        (tmp_path / "x.fastq").write_bytes(data)
        starts, at = [], 0
        for r in rows:
            starts.append(at)
            at += len(text([r], end))
        for split in {1, 2, 3, 10, 41, 97, 300, 10_000, rng.randint(1, 200)}:
            got = [r for part in read(tmp_path / "x.fastq", split) for r in part]
            assert got == [(p, *r) for p, r in zip(starts, rows)], (trial, split)


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_block_gzip_at_every_split(tmp_path, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(15):
        rows = drawn(rng, rng.randint(1, 60))
        packed = bgzf.pack(text(rows), rng.choice([1, 9, 40, 200, 60_000]))
        (tmp_path / "x.fastq.gz").write_bytes(packed)
        assert gzip.decompress(packed) == text(rows)
        for split in {1000, 77, 29, len(packed), rng.randint(20, 500)}:
            got = [r for part in read(tmp_path / "x.fastq.gz", split) for r in part]
            assert [r[1:] for r in got] == rows
            assert [r[0] for r in got] == sorted({r[0] for r in got})


def test_block_gzip_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(90)), "I" * 90) for i in range(20_000)]
    (tmp_path / "b.fastq.gz").write_bytes(bgzf.pack(text(rows)))
    (tmp_path / "p.fastq").write_bytes(text(rows))
    packed = S.read_fastq(spark, str(tmp_path / "b.fastq.gz"), split_bytes=100_000)
    plain = S.read_fastq(spark, str(tmp_path / "p.fastq"), split_bytes=500_000)
    assert packed.rdd.getNumPartitions() > 5
    assert [r[1:] for r in packed.orderBy("read_idx").collect()] == [r[1:] for r in plain.orderBy("read_idx").collect()] == rows
    assert sum(bool(p) for p in read(tmp_path / "b.fastq.gz", 100_000)) > 5


def test_members_are_found_among_bytes_that_look_like_them():
    data = bytes(range(256)) * 300
    packed = bgzf.pack(data, 5000)
    for junk in (b"", bgzf.MAGIC * 5, packed[:20], bgzf.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0\x30\0"):
        found = bgzf.first_member(junk + packed, True)
        assert found == len(junk)
    assert bgzf.first_member(b"nothing here", True) == -1


def test_other_gzip(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    rows = drawn(random.Random(5), 200)
    packed = gzip.compress(text(rows[:90], b"\r\n")) + gzip.compress(text(rows[90:])) + b"\0" * 512
    (tmp_path / "x.fastq.gz").write_bytes(packed)
    assert read(tmp_path / "x.fastq.gz", 64) == [[(i, *r) for i, r in enumerate(rows)]]
    (tmp_path / "cut.fastq.gz").write_bytes(packed[:900])
    with pytest.raises(ValueError):
        read(tmp_path / "cut.fastq.gz", 64)


@pytest.mark.parametrize("bad", [b"@a\nACGT\n+\nII\n", b"@a\nACGT\n-\nIIII\n", b">a\nACGT\n+\nIIII\n", b"@a\nACGT\n+\n", b"@a\nACGT\n\nIIII\n", b"\n@a\nA\n+\nI\n"])
def test_damage_is_reported_with_its_place(tmp_path, bad):
    good = text([("x", "AC", "II")])
    (tmp_path / "x.fastq").write_bytes(good + bad)
    with pytest.raises(ValueError, match=f"x.fastq.*{len(good)}"):
        read(tmp_path / "x.fastq", 1 << 20)


def test_damaged_blocks(tmp_path):
    packed = bytearray(bgzf.pack(text(drawn(random.Random(6), 500)), 300))
    packed[len(packed) // 2] ^= 0xFF
    (tmp_path / "x.fastq.gz").write_bytes(bytes(packed))
    with pytest.raises(ValueError, match="x.fastq.gz"):
        read(tmp_path / "x.fastq.gz", 1 << 20)
    (tmp_path / "cut.fastq.gz").write_bytes(bytes(packed[:200]))
    with pytest.raises(ValueError, match="no block"):
        read(tmp_path / "cut.fastq.gz", 1 << 20)


def test_only_asked_columns_leave_the_reader(spark, tmp_path):
    rows = drawn(random.Random(8), 50)
    path = str(tmp_path / "x.fastq")
    (tmp_path / "x.fastq").write_bytes(text(rows))
    reader = S.FastqReader(path, 1 << 20, ["qual", "file"])
    assert next(reader.read(reader.partitions()[0])).schema.names == ["qual", "file"]
    got = S.read_fastq(spark, path, columns=("seq", "file"))
    assert got.columns == ["seq", "file"] and [tuple(r) for r in got.collect()] == [(r[1], path) for r in rows]
    assert spark.read.format("fastq").schema("qual string, read_idx long").load(path).columns == ["qual", "read_idx"]
    with pytest.raises(Exception, match="columns are some of"):
        S.read_fastq(spark, path, columns=("seq", "colour")).collect()


def test_head_reads_stop_early(spark, tmp_path):
    """The first reads come from the head: damage behind it is never met, in whatever files it lies."""
    rows = drawn(random.Random(9), 300)
    rows = [r for r in rows if r[1]]
    (tmp_path / "a.fastq").write_bytes(text(rows[:100]))
    (tmp_path / "b.fastq.gz").write_bytes(bgzf.pack(text(rows[100:]), 500))
    (tmp_path / "c.fastq").write_bytes(b"not reads at all\n" * 1000)
    for n in (0, 1, 99, 100, 101, 150):
        parts = read(tmp_path, 50, most=n)
        assert len(parts) == 1 and [r[1:] for r in parts[0]] == rows[:n]
    (tmp_path / "d.fastq").write_bytes(text([("h", "A" * 10, "h" * 10)] * 50_000) + text([("low", "A", "#")]))
    head = S.read_fastq(spark, str(tmp_path / "d.fastq"), columns=("qual",), records=50_000)
    assert phred_offset(head).first()["offset"] == 64
    assert phred_offset(S.read_fastq(spark, str(tmp_path / "d.fastq"))).first()["offset"] == 64
    assert phred_offset(S.read_fastq(spark, str(tmp_path / "d.fastq"), columns=("qual",))).first()["offset"] == 33


def test_long_records_take_linear_time(tmp_path):
    rows = [("long", "ACGT" * 5_000_000, "IIII" * 5_000_000), ("short", "A", "I")]
    (tmp_path / "x.fastq").write_bytes(text(rows))
    began = time.time()
    parts = read(tmp_path, 1 << 20, ["seq"])
    assert [len(r[0]) for p in parts for r in p] == [20_000_000, 1] and time.time() - began < 30
