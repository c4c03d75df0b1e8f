"""Wrapped and damaged FASTQ at many split sizes, against a plain reading of the whole file."""

import gzip
import random
import re
import textwrap

import pytest

from readprism.sources import bgzf, lenient
from readprism.sources import fastq as S

ALL = ("read_idx", "id", "seq", "qual", "corrupt")


def wrapped_at(text: list[str], i: int):
    """(next line, bases, qualities) of the wrapped record at a line, whatever its qualities hold."""
    plus = i + 1
    while plus < len(text) and re.fullmatch(r"[A-Za-z*.\-]*", text[plus]):
        plus += 1
    if not text[i].startswith("@") or plus >= len(text) or not text[plus].startswith("+"):
        return None
    seq, qual, j = "".join(text[i + 1 : plus]), "", plus + 1
    while j < len(text) and len(qual) < len(seq):
        qual, j = qual + text[j], j + 1
    if not seq and j < len(text) and not text[j]:
        j += 1
    return (j, seq, qual, plus) if len(qual) == len(seq) else None


def swallows(text: list[str], plus: int, end: int) -> bool:
    for k in range(plus + 1, end):
        one = wrapped_at(text[:end], k)
        two = one and one[1] and one[0] < end and wrapped_at(text[:end], one[0])
        if two and two[1]:
            return True
    return False


def plain_reading(data: str, wrapped: bool):
    """[(place, id, seq, qual, corrupt)] of the whole text, line by line."""
    lines, place = [], 0
    for line in data.splitlines(keepends=True):
        lines.append((place, line.rstrip("\n").removesuffix("\r")))
        place += len(line)
    text = [line for _, line in lines]
    out, i = [], 0
    while i < len(text):
        found = None
        if text[i].startswith("@"):
            if not wrapped:
                part = text[i : i + 4]
                if len(part) == 4 and part[2].startswith("+") and len(part[1]) == len(part[3]):
                    found = (i + 4, part[1], part[3])
            else:
                found = wrapped_at(text, i)
                if found and swallows(text, found[3], found[0]):
                    found = None
        if found:
            out.append((lines[i][0], text[i][1:], found[1], found[2], None))
            i = found[0]
            continue
        if text[i]:
            out.append((lines[i][0], None, None, None, text[i]))
        i += 1
    return out


def drawn(rng, n, width=None, end="\n"):
    """Reads as text; qualities and names look like other lines, lengths repeat."""
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 4, 30, 75])
        seq, qual = "".join(rng.choice("ACGTN") for _ in range(size)), "".join(rng.choice("@+I!#") for _ in range(size))
        cut = (lambda s: textwrap.wrap(s, width) if s else [""]) if width else lambda s: [s]
        out.append(end.join([f"@{rng.choice([f'r{i}', 'ACGT', '+', ''])}", *cut(seq), "+", *cut(qual), ""]))
    return out


def damaged(rng, records):
    """Some records lose, repeat or swap lines, or have other text between them."""
    out = []
    for record in records:
        lines = record.splitlines(keepends=True)
        kind = rng.random()
        if kind < 0.1:
            del lines[rng.randrange(len(lines))]
        elif kind < 0.2:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["junk\n", "\n", "@x\n", "+\n", "ACGT\n", "@x\r\n"]))
        elif kind < 0.25:
            rng.shuffle(lines)
        out += lines
    data = "".join(out)
    return data[: -rng.randint(1, 9)] if rng.random() < 0.3 else data


def read(path, split, mode="permissive", wrapped=False, columns=ALL, most=None):
    reader = S.FastqReader(str(path), split, list(columns), most, mode, wrapped)
    return [[r for batch in reader.read(p) for r in zip(*(c.to_pylist() for c in batch.columns))] for p in reader.partitions()]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
@pytest.mark.parametrize("wrapped", [False, True])
def test_damage_at_every_split(tmp_path, monkeypatch, block, wrapped):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(lenient, "BACK", 40)
    rng = random.Random(block)
    for trial in range(30):
        data = damaged(rng, drawn(rng, rng.randint(0, 25), rng.choice([4, 30, 60]) if wrapped else None, rng.choice(["\n", "\r\n"])))
        (tmp_path / "x.fastq").write_text(data, newline="")
        want = plain_reading(data, wrapped)
        for split in {1, 3, 10, 41, 97, 300, 10_000, rng.randint(1, 200)}:
            if split < 10 and trial % 10:
                continue
            assert [r for part in read(tmp_path / "x.fastq", split, wrapped=wrapped) for r in part] == want, (trial, split)
        good = [r for r in want if r[4] is None]
        assert [r for part in read(tmp_path / "x.fastq", 50, "dropmalformed", wrapped) for r in part] == good
        if len(good) < len(want):
            with pytest.raises(ValueError, match=f"x.fastq: no FASTQ record at {want[[r[4] is None for r in want].index(False)][0]}$"):
                read(tmp_path / "x.fastq", 1 << 20, "failfast", wrapped)


@pytest.mark.parametrize("wrapped", [False, True])
def test_compressed_files_have_the_same_rows(tmp_path, monkeypatch, wrapped):
    monkeypatch.setattr(S, "BLOCK", 100)
    monkeypatch.setattr(lenient, "BACK", 60)
    rng = random.Random(8)
    for _ in range(15):
        data = damaged(rng, drawn(rng, rng.randint(1, 40), 40 if wrapped else None))
        want = [r[1:] for r in plain_reading(data, wrapped)]
        packed = bgzf.pack(data.encode(), rng.choice([9, 40, 200, 60_000]))
        (tmp_path / "x.fastq.gz").write_bytes(packed)
        for split in {1000, 77, 29, len(packed), rng.randint(20, 500)}:
            got = [r for part in read(tmp_path / "x.fastq.gz", split, wrapped=wrapped) for r in part]
            assert [r[1:] for r in got] == want
            assert [r[0] for r in got] == sorted({r[0] for r in got})
        (tmp_path / "y.fastq.gz").write_bytes(gzip.compress(data.encode()))
        assert read(tmp_path / "y.fastq.gz", 50, wrapped=wrapped) == [[(i, *r) for i, r in enumerate(want)]]


def test_whole_files_read_as_before(tmp_path):
    rng = random.Random(9)
    data = "".join(drawn(rng, 500))
    (tmp_path / "x.fastq").write_text(data)
    strict = [r for part in read(tmp_path / "x.fastq", 333, "failfast", columns=ALL[:4]) for r in part]
    assert [r for part in read(tmp_path / "x.fastq", 333, columns=ALL[:4]) for r in part] == strict
    assert read(tmp_path / "x.fastq", 50, most=7) == [[(*r, None) for r in strict[:7]]]


def test_long_wrapped_record(tmp_path):
    """A record longer than many ranges and than what is read before them."""
    rows = "".join(f"@{name}\n" + "ACGTACGTAC\n" * n + "+\n" + "@IIIIIIII+\n" * n for name, n in (("a", 3), ("b", 20_000), ("c", 5), ("d", 2)))
    (tmp_path / "x.fastq").write_text(rows)
    parts = read(tmp_path / "x.fastq", 20_000, wrapped=True)
    assert [(r[1], len(r[2]), len(r[3])) for part in parts for r in part] == [("a", 30, 30), ("b", 200_000, 200_000), ("c", 50, 50), ("d", 20, 20)]


def test_through_spark(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a\nAC\nGT\n+\nII\nII\nlost\n@b\nA\n+\nI\n")
    path = str(tmp_path / "x.fastq")
    got = S.read_fastq(spark, path, columns=("id", "seq", "corrupt"), mode="permissive", multiline=True, split_bytes=5).collect()
    assert [tuple(r) for r in got] == [("a", "ACGT", None), (None, None, "lost"), ("b", "A", None)]
    assert S.read_fastq(spark, path, columns=("seq",), mode="dropmalformed").collect() == [("A",)]
    with pytest.raises(Exception, match="no FASTQ record at 17"):
        S.read_fastq(spark, path, multiline=True).collect()
    with pytest.raises(Exception, match="mode is one of"):
        S.read_fastq(spark, path, mode="lax").collect()
