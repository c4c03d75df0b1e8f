"""FASTQ files as DataFrames of (read_idx, id, seq, qual).

``register(spark)`` adds the data source ``fastq``. Plain files and block-gzip files
are read in byte ranges that resynchronise on record starts, so many tasks read one
large file; other gzip files can't be split and are one task each (repartition
after it). A task reads blocks of bytes and cuts them into columns by the places of
their line ends, without a step for each line in Python.

``read_idx`` orders the reads of a file: the record's byte offset; for block gzip
the block's offset << 16, plus the place in the block; for other gzip the record's number.

Options: ``columns``, of (read_idx, id, seq, qual, file, corrupt), in the order wanted: what is
not asked for never leaves the reader (a schema given to ``spark.read`` does the
same); ``splitbytes``, the size of a byte range; ``records``, to read only so many
records from the start, in one task that stops there; ``multiline``, for bases and
qualities that are wrapped over several lines; ``mode``, what damage does: with
``failfast`` (the default) it raises, with ``permissive`` each damaged line is a row,
with nulls and its text in the column ``corrupt`` if that is asked for, and with
``dropmalformed`` it gives no row. ``sources.lenient`` has the rules for wrapped records
and for what is read after damage.

A record is four lines. Line ends may be CRLF, and the last may be missing. A
header without ``@``, a third line without ``+``, bases and qualities of different
lengths and a record that is cut off raise ``ValueError`` with file and position.
Empty lines may stand at the end of a file. Bytes are read as Latin-1.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from readprism.sources import bgzf

SPLIT_BYTES = 128 << 20
COLUMNS = ("read_idx", "id", "seq", "qual")
FILE = "file"
CORRUPT = "corrupt"
MODES = ("failfast", "permissive", "dropmalformed")
BLOCK = 4 << 20
_ROWS = 8192
_LINES = 4
_FAR = 1 << 62


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        # Spark's names of local files are not encoded as a URI's.
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def open_file(path: str) -> pa.NativeFile:
    store, name = _filesystem(path)
    return store.open_input_file(name)


def input_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the FASTQ files of a folder in order of name."""
    store, name = _filesystem(path)
    info = store.get_file_info(name)
    prefix = path[: len(path) - len(name)] if "://" in path and path.endswith(name) else ""
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.File and ".f" in i.base_name]
    return [(prefix + i.path, i.size) for i in sorted(found, key=lambda i: i.path)]


class Range(InputPartition):
    """Records of one kind of file (plain, blocks, gzip) that belong to the bytes ``[start, end)``, or the first ``most`` of several whole files."""

    def __init__(self, files: list[tuple[str, str]], start: int = 0, end: int | None = None, most: int | None = None):
        super().__init__((files, start, end, most))
        self.files, self.start, self.end, self.most = files, start, end, most


class _Bytes:
    """A file's content from some place on, in chunks.

    ``limit``: records that start at this place of the content or beyond it belong
    to the next range; unknown until the range's own bytes have been read. ``lower``:
    those before this place belong to the range before, where the content begins early.
    ``number`` gives the ``read_idx`` of places in the content.
    """

    limit = _FAR
    lower = 0

    def __init__(self, mid: bool):
        #: Whether the content begins within a record, perhaps.
        self.mid = mid
        self.read = 0

    def number(self, places: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class _Plain(_Bytes):
    def __init__(self, file, start: int, end: int | None, begin: int | None = None):
        begin = start if begin is None else begin
        super().__init__(begin > 0)
        # The byte before tells whether a line begins at the range's first byte.
        self.file, self.first = file, max(0, begin - 1)
        self.lower = start - self.first
        self.limit = _FAR if end is None else end - self.first

    def chunks(self) -> Iterator[bytes]:
        self.file.seek(self.first)
        while data := self.file.read(BLOCK):
            yield data

    def number(self, places: np.ndarray) -> np.ndarray:
        return places + self.first


class _Blocks(_Bytes):
    """A record belongs to the range that has the block with the line end before it."""

    def __init__(self, file, start: int, end: int | None, name: str, begin: int | None = None):
        self.begin = start if begin is None else begin
        super().__init__(self.begin > 0)
        self.file, self.start, self.end, self.name = file, start, end, name
        self.places, self.offsets = [], []
        self.lower = _FAR if start else 0

    def chunks(self) -> Iterator[bytes]:
        held, size = [], 0
        for offset, data in bgzf.members(self.file, self.begin, self.end, self.name):
            if self.lower == _FAR and offset >= self.start:
                self.lower = self.read + size + 1
            if self.limit == _FAR and self.end is not None and offset >= self.end:
                self.limit = self.read + size + 1
            self.places.append(self.read + size)
            self.offsets.append(offset)
            held.append(data)
            size += len(data)
            if size >= BLOCK or self.limit < _FAR:
                self.read += size
                yield b"".join(held)
                held, size = [], 0
        if self.limit == _FAR and self.end is not None:
            self.limit = self.read + size + 1
        if size:
            yield b"".join(held)

    def number(self, places: np.ndarray) -> np.ndarray:
        starts, offsets = np.array(self.places, np.int64), np.array(self.offsets, np.int64)
        at = np.searchsorted(starts, places, side="right") - 1
        return (offsets[at] << 16) + places - starts[at]


class _Gzip(_Bytes):
    def __init__(self, file, name: str):
        super().__init__(False)
        self.file, self.name, self.count = file, name, 0

    def chunks(self) -> Iterator[bytes]:
        coder = None
        try:
            while packed := self.file.read(BLOCK):
                while packed := packed if coder else packed.lstrip(b"\0"):
                    coder = coder or zlib.decompressobj(31)
                    yield coder.decompress(packed)
                    packed, coder = coder.unused_data, None if coder.eof else coder
        except zlib.error as error:
            raise ValueError(f"{self.name}: {error}") from None
        if coder:
            raise ValueError(f"{self.name}: the compressed data is cut off")

    def number(self, places: np.ndarray) -> np.ndarray:
        self.count += len(places)
        return np.arange(self.count - len(places), self.count)


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends without line ends, starts of the next lines) of the whole lines of ``data``."""
    after = np.flatnonzero(data == 10) + 1
    starts = np.concatenate([[0], after[:-1]]) if len(after) else after
    ends = after - 1
    returns = (ends > starts) & (data[np.maximum(ends - 1, 0)] == 13)
    return starts, ends - returns, after


def _resync(data: np.ndarray) -> int:
    """Where the first record begins after the first line end of ``data``; -1 if its four lines aren't all there.

    A quality line may begin with ``@`` too, but the second line after it is bases.
    """
    starts, ends, _ = _lines(data)
    starts, sizes = starts[1:], (ends - starts)[1:]
    n = len(starts) - _LINES + 1
    if n <= 0:
        return -1
    letters = data[np.minimum(starts, len(data) - 1)]
    fits = (letters[:n] == ord("@")) & (letters[2 : n + 2] == ord("+")) & (sizes[1 : n + 1] == sizes[3 : n + 3]) & (sizes[:n] > 0) & (sizes[2 : n + 2] > 0)
    found = np.flatnonzero(fits)
    return int(starts[found[0]]) if len(found) else -1


class _Cutter:
    """Cuts content into columns."""

    def __init__(self, source: _Bytes, name: str, columns: list[str], most: int | None = None):
        self.source, self.name, self.columns, self.left = source, name, columns, _FAR if most is None else most

    def batches(self) -> Iterator[pa.RecordBatch]:
        held, base, waiting = b"", 0, []
        synced, size, wanted = not self.source.mid, 0, 1
        for chunk in self.source.chunks():
            # What is held back may be most of a very long record: join only as often as its size doubles.
            waiting.append(chunk)
            size += len(chunk)
            if size < wanted:
                continue
            held, waiting = b"".join([held, *waiting]), []
            if not synced:
                at = _resync(np.frombuffer(held, np.uint8))
                if at < 0:
                    # Nothing of this range is left to find once its bytes are passed by a record's lines.
                    if base + held.find(b"\n") + 1 >= self.source.limit:
                        return
                    wanted, size = 2 * len(held), len(held)
                    continue
                held, base, synced = held[at:], base + at, True
            used = yield from self._cut(held, base, False)
            if used < 0:
                return
            held, base = held[used:], base + used
            wanted, size = max(1, 2 * len(held)) if not used else 1, len(held)
        held = b"".join([held, *waiting])
        if not synced:
            held += b"" if held.endswith(b"\n") else b"\n"
            at = _resync(np.frombuffer(held, np.uint8))
            if at < 0:
                return
            held, base = held[at:], base + at
        if held:
            yield from self._cut(held if held.endswith(b"\n") else held + b"\n", base, True)

    def _cut(self, held: bytes, base: int, last: bool) -> Iterator[pa.RecordBatch]:
        """Yields the records of whole lines; returns how many bytes they took, or -1 if nothing after them belongs here."""
        data = np.frombuffer(held, np.uint8)
        starts, ends, after = _lines(data)
        if last:
            # Empty lines at the end are no record.
            used = np.flatnonzero(ends > starts)
            whole = int(used[-1]) + 1 if len(used) else 0
            n = -(-whole // _LINES)
            if n * _LINES > len(starts):
                if base + int(starts[(n - 1) * _LINES]) < self.source.limit and n <= self.left:
                    raise ValueError(f"{self.name}: the record at {base + int(starts[(n - 1) * _LINES])} is cut off")
                n -= 1
        else:
            n = len(starts) // _LINES
        heads = starts[: n * _LINES : _LINES]
        own = min(int(np.searchsorted(heads, self.source.limit - base)), self.left)
        done = own < n
        n, self.left = own, self.left - own
        starts, ends = starts[: n * _LINES].copy(), ends[: n * _LINES]
        if n:
            sizes = ends - starts
            bad = (sizes[0::4] == 0) | (data[starts[0::4]] != ord("@")) | (sizes[2::4] == 0) | (data[starts[2::4]] != ord("+")) | (sizes[1::4] != sizes[3::4])
            good = int(np.argmax(bad)) if bad.any() else n
            numbers = self.source.number(base + starts[: 4 * good : 4])
            starts[0::4] += 1
            for a in range(0, good, _ROWS):
                yield self._batch(held, starts[4 * a : 4 * min(good, a + _ROWS)], ends[4 * a : 4 * min(good, a + _ROWS)], numbers[a : a + _ROWS])
            if good < n:
                raise ValueError(f"{self.name}: no FASTQ record at {base + int(starts[4 * good]) - 1}")
        used = int(after[n * _LINES - 1]) if n else 0
        return -1 if done or not self.left or base + used >= self.source.limit else used

    def _batch(self, held: bytes, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        lo, hi = int(starts[0]), int(ends[-1])
        # Lines and what lies between them take turns, as one string array over the bytes themselves.
        edges = np.empty(2 * len(starts) + 1, np.int32)
        edges[0:-1:2], edges[1:-1:2], edges[-1] = starts - lo, ends - lo, hi - lo
        view = memoryview(held)[lo:hi]
        turns = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(view)])
        ascii_only = not (np.frombuffer(view, np.uint8) > 127).any() if hi > lo else True
        columns = []
        for name in self.columns:
            if name == "read_idx":
                columns.append(pa.array(numbers, pa.int64()))
            elif name == FILE:
                columns.append(pa.array([self.name] * len(numbers), pa.string()))
            else:
                part = turns.take(pa.array(np.arange({"id": 0, "seq": 2, "qual": 6}[name], len(turns), 8)))
                columns.append(part.view(pa.string()) if ascii_only else pa.array([x.decode("latin-1") for x in part.to_pylist()], pa.string()))
        return pa.RecordBatch.from_arrays(columns, self.columns)


def file_kind(file) -> str:
    """plain, blocks (block gzip) or gzip, by the first bytes of an open file."""
    file.seek(0)
    head = file.read(64)
    file.seek(0)
    if head[:2] != b"\x1f\x8b":
        return "plain"
    return "blocks" if bgzf.member_size(head) else "gzip"


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int, columns: list[str], most: int | None = None, mode: str = "failfast", multiline: bool = False):
        self.path, self.split, self.columns, self.most = path, max(1, split), columns, most
        self.mode, self.multiline = mode, multiline

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        whole = []
        for path, size in input_files(self.path):
            with open_file(path) as f:
                kind = file_kind(f)
            whole.append((path, kind))
            if kind == "gzip" or not size:
                out.append(Range([(path, kind)]))
            else:
                out += [Range([(path, kind)], a, min(size, a + self.split)) for a in range(0, size, self.split)]
        return out if self.most is None else [Range(whole, most=self.most)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        left = partition.most
        for path, kind in partition.files:
            with open_file(path) as file:
                for batch in self._batches(file, path, kind, partition, left):
                    left = None if left is None else left - len(batch)
                    yield batch
            if left == 0:
                return

    def _batches(self, file, path: str, kind: str, partition: Range, left: int | None) -> Iterator[pa.RecordBatch]:
        def source(begin: int) -> _Bytes:
            if kind == "plain":
                return _Plain(file, partition.start, partition.end, begin)
            if kind == "blocks":
                return _Blocks(file, partition.start, partition.end, path, begin)
            file.seek(0)
            return _Gzip(file, path)

        if self.mode == "failfast" and not self.multiline and CORRUPT not in self.columns:
            return _Cutter(source(partition.start), path, self.columns, left).batches()
        from readprism.sources import lenient

        return lenient.batches(source, partition.start, path, self.columns, self.mode, self.multiline, left)


def _check(names: list[str]) -> None:
    if not set(names) <= {*COLUMNS, FILE, CORRUPT}:
        raise ValueError(f"columns are some of {', '.join(COLUMNS)}, {FILE} and {CORRUPT}")


class FastqDataSource(DataSource):
    """``spark.read.format("fastq").load(path)``; see the module for options."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> StructType:
        names = [c.strip() for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]
        _check(names)
        return StructType([StructField(c, LongType() if c == "read_idx" else StringType()) for c in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        _check(schema.names)
        most, mode = self.options.get("records"), self.options.get("mode", "failfast").lower()
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        return FastqReader(self.options["path"], split, schema.names, None if most is None else int(most), mode, self.options.get("multiline", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqDataSource)


def read_fastq(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES, columns: tuple[str, ...] = COLUMNS, records: int | None = None, mode: str = "failfast", multiline: bool = False) -> DataFrame:
    """Reads of a FASTQ file, compressed or not, or of a folder of them; ``records``: only the first so many, by one task; see the module for ``mode`` and ``multiline``."""
    if path in ("-", "/dev/stdin"):
        raise ValueError("reading from standard input is not supported")
    register(spark)
    reader = spark.read.format("fastq").option("splitbytes", str(split_bytes)).option("columns", ",".join(columns)).option("mode", mode).option("multiline", str(multiline).lower())
    return (reader if records is None else reader.option("records", str(records))).load(path)


def write_fastq(reads: DataFrame, path: str, *, gzipped: bool = False) -> None:
    """Write (id, seq, qual) as FASTQ part files by Spark's text sink."""
    from pyspark.sql import functions as F

    lines = reads.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual"))
    lines.write.option("compression", "gzip" if gzipped else "none").text(path)
