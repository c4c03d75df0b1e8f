"""Histograms of reads by position, word, adapter, quality and length, in one pass.

Spark deals out the reads; each task folds its Arrow batches into counts with
NumPy, in time linear in the bases, and returns one row for each value it has
seen. Those partial counts are summed after one small shuffle. Keys below ``HELD``
are counted in one array for each kind; of other keys, a task keeps at most about
``HELD`` of a kind at a time, and beyond that they are passed on early. A
batch is worked through in pieces of about ``PIECE`` bases or one read. So a task's
memory depends on neither the number of reads nor that of its batches.

Reads are ASCII. A position without a quality (a short or null quality text)
counts as quality 0; the mean quality of a null text is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprism.functions import bases as B

LETTERS = "ACGTN*"
K = 7
BINS = 10
PIECE = 1 << 18
HELD = 1 << 18
KINDS = ("position", "quality", "length", "adapter", "kmer")
#: What the modules of short and of long reads need.
SHORT_KINDS, LONG_KINDS = (*KINDS, "gc", "strong"), ("quality", "length", "gc", "strong", "n", "holds")
_SCHEMA = "kind string, a int, b int, c int, cnt long"
_CLASS = np.full(256, LETTERS.index("*"), np.int64)
_CLASS[np.frombuffer(b"ACGTN", np.uint8)] = np.arange(5)
#: Values of b and c by kind, that a, b and c make one key.
_RADIX = {"position": (len(LETTERS), B.MAX_Q + 1), **dict.fromkeys(("quality", "length", "gc", "strong", "n", "holds"), (1, 1)), "base": (len(LETTERS), 1), "adapter": (len(B.ADAPTERS), 1), "kmer": (BINS, 1)}
#: Kinds that look at qualities.
_OF_QUALITY = {"position", "quality"}


class _Counts:
    """Counts of integer keys of one kind."""

    def __init__(self, kind: str):
        self.kind, self.parts, self.size = kind, [], 0
        self.small = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        if len(keys) and (keys.min() < 0 or keys.max() >= HELD):
            small = (keys >= 0) & (keys < HELD)
            self._add_others(keys[~small])
            keys = keys[small]
        counts = np.bincount(keys)
        if len(counts) > len(self.small):
            self.small = np.concatenate([self.small, np.zeros(len(counts) - len(self.small), np.int64)])
        self.small[: len(counts)] += counts

    def _add_others(self, keys: np.ndarray) -> None:
        top = int(keys.max()) + 1
        if keys.min() >= 0 and top <= 8 * len(keys):
            counts = np.bincount(keys, minlength=top)
            used = np.flatnonzero(counts)
            counts = counts[used]
        else:
            used, counts = np.unique(keys, return_counts=True)
        self.parts.append((used, counts))
        self.size += len(used)
        if self.size > HELD:
            self.fold()

    def fold(self) -> None:
        used, place = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        self.parts, self.size = [(used, np.bincount(place, np.concatenate([p[1] for p in self.parts])).astype(np.int64))], len(used)

    def rows(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.small)
        self.parts.append((used, self.small[used]))
        self.fold()
        (used, counts), (nb, nc) = self.parts[0], _RADIX[self.kind]
        columns = [used // (nb * nc), used // nc % nb, used % nc]
        known = pa.array(columns[0].astype(np.int32), mask=used < 0)
        self.parts, self.size, self.small = [], 0, np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([self.kind] * len(used)), known, *[pa.array(c.astype(np.int32)) for c in columns[1:]], pa.array(counts)], ["kind", "a", "b", "c", "cnt"])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0); nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    _, offsets = text_bytes(batch.column("seq"))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _qualities(batch: pa.RecordBatch, offsets: np.ndarray, place: np.ndarray, offset: int) -> np.ndarray:
    """The quality of each base, from 0 to ``MAX_Q``."""
    data, bounds = text_bytes(batch.column("qual"))
    if not np.array_equal(bounds, offsets):
        sizes, row = np.diff(bounds), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        given = place < sizes[row]
        found = np.zeros(len(place), np.int64)
        found[given] = data[(bounds[:-1][row] + place)[given]]
    else:
        found = data.astype(np.int64)
    return np.clip(found - offset, 0, B.MAX_Q)


def _mean_qualities(column: pa.Array, n: np.ndarray, offset: int) -> np.ndarray:
    """Rounded mean qualities, halves up; -1 for a null text."""
    data, bounds = text_bytes(column)
    sums = np.concatenate([[0], np.cumsum(np.maximum(data.astype(np.int64) - offset, 0))])
    means = np.minimum((np.diff(sums[bounds]) + n // 2) // n, B.MAX_Q)
    return np.where(np.asarray(column.is_valid()), means, -1)


def _kmer_keys(code: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """code * BINS + bin of every window of K bases of A, C, G and T that lies in one read."""
    m = len(code) - K + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    fine = np.flatnonzero((bad[K:] == bad[:m]) & (place[:m] + K <= n[:m]))
    word = np.zeros(m, np.int64)
    for j in range(K):
        word = (word << 2) | (code[j : j + m] & 3)
    return word[fine] * BINS + np.minimum((place[fine] + 1) * BINS // n[fine], BINS - 1)


class Folder:
    """Counts of one task's reads (seq, qual), folded batch by batch."""

    def __init__(self, offset: int, kinds: tuple[str, ...]):
        self.offset, self.pattern = offset, re.compile("|".join(f"({a})" for a in B.ADAPTERS))
        self.by_base = bool({"position", "base", "kmer", "gc", "strong", "n"} & set(kinds))
        self.held = {kind: _Counts(kind) for kind in kinds}

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Count a batch; yields what has grown too large to keep."""
        held = self.held
        for piece in _pieces(batch):
            data, offsets = text_bytes(piece.column("seq"))
            sizes = np.diff(offsets)
            if self.by_base:
                place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
                code = _CLASS[data]
            if "position" in held:
                quality = _qualities(piece, offsets, place, self.offset)
                held["position"].add(((place + 1) * len(LETTERS) + code) * (B.MAX_Q + 1) + quality)
            if "base" in held:
                held["base"].add((place + 1) * len(LETTERS) + code)
            if "kmer" in held:
                held["kmer"].add(_kmer_keys(code, place, np.repeat(sizes, sizes)))
            if "quality" in held:
                held["quality"].add(_mean_qualities(piece.column("qual"), sizes, self.offset))
            if "length" in held:
                held["length"].add(sizes)
            if {"gc", "strong"} & set(held):
                strong = _of_each((code == 1) | (code == 2), offsets)
                if "gc" in held:
                    held["gc"].add(_percents(strong, sizes))
                if "strong" in held:
                    held["strong"].add(strong)
            if "n" in held:
                held["n"].add(_percents(_of_each(code == LETTERS.index("N"), offsets), sizes))
            if "holds" in held:
                found = [pc.sum(pc.match_substring(piece.column("seq"), a)).as_py() or 0 for a in B.ADAPTERS]
                held["holds"].add(np.repeat(np.arange(len(B.ADAPTERS)), found))
            if "adapter" in held:
                some = piece.column("seq").filter(pc.match_substring_regex(piece.column("seq"), self.pattern.pattern)).to_pylist()
                held["adapter"].add(np.array([(m.start() + 1) * len(B.ADAPTERS) + m.lastindex - 1 for s in some for m in self.pattern.finditer(s)], np.int64))
            yield from (c.rows() for c in held.values() if c.size > HELD)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from (c.rows() for c in self.held.values() if c.size or len(c.small))


def _of_each(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bases of each read are marked."""
    ahead = np.concatenate([[0], np.cumsum(marks)])
    return ahead[offsets[1:]] - ahead[offsets[:-1]]


def _percents(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Rounded percents, halves up."""
    return np.minimum((100 * part + whole // 2) // whole, 100)


def fold(batches: Iterable[pa.RecordBatch], offset: int, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one task's batches (seq, and qual if the kinds need it)."""
    folder = Folder(offset, kinds)
    for batch in batches:
        yield from folder.add(batch)
    yield from folder.rest()


def columns(kinds: Iterable[str]) -> list[str]:
    """What a pass for ``kinds`` reads of each read."""
    return ["seq", "qual"] if _OF_QUALITY & set(kinds) else ["seq"]


def tallies(reads: DataFrame, offset: int = 33, kinds: Iterable[str] = KINDS) -> DataFrame:
    """(kind, a, b, c, cnt) over prepared reads (seq, qual).

    position: a base number, b letter (of ``LETTERS``), c quality; base: the same without qualities; quality: a mean
    quality of a read; length: a; gc, n: a rounded percent of a read; strong: the number
    of G and C of a read; holds: an adapter that a read holds; adapter: a start, b adapter (leftmost first,
    without overlaps); kmer: a word in base 4, b tenth of the read.
    """
    kinds = tuple(kinds)
    return reads.select(*columns(kinds)).mapInArrow(lambda batches: fold(batches, offset, kinds), _SCHEMA).groupBy("kind", "a", "b", "c").agg(F.sum("cnt").alias("cnt"))


def of_kind(table: DataFrame, kind: str) -> DataFrame:
    return table.where(F.col("kind") == kind)
