"""FASTQ with wrapped records, and files with damage, at any split.

The content is scanned line by line from the file's start, as it were: where a
record fits, it is taken and the scan goes on behind it; a line where none fits is
damaged, and the scan goes on with the next line. Empty lines that belong to no
record are passed over. So the rows are a property of the file, whatever its ranges.

Four-line records fit as in ``sources.fastq``. Wrapped ones (``multiline``) are a
header with ``@``, any number of lines of bases (letters, ``*``, ``.``, ``-``), a line
with ``+``, and lines of qualities until there are as many as bases; if the last of
them has too many, the record does not fit. Without bases, one empty line of
qualities may follow. A record doesn't fit either if its qualities hold two others
that adjoin and have bases: after a loss of lines, qualities would swallow reads.

A range begins its scan before its first byte, where it knows the scan to come
along. For four-line records: the scan never steps over four lines in a row without
a stop, so once the scans from four neighbouring lines have met, the file's own scan
is at that place too. For wrapped records the same holds of the lines of two records
that adjoin, since no record steps over those. If the scans don't meet before the
range, it begins earlier, at the file's start in the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from readprism.sources.fastq import _FAR, _LINES, _ROWS, CORRUPT, FILE, _Bytes, _lines

#: How far before a range its scan begins; four times as far each time that is too late to tell.
BACK = 64 << 10
_BASES = np.zeros(256, np.int64)
_BASES[list(b"*.-ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
#: A step that needs lines which are not read yet.
_MORE = (-1, -1)


class UnknownPlace(Exception):
    """The scan began too late to know where records begin."""


class _Text:
    """Whole lines of some content, and steps of the scan over them: (the next line, the line with ``+`` or -1 for damage)."""

    def __init__(self, held: bytes, last: bool, multiline: bool):
        data = np.frombuffer(held, np.uint8)
        self.held, self.last = held, last
        starts, ends, after = _lines(data)
        sizes = ends - starts
        letters = np.where(sizes > 0, data[np.minimum(starts, len(data) - 1)], 0) if len(data) else sizes
        self.n, self.starts, self.ends, self.after, self.sizes = len(starts), starts.tolist(), ends.tolist(), after.tolist(), sizes.tolist()
        self.step: Callable[[int], tuple[int, int]] = self._wrapped if multiline else self._four
        if multiline:
            known = np.concatenate([[0], np.cumsum(_BASES[data])])
            self.letters = letters.tolist()
            self.others = np.flatnonzero(known[ends] - known[starts] < sizes)
            self.total = np.concatenate([[0], np.cumsum(sizes)])
        else:
            k = max(0, self.n - _LINES + 1)
            self.fits = ((letters[:k] == ord("@")) & (letters[2 : k + 2] == ord("+")) & (sizes[1 : k + 1] == sizes[3 : k + 3])).tolist() if k else []

    def _four(self, i: int) -> tuple[int, int]:
        if i >= len(self.fits):
            return (i + 1, -1) if self.last else _MORE
        return (i + _LINES, i + 2) if self.fits[i] else (i + 1, -1)

    def _wrapped(self, i: int) -> tuple[int, int]:
        to, plus = self._alone(i)
        if plus >= 0 and any(self.pair(k, to) for k in range(plus + 1, to)):
            return i + 1, -1
        return to, plus

    def _alone(self, i: int) -> tuple[int, int]:
        """As a step, whatever the qualities hold."""
        if self.letters[i] != ord("@"):
            return i + 1, -1
        short = (i + 1, -1) if self.last else _MORE
        at = int(np.searchsorted(self.others, i + 1))
        if at == len(self.others):
            return short
        plus = int(self.others[at])
        if self.letters[plus] != ord("+"):
            return i + 1, -1
        bases = int(self.total[plus] - self.total[i + 1])
        if not bases:
            if plus + 1 == self.n:
                return (self.n, plus) if self.last else _MORE
            return plus + 1 + (not self.sizes[plus + 1]), plus
        wanted = self.total[plus + 1] + bases
        end = int(np.searchsorted(self.total, wanted))
        if end > self.n:
            return short
        return (end, plus) if self.total[end] == wanted else (i + 1, -1)

    def pair(self, k: int, end: int) -> int:
        """Where the second of two adjoining records with bases ends that begin at line ``k``, if not behind ``end``; else 0."""
        for _ in range(2):
            if k >= end or self.letters[k] != ord("@"):
                return 0
            to, plus = self._alone(k)
            if plus < 0 or to > end or self.total[plus] == self.total[k + 1]:
                return 0
            k = to
        return k

    def joined(self, a: int, b: int) -> str:
        """The lines ``a`` to ``b``, without line ends."""
        if b == a + 1:
            return self.held[self.starts[a] : self.ends[a]].decode("latin-1")
        return b"".join(self.held[self.starts[i] : self.ends[i]] for i in range(a, b)).decode("latin-1")


class Scan:
    """The rows of a range; ``source.lower`` to ``source.limit`` is where they begin."""

    def __init__(self, source: _Bytes, name: str, columns: list[str], mode: str, multiline: bool, most: int | None):
        self.source, self.name, self.columns, self.mode, self.multiline = source, name, columns, mode, multiline
        self.left = _FAR if most is None else most
        self.sure = not source.mid

    def batches(self) -> Iterator[pa.RecordBatch]:
        held, base, waiting, size, wanted, begun = b"", 0, [], 0, 1, not self.source.mid
        for chunk in self.source.chunks():
            waiting.append(chunk)
            size += len(chunk)
            if size < wanted:
                continue
            held, waiting = b"".join([held, *waiting]), []
            if not begun:
                at = held.find(b"\n") + 1
                if not at:
                    wanted, size = 2 * len(held), len(held)
                    continue
                held, base, begun = held[at:], base + at, True
            used = yield from self._scan(held, base, False)
            if used < 0:
                return
            held, base = held[used:], base + used
            wanted, size = max(1, 2 * len(held)) if not used else 1, len(held)
        held = b"".join([held, *waiting])
        if not begun:
            at = held.find(b"\n") + 1 or len(held)
            held, base = held[at:], base + at
        yield from self._scan(held if held.endswith(b"\n") or not held else held + b"\n", base, True)
        if not self.sure:
            raise UnknownPlace

    def _settle(self, text: _Text) -> int:
        """The first line that is known to be a stop of the file's scan; -1 if that takes more lines."""
        places = set(range(min(_LINES, text.n)))
        if self.multiline:
            first, end = next(((k, e) for k in range(text.n) if (e := text.pair(k, text.n))), (0, -1))
            if end < 0:
                return -1
            places = set(range(first, end + 1))
        while len(places) > 1 or not self.multiline and text.n < _LINES:
            i = min(places, default=text.n)
            if i >= text.n or (to := text.step(i)[0]) < 0:
                return -1
            places = places - {i} | {to}
        return places.pop()

    def _scan(self, held: bytes, base: int, last: bool) -> Iterator[pa.RecordBatch]:
        """Yields what begins in this range; returns how many bytes are done, or -1 if nothing after them belongs here."""
        text = _Text(held, last, self.multiline)
        i = 0
        if not self.sure:
            i = self._settle(text)
            if text.n and base + text.starts[i if 0 <= i < text.n else -1] > self.source.lower:
                raise UnknownPlace
            if not 0 <= i < text.n:
                return 0
            self.sure = True
        rows: list[tuple[int, int, int, int]] = []
        done = False
        while i < text.n:
            place = base + text.starts[i]
            if place >= self.source.limit or not self.left:
                done = True
                break
            to, plus = text.step(i)
            if to < 0:
                break
            if place >= self.source.lower and (plus >= 0 or text.sizes[i] and self.mode != "dropmalformed"):
                if plus < 0 and self.mode == "failfast":
                    yield from self._shaped(text, rows, base)
                    raise ValueError(f"{self.name}: no FASTQ record at {place}")
                rows.append((i, plus, to, place))
                self.left -= 1
            i = to
            if len(rows) == _ROWS:
                yield from self._shaped(text, rows, base)
                rows = []
        yield from self._shaped(text, rows, base)
        return -1 if done else text.after[i - 1] if i else 0

    def _shaped(self, text: _Text, rows: list[tuple[int, int, int, int]], base: int) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        makers = {
            "id": lambda i, plus, to: text.joined(i, i + 1)[1:] if plus >= 0 else None,
            "seq": lambda i, plus, to: text.joined(i + 1, plus) if plus >= 0 else None,
            "qual": lambda i, plus, to: text.joined(plus + 1, to) if plus >= 0 else None,
            CORRUPT: lambda i, plus, to: None if plus >= 0 else text.joined(i, i + 1),
            FILE: lambda i, plus, to: self.name,
        }
        numbers = self.source.number(np.array([r[3] for r in rows], np.int64))
        columns = [pa.array(numbers, pa.int64()) if c == "read_idx" else pa.array([makers[c](*r[:3]) for r in rows], pa.string()) for c in self.columns]
        yield pa.RecordBatch.from_arrays(columns, self.columns)


def batches(source: Callable[[int], _Bytes], start: int, name: str, columns: list[str], mode: str, multiline: bool, most: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of the range from ``start``; ``source`` opens its content from a place before it."""
    back = BACK
    while True:
        begin = max(0, start - back) if start else 0
        try:
            yield from Scan(source(begin), name, columns, mode, multiline, most).batches()
            return
        except UnknownPlace:
            # Only before the first row, and never from the file's start.
            back *= 4
