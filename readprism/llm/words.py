"""Hashes of words and word windows, by NumPy, over the raw bytes of Arrow strings.

Words are the runs of bytes outside ``{0x20, 0x09-0x0D}``; as these bytes are all
ASCII, that is the same as ``[^\\x20\\x09-\\x0D]+`` on the decoded text. Texts are
worked through in pieces of about ``PIECE`` bytes, cut between words, so memory
stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[:128] = [not chr(c).isalnum() for c in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.random.default_rng(0xC0FFEE).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column.buffers()[2]) else np.zeros(0, np.uint8)
    if column.null_count:
        # A null may still span bytes in the buffer: give it none.
        keep = np.asarray(column.is_valid())
        sizes = np.where(keep, np.diff(offsets), 0)
        if (sizes != np.diff(offsets)).any():
            data = np.concatenate([data[a:b] for a, b, k in zip(offsets[:-1], offsets[1:], keep) if k] or [np.zeros(0, np.uint8)])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data, offsets


def _piece_hashes(data: np.ndarray, breaks: np.ndarray, space: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in ``data``; no word spans a position in ``breaks``.

    With ``prefixes``, hashes has a column for the word and one for each prefix
    of so many bytes; of a word no longer than that, the column has the word again.
    """
    word = ~space[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
    sizes = ends - starts
    at = np.flatnonzero(word)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = np.full(int(sizes.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = _BYTE[data[at]] * powers[place]
    first = np.cumsum(sizes) - sizes
    whole = mix(np.add.reduceat(values, first) + sizes.astype(np.uint64) * _STEPS[63])
    if not prefixes:
        return starts, whole
    out = np.repeat(whole[:, None], 1 + len(prefixes), axis=1)
    ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    for i, n in enumerate(prefixes):
        long = np.flatnonzero(sizes > n)
        out[long, 1 + i] = mix(ahead[first[long] + n] - ahead[first[long]] + np.full(1, n, np.uint64) * _STEPS[62])
    return starts, out


def word_hashes(column: pa.Array, *, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all rows, bounds): row i's words are ``hashes[bounds[i]:bounds[i + 1]]``."""
    data, offsets = string_bytes(column)
    return _hashes(data, offsets, _SPACE, LOWER if lower else None)


def plain_word_hashes(column: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Like ``word_hashes`` for words without punctuation, in Unicode lower case.

    What separates: ASCII other than letters and digits, and the punctuation and
    spaces of U+0080-U+00BF, U+2000-U+206F and U+3000-U+303F.
    """
    data, offsets = string_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    data = data.copy()
    for lead, second, width in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80, 0x80), 3)):
        at = np.flatnonzero(data == lead)
        if second:
            at = at[(data[np.minimum(at + 1, len(data) - 1)] >= second[0]) & (data[np.minimum(at + 1, len(data) - 1)] <= second[1])]
        for j in range(width):
            data[at + j] = 0x20
    return _hashes(data, offsets, _PUNCTUATION, None, prefixes)


def _hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, change: np.ndarray | None, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = int(offsets[0]), int(offsets[-1])
    starts, hashes, at = [], [], lo
    while at < hi:
        cut = min(hi, at + PIECE)
        while cut < hi and not space[data[cut]] and not space[data[cut - 1]]:
            # Move on to the next white space or row start, whichever is first.
            gap = np.flatnonzero(space[data[cut : cut + 4096]])
            row = int(offsets[np.searchsorted(offsets, cut)])
            cut = min(cut + (int(gap[0]) if len(gap) else 4096), row, hi)
            if cut == row or len(gap):
                break
        piece = data[at:cut]
        s, h = _piece_hashes(piece if change is None else change[piece], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, cut)] - at, space, prefixes)
        starts.append(s + at)
        hashes.append(h)
        at = cut
    all_starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    none = np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
    return (np.concatenate(hashes) if hashes else none), np.searchsorted(all_starts, offsets)


def split_hashes(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, whose bytes in ``space`` separate them."""
    return _hashes(data, np.array([0, len(data)]), space, None)[0]


def hash_windows(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of the ``k`` values from each on; ``seed`` and ``k`` tell kinds of windows apart."""
    count = max(len(hashes) - k + 1, 0)
    sums = np.full(count, np.uint64(seed) ^ _STEPS[32 + k])
    for j in range(k):
        sums += hashes[j : count + j] * _STEPS[j]
    return mix(sums)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int, *, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each row's windows of ``k`` words; ``short``: a row of 1 to k-1 words is one window."""
    n = len(hashes)
    sizes = np.diff(bounds)
    counts = np.maximum(sizes - k + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(np.where(short & (sizes > 0) & (counts == 0), 1, counts))])
    sums = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        sums += hashes[j : n - k + 1 + j] * _STEPS[j] if len(sums) else 0
    sums = mix(sums)
    rows = np.flatnonzero(counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows]) + np.repeat(bounds[:-1][rows], counts[rows])
    if not short:
        return sums[at], out_bounds
    out = np.empty(int(out_bounds[-1]), np.uint64)
    few = np.flatnonzero((sizes > 0) & (counts == 0))
    whole = np.ones(len(out), bool)
    whole[out_bounds[:-1][few]] = False
    out[whole] = sums[at]
    for i in few:
        own = hashes[bounds[i] : bounds[i + 1]]
        sized = np.append(own * _STEPS[: len(own)], np.full(1, len(own), np.uint64) * _STEPS[62])
        out[out_bounds[i]] = mix(sized.sum(dtype=np.uint64, keepdims=True))[0]
    return out, out_bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, with their bounds."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(bounds)))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``limit`` bytes of text, or one row."""
    for batch in batches:
        _, offsets = string_bytes(batch.column(text))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def list_array(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def fixed_binary(values: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * values.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())
