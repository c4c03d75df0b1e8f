"""Benchmark decontamination by spaced seeds.

A mask of ones and zeros (``SEEDS``) is laid over the words of a text at every
position; the hash of the words under its ones, with the mask's number, is a
seed there. Seeds of benchmark items and of documents are joined by equality. A
copy in which single words are replaced still has seeds in common wherever the
replaced words lie under zeros. The masks miss nothing: every stretch of at least
``SHORTEST`` equal words, three quarters of its words or more, has a seed of one of
them, wherever its other words are.

Items of fewer than ``SHORTEST`` words have one seed, their whole sequence: those
of ``FEW`` words or more are found wherever they stand whole and unchanged, shorter
ones where they are a whole document.

Around hits, within the length of the longest item, the words themselves are
compared, on every diagonal (position in the document minus position in the item)
with enough equal words. A document is contaminated by an item if a stretch has at
least ``min_words`` equal words (or ``min_share`` of a shorter item) and at least
``min_identity`` of its words are equal. The best-scoring stretch, ``match`` for equal
and ``mismatch`` for different words, is the overlap; if it is too short or too
different, the stretch with the most equal words among those of ``min_identity`` is.

At scale: a document's seeds are first held against a bitmap of fixed size built
from the benchmark's seeds, in the task that reads the text, and only what
passes leaves that task, as regions of word hashes around it. The bitmap only
saves work; the join of seeds is a join of two tables, whatever the benchmark's
size. It makes a row for each region and item that share seeds, however often they
do; words join those pairs afterwards. Texts are never shuffled.

Words are lower-cased runs without white space and punctuation
(``words.plain_word_hashes``). Defined results: null and empty texts or items have no seeds. Rows
with a null id take part and keep the null. Repeated rows are reported as one
(doc_id, item_id). Empty tables give empty results. Further columns, whatever their
names, are kept by ``decontaminate`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprism.llm import words as W
from readprism.llm.shared import Scratch, materialize

_U = np.uint64
SEEDS = ("111111", "1111011", "11101011", "11010111", "11111001", "100111011", "1100100111", "1110001011", "1101101001", "1010100111")
SPAN = max(map(len, SEEDS))
SHORTEST = 8
FEW = 5
FILTER_BITS = 27
SHIFTS = (0, FILTER_BITS)


@dataclass(frozen=True)
class Overlap:
    """When an overlap counts."""

    min_words: int = 13
    min_share: float = 0.7
    min_identity: float = 0.75
    match: int = 1
    mismatch: int = -2


def _spots(values: np.ndarray, shift: int) -> np.ndarray:
    """The bits of seeds in the bitmap; each seed has one for each of ``SHIFTS``."""
    return (values << _U(shift)) >> _U(64 - FILTER_BITS)


def _places(hashes: np.ndarray, bounds: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed values, positions) of one mask at every position where it fits into its row."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.full(n, number, np.uint64) * W._STEPS[61]
    for j, bit in enumerate(mask):
        if bit == "1":
            sums += hashes[j : j + n] * W._STEPS[j]
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(n) + len(mask) <= ends[:n])
    return W.mix(sums[at]), at


def seeds(hashes: np.ndarray, bounds: np.ndarray, whole: tuple[int, ...], *, items: bool = False, bitmap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(seed values, positions of their first words) of all rows, or those that pass the bitmap; windows don't span rows.

    ``whole`` has the lengths of short items. Of ``items``, short ones have only
    their whole sequence and others only the masks' seeds.
    """
    size = np.repeat(np.diff(bounds), np.diff(bounds))
    values, places = [], []
    for number, mask in [*((i + 1, mask) for i, mask in enumerate(SEEDS)), *((100 + w, "1" * w) for w in whole)]:
        found, at = _places(hashes, bounds, mask, number)
        if number > 100 and (items or len(mask) < FEW):
            keep = size[at] == len(mask)
        else:
            keep = size[at] >= (SHORTEST if items else 0)
        found, at = found[keep], at[keep]
        for shift in SHIFTS if bitmap is not None else ():
            spot = _spots(found, shift)
            keep = np.flatnonzero((bitmap[(spot >> _U(3)).astype(np.int64)] >> (spot & _U(7)).astype(np.uint8)) & 1)
            found, at = found[keep], at[keep]
        values.append(found)
        places.append(at)
    return np.concatenate(values), np.concatenate(places)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, words, seeds array<long>) of each benchmark item with words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            hashes, bounds = W.plain_word_hashes(batch.column("text"))
            values, places = seeds(hashes, bounds, tuple(range(1, SHORTEST)), items=True)
            rows = np.searchsorted(bounds, places, side="right") - 1
            order = np.argsort(rows, kind="stable")
            found, edges = W.distinct(values[order], np.searchsorted(rows[order], np.arange(len(bounds))))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), W.list_array(pa.array(hashes.view(np.int64)), bounds), W.list_array(pa.array(found.view(np.int64)), edges)], ["item_id", "words", "seeds"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(cut, "item_id long, words array<long>, seeds array<long>").where(F.size("words") > 0)


def seed_filter(items: DataFrame) -> np.ndarray:
    """A bitmap of ``2**FILTER_BITS`` bits with the benchmark's seeds; each task folds its own, the driver gets bitmaps."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            values = np.asarray(batch.column("seed")).view(np.uint64)
            for shift in SHIFTS:
                found = _spots(values, shift)
                np.bitwise_or.at(bits, (found >> _U(3)).astype(np.int64), (_U(1) << (found & _U(7))).astype(np.uint8))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bits[used].astype(np.int16))], ["at", "bits"])

    used = items.select(F.explode("seeds").alias("seed")).mapInArrow(fold, "at int, bits short").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[used["at"].to_numpy(np.int64)] = used["bits"].to_numpy(np.uint8)
    return bits


def document_regions(docs: DataFrame, bitmap: np.ndarray, context: int, whole: tuple[int, ...]) -> DataFrame:
    """Regions of documents around seeds that pass the bitmap: (doc_id, row_key, start int, n_doc int, words array<long>, seeds array<long>).

    ``start`` is the word position of the region in its document of ``n_doc``
    words. A region reaches ``context`` words beyond its hits; hits less than twice
    that apart share one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in W.slices(batches, "text"):
            hashes, bounds = W.plain_word_hashes(batch.column("text"))
            values, places = seeds(hashes, bounds, whole, bitmap=bits)
            order = np.argsort(places, kind="stable")
            values, places = values[order], places[order]
            if not len(places):
                continue
            rows = np.searchsorted(bounds, places, side="right") - 1
            new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (np.diff(places) > 2 * context)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(places)) - 1
            row = rows[first]
            start = np.maximum(places[first] - context, bounds[row])
            end = np.minimum(places[last] + context + SPAN, bounds[row + 1])
            sizes = end - start
            edges = np.concatenate([[0], np.cumsum(sizes)])
            at = np.arange(edges[-1]) - np.repeat(edges[:-1], sizes) + np.repeat(start, sizes)
            found, seed_edges = W.distinct(values, np.append(first, len(places)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), batch.column("row_key").take(pa.array(row)), pa.array((start - bounds[row]).astype(np.int32)), pa.array(np.diff(bounds)[row].astype(np.int32)),
                    W.list_array(pa.array(hashes[at].view(np.int64)), edges), W.list_array(pa.array(found.view(np.int64)), seed_edges),
                ],
                ["doc_id", "row_key", "start", "n_doc", "words", "seeds"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    return rows.mapInArrow(cut, "doc_id long, row_key long, start int, n_doc int, words array<long>, seeds array<long>")


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, rule: Overlap) -> tuple[int, int, int]:
    """(start in the item, length, equal words) of the best stretch of ``item[i]`` against ``doc[i + diagonal]``."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if lo >= hi:
        return lo, 0, 0
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    sums = np.concatenate([[0], np.cumsum(np.where(same, rule.match, rule.mismatch))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return lo + start, end - start, int(same[start:end].sum())


def widest_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, rule: Overlap) -> tuple[int, int, int]:
    """As ``best_overlap``, of the stretch with the most equal words (of those the shortest) among all of ``min_identity``."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if lo >= hi:
        return lo, 0, 0
    equal = np.concatenate([[0], np.cumsum(item[lo:hi] == doc[lo + diagonal : hi + diagonal])])
    excess = np.round(equal - rule.min_identity * np.arange(len(equal)), 9)
    first = np.searchsorted(-np.minimum.accumulate(excess), -excess)  # the longest stretch before each end
    ends = np.arange(len(equal))
    starts = np.minimum(np.searchsorted(equal, equal[first], side="right") - 1, ends)
    end = int(np.argmax((equal - equal[starts]) * len(equal) - (ends - starts)))
    start = int(starts[end])
    return lo + start, end - start, int(equal[end] - equal[start])


def counts_as_overlap(n: int, equal: int, item_words: int, rule: Overlap) -> bool:
    if item_words < SHORTEST:
        return equal == n == item_words
    return equal >= needed(item_words, rule) and equal >= rule.min_identity * n


def needed(item_words: int, rule: Overlap) -> float:
    """The least number of equal words of an overlap."""
    return item_words if item_words < SHORTEST else min(rule.min_words, max(SHORTEST, rule.min_share * item_words))


def diagonals(doc: np.ndarray, item: np.ndarray, least: float) -> np.ndarray:
    """The diagonals with at least so many equal words, by counting them over all pairs of equal words, some at a time."""
    order = np.argsort(item, kind="stable")
    lo, hi = (np.searchsorted(item[order], doc, side=side) for side in ("left", "right"))
    counts = np.zeros(len(doc) + len(item), np.int64)
    ahead = np.concatenate([[0], np.cumsum(hi - lo)])
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ahead, ahead[at] + (1 << 20), side="right")) - 1)
        n = (hi - lo)[at:to]
        place = np.repeat(np.arange(at, to), n)
        other = order[np.arange(len(place)) - np.repeat(ahead[at:to] - ahead[at], n) + np.repeat(lo[at:to], n)]
        counts += np.bincount(place - other + len(item), minlength=len(counts))
        at = to
    return np.flatnonzero(counts >= least) - len(item)


def overlap(doc: np.ndarray, item: np.ndarray, rule: Overlap) -> tuple[int, int, int, int] | None:
    """(start in the document, start in the item, length, equal words) of the overlap with the most equal words; of those the shortest and first."""
    best = None
    for diagonal in diagonals(doc, item, needed(len(item), rule)).tolist():
        at, n, equal = best_overlap(doc, item, diagonal, rule)
        if not counts_as_overlap(n, equal, len(item), rule):
            at, n, equal = widest_overlap(doc, item, diagonal, rule)
        if counts_as_overlap(n, equal, len(item), rule):
            best = max(best or (-1,), (equal, -n, -(at + diagonal), -at))
    return best and (-best[2], -best[3], -best[1], best[0])


def contaminations(docs: DataFrame, items: DataFrame, rule: Overlap | None = None, *, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, row_key, item_id, doc_start, item_start, n_words, n_equal, item_words): each document's best overlap with each item.

    Only overlaps that count are returned. Positions are in words. The result reads
    tables in ``scratch``, which the caller may drop once the result is written.
    """
    rule, scratch = rule or Overlap(), scratch or Scratch(docs.sparkSession)
    tests = scratch.write(item_seeds(items).withColumn("item", F.monotonically_increasing_id()), "test-seeds")
    sizes = F.size("words")
    longest, short = tests.agg(F.max(sizes), F.sort_array(F.collect_set(F.when(sizes < SHORTEST, sizes)))).first()
    found = document_regions(docs, seed_filter(tests), longest or 0, tuple(short))
    regions = scratch.write(found.withColumn("region", F.monotonically_increasing_id()), "regions")
    pairs = regions.select("region", F.explode("seeds").alias("seed")).join(tests.select("item", F.explode("seeds").alias("seed")), "seed").select("region", "item").distinct()
    full = pairs.join(regions.drop("seeds"), "region").join(tests.select("item", "item_id", F.col("words").alias("item_words")), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            starts, totals = (batch.column(c).to_pylist() for c in ("start", "n_doc"))
            for i in range(len(batch)):
                doc, item = (batch.column(c)[i].values.to_numpy() for c in ("words", "item_words"))
                best = overlap(doc, item, rule) if len(item) >= FEW or totals[i] == len(item) else None
                if best:
                    out.append((i, best[0] + starts[i], *best[1:], len(item)))
            rows = pa.array([o[0] for o in out], pa.int64())
            ints = [pa.array([o[j] for o in out], pa.int32()) for j in range(1, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("doc_id", "row_key", "item_id")] + ints, ["doc_id", "row_key", "item_id", "doc_start", "item_start", "n_words", "n_equal", "item_words"])

    found = full.select("doc_id", "row_key", "item_id", "start", "n_doc", "words", "item_words").mapInArrow(verify, "doc_id long, row_key long, item_id long, doc_start int, item_start int, n_words int, n_equal int, item_words int")
    best = F.max_by(F.struct("doc_start", "item_start", "n_words", "n_equal", "item_words"), F.struct("n_equal", -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))).alias("best")
    return found.groupBy("doc_id", "row_key", "item_id").agg(best).select("doc_id", "row_key", "item_id", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame, rule: Overlap | None = None) -> DataFrame:
    """``docs`` without the contaminated ones. Only ids of those are shuffled or, if few, broadcast."""
    scratch = Scratch(docs.sparkSession)
    bad = materialize(contaminations(docs, items, rule, scratch=scratch).select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct(), "contaminated")
    scratch.drop()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key"))
    return rows.join(bad, same, "left_anti").select("row.*")
