"""Exact substring deduplication through fixed-block anchors.

A *window* is ``WINDOW`` consecutive words of one document. A word is removed if
it lies in a window whose words also start in a document of a smaller id.

Anchors: every document is cut into non-overlapping reference blocks of
``BLOCK`` words, and every rolling window of ``BLOCK`` words of every document
probes them. As ``WINDOW >= 2 * BLOCK - 1``, each repeated window contains a whole
reference block of the document it repeats, so a window can only repeat where a
probe met a block of another document.

1. *Probe*: block hashes of all rolling positions are dealt into buckets; which
   of them start a reference block is one bit of the entry. A bucket answers
   with a bitmap of its entries: a probe hit if a reference block with its hash
   lies in a document with a smaller id, a reference block hit if any document
   with a larger id probes it.
2. *Extend*: around hits, each window of ``WINDOW`` words that contains a hit is
   hashed and dealt into buckets by that hash. A bucket answers which of them
   also start in a document with a smaller id. The union of those windows is the
   set of maximal exact repeats.
3. *Cut*: texts meet the answers by document and lose the covered words.

Buckets are a few rows of packed arrays, not a row for each position, and there
are so many of them that each holds the positions of ``BUCKET_BYTES`` of text.

Hot passages: a sample of at most about ``SAMPLE_BYTES`` of text tells which hashes
occur ``HOT`` times or more in it, so their number is bounded. Those don't go to
buckets: one pass reduces each of them, in every task and then over all, to the
least and the greatest document id, and that bounded table is sent to all tasks,
which judge hot positions themselves and flag documents with hits in further
buckets without entries. The sample only chooses the path; results
are the same for any choice. A hash that is not hot is rare enough (about 1 of
2,000 documents or fewer) that its bucket stays small.

Defined results: words are runs of bytes outside 0x20 and 0x09-0x0D, unchanged.
Null and empty texts have no words. Rows with a null id remove nothing and lose
nothing. Rows with equal ids don't remove each other's words. Empty tables give
empty results. Equality of windows is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprism.llm import words as W
from readprism.llm.shared import materialize

_U = np.uint64
WINDOW, BLOCK = 13, 7
BUCKET_BYTES = 16 << 20
BUCKETS_A_TASK = 4
SAMPLE_BYTES = 32 << 20
HOT = 8
_PACKED = "bucket int, docs array<long>, rows array<int>, counts array<int>, entries binary"
_REPLY = "place int, docs array<long>, rows array<int>, buckets array<int>, sizes array<int>, bits binary"
_DOCUMENT = "doc_id long, row int, replies array<struct<bucket:int,bits:binary>>"


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _pack(hashes: np.ndarray, entries: np.ndarray, bounds: np.ndarray, docs: pa.Array, rows: pa.Array, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: the documents with entries in it, how many each, and the entries in order."""
    bucket = _bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[order]
    bucket, entries = bucket[order], entries[order]
    run = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])])) if len(owner) else np.zeros(0, np.int64)
    counts = np.diff(np.append(run, len(owner)))
    used, first = np.unique(bucket[run], return_index=True)
    edges = np.append(first, len(run))
    cuts = np.append(run, len(owner))[edges]
    taken = pa.array(owner[run])
    data = entries.tobytes()
    width = entries.dtype.itemsize
    blobs = [data[a * width : b * width] for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), W.list_array(docs.take(taken), edges), W.list_array(rows.take(taken), edges), W.list_array(pa.array(counts.astype(np.int32)), edges), pa.array(blobs, pa.binary())],
        ["bucket", "docs", "rows", "counts", "entries"],
    )


def _flagged(rows: np.ndarray, batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Documents with hot hits, as a row of one of as many further buckets, which answer without entries."""
    rows = np.unique(rows)
    docs, keys = (batch.column(c).take(pa.array(rows)) for c in ("doc_id", "row"))
    bucket = buckets + int(_bucket_of(W.mix(np.asarray(keys)[:1].astype(np.uint64)), buckets)[0])
    edges = np.array([0, len(rows)])
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), W.list_array(docs, edges), W.list_array(keys, edges), W.list_array(pa.array(np.zeros(len(rows), np.int32)), edges), pa.array([b""], pa.binary())],
        ["bucket", "docs", "rows", "counts", "entries"],
    )


def _new(*columns: np.ndarray) -> np.ndarray:
    """Flags of the rows of sorted columns that differ from the row before."""
    flags = np.ones(len(columns[0]), bool)
    flags[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return flags


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows, as tuples, of each value of the first column, from batches sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for i in range(len(batch)):
            first, *rest = (column[i] for column in batch.columns)
            row = (first.as_py(), *(x.values.to_numpy() if isinstance(x, pa.ListScalar) else x.as_py() for x in rest))
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows in order of ``key``, which is below ``n``; a task has a few of its values."""
    tasks = max(-(-n // BUCKETS_A_TASK), min(n, rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartitionById(tasks, F.col(key) % tasks).sortWithinPartitions(key)


def _answers(packed: DataFrame, buckets: int, dtype: str, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Bring each bucket's rows together, judge its entries (entries, doc ids) and send bitmaps back: a row for each document with hits.

    Bitmaps travel packed, a row for each place (a share of the documents) and a
    few buckets, and meet by document at their place. Documents that repeat in
    id and text get one answer.
    """

    def answer(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        docs, keys, counts = (np.concatenate([r[j] for r in rows]) for j in (1, 2, 3))
        if rows[0][0] >= buckets:
            return docs, keys, np.full(len(docs), rows[0][0], np.int32), [b""] * len(docs)
        entries = np.concatenate([np.frombuffer(r[4], dtype) for r in rows])
        hit = judge(entries, np.repeat(docs, counts))
        starts = np.cumsum(counts) - counts
        some = np.flatnonzero(np.add.reduceat(hit.astype(np.int64), starts))
        return docs[some], keys[some], np.full(len(some), rows[0][0], np.int32), [np.packbits(hit[a : a + n]).tobytes() for a, n in zip(starts[some], counts[some])]

    def by_place(found: list[tuple]) -> pa.RecordBatch:
        docs, keys, bucket = (np.concatenate([f[j] for f in found]) for j in range(3))
        bits = [b for f in found for b in f[3]]
        place = _bucket_of(W.mix(docs.astype(np.uint64) ^ W.mix(keys.astype(np.uint64))), buckets)
        order = np.lexsort((bucket, keys, docs, place))
        order = order[_new(docs[order], keys[order], bucket[order])]
        edges = np.append(np.flatnonzero(_new(place[order])), len(order))
        lists = [W.list_array(pa.array(column[order]), edges) for column in (docs, keys, bucket, np.array([len(b) for b in bits], np.int32))]
        blobs = [b"".join(bits[i] for i in order[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(place[order][edges[:-1]].astype(np.int32)), *lists, pa.array(blobs, pa.binary())], ["place", "docs", "rows", "buckets", "sizes", "bits"])

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in _groups(batches):
            found.append(answer(rows))
            if len(found) == BUCKETS_A_TASK:
                yield by_place(found)
                found = []
        if found:
            yield by_place(found)

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            docs, keys, bucket, sizes = (np.concatenate([r[j] for r in rows]) for j in range(1, 5))
            bits = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes, dtype=np.int64))), pa.py_buffer(b"".join(r[5] for r in rows))])
            order = np.lexsort((bucket, keys, docs))
            docs, keys = docs[order], keys[order]
            edges = np.append(np.flatnonzero(_new(docs, keys)), len(docs))
            pairs = pa.StructArray.from_arrays([pa.array(bucket[order]), bits.take(pa.array(order)).cast(pa.binary())], ["bucket", "bits"])
            yield pa.RecordBatch.from_arrays([pa.array(docs[edges[:-1]]), pa.array(keys[edges[:-1]]), W.list_array(pairs, edges)], ["doc_id", "row", "replies"])

    return _dealt(_dealt(packed, "bucket", 2 * buckets).mapInArrow(by_bucket, _REPLY), "place", buckets).mapInArrow(by_document, _DOCUMENT)


def _judge_probes(entries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Entries are block hashes with bit 0 set where a reference block starts."""
    order = np.argsort(entries >> 1, kind="stable")
    key, doc, block = entries[order] >> 1, docs[order], (entries[order] & 1).astype(bool)
    run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(run, len(key)))
    none = np.iinfo(np.int64).max
    least = np.repeat(np.minimum.reduceat(np.where(block, doc, none), run), sizes)
    most = np.repeat(np.maximum.reduceat(doc, run), sizes)
    out = np.empty(len(key), bool)
    out[order] = (least < doc) | (block & (most > doc))
    return out


def _judge_windows(entries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Entries are window hashes: true where the window also starts in a document of a smaller id."""
    order = np.argsort(entries, kind="stable")
    key, doc = entries[order], docs[order]
    run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(doc, run), np.diff(np.append(run, len(key)))) < doc
    return out


def _unpack(hashes: np.ndarray, replies: list[dict] | None, buckets: int) -> np.ndarray:
    """Bitmaps of one document's buckets, back in the order of its entries."""
    out = np.zeros(len(hashes), bool)
    if replies:
        bucket = _bucket_of(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < 4 * len(hashes) else None
        for r in replies:
            if r["bucket"] >= buckets:
                continue
            own = order[edges[r["bucket"]] : edges[r["bucket"] + 1]] if edges is not None else np.flatnonzero(bucket == r["bucket"])
            out[own] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(own)).astype(bool)
    return out


def _windows_near(hits: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that contain a hit block (given as flags of block starts)."""
    n = n_words - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(hits)])
    return np.flatnonzero(sums[WINDOW - BLOCK + 1 : WINDOW - BLOCK + 1 + n] > sums[:n])


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Facts:
    """Of hot hashes (ascending): blocks with the least id of a reference block and the greatest id of a probe, windows with the least id."""

    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    block_least: np.ndarray = field(default_factory=_none)
    block_most: np.ndarray = field(default_factory=_none)
    windows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    window_least: np.ndarray = field(default_factory=_none)


def _place(hashes: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flags of hot hashes, their places in ``hot``)."""
    if not len(hot) or not len(hashes):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    return hot[at] == hashes, at


def _rolling(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bounds, block hashes and bounds, window hashes and bounds) of a batch's texts."""
    hashes, bounds = W.word_hashes(batch.column("text"), lower=False)
    return bounds, *W.windows(hashes, bounds, BLOCK, short=False), *W.windows(hashes, bounds, WINDOW, short=False)


def _block_starts(bounds: np.ndarray) -> np.ndarray:
    """Flags of the rolling positions where a reference block starts."""
    return (np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))) % BLOCK == 0


def _hot_hashes(base: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(block hashes, window hashes) that occur often in a sample of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            _, blocks, _, full, _ = _rolling(batch)
            for kind, values in ((0, blocks), (1, full)):
                found, n = np.unique(values, return_counts=True)
                found, n = found[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["kind", "hash", "n"])

    sample = base.select("text").where("doc_id is not null")
    if total > SAMPLE_BYTES:
        sample = sample.sample(SAMPLE_BYTES / total, 1)
    often = sample.repartition(8).mapInArrow(count, "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).select("kind", "hash").toPandas()
    return tuple(np.sort(often["hash"][often["kind"] == kind].to_numpy(np.int64).view(np.uint64)) for kind in (0, 1))


def _hot_facts(base: DataFrame, total: int) -> Facts:
    blocks, full = _hot_hashes(base, total)
    if not len(blocks) and not len(full):
        return Facts()
    shared = base.sparkSession.sparkContext.broadcast((blocks, full))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).max
        least, most = [np.full(len(hot), none) for hot in shared.value], [np.full(len(hot), -none - 1) for hot in shared.value]
        for batch in W.slices(batches, "text"):
            _, blocks, block_bounds, full, full_bounds = _rolling(batch)
            docs = np.asarray(batch.column("doc_id"))
            for kind, values, bounds in ((0, blocks, block_bounds), (1, full, full_bounds)):
                hot, at = _place(values, shared.value[kind])
                owner = np.repeat(docs, np.diff(bounds))
                np.maximum.at(most[kind], at[hot], owner[hot])
                given = hot & _block_starts(bounds) if kind == 0 else hot
                np.minimum.at(least[kind], at[given], owner[given])
        for kind in (0, 1):
            seen = np.flatnonzero(most[kind] > -none - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), kind, np.int32)), pa.array(shared.value[kind][seen].view(np.int64)), pa.array(least[kind][seen]), pa.array(most[kind][seen])], ["kind", "hash", "least", "most"])

    rows = base.where("doc_id is not null").select("doc_id", "text").mapInArrow(reduce, "kind int, hash long, least long, most long")
    rows = rows.groupBy("kind", "hash").agg(F.min("least").alias("least"), F.max("most").alias("most")).toPandas()
    rows["hash"] = rows["hash"].to_numpy(np.int64).view(np.uint64)
    one, two = (rows[rows["kind"] == kind].sort_values("hash") for kind in (0, 1))
    return Facts(one["hash"].to_numpy(), one["least"].to_numpy(), one["most"].to_numpy(), two["hash"].to_numpy(), two["least"].to_numpy())


def _candidates(batch: pa.RecordBatch, buckets: int, facts: Facts) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hashes of candidate windows, bounds by row, their starts by row) of a batch with replies of the probe step."""
    bounds, blocks, block_bounds, full, full_bounds = _rolling(batch)
    docs = batch.column("doc_id").to_pylist()
    hot, at = _place(blocks, facts.blocks)
    begins = _block_starts(block_bounds)
    found, starts = [], []
    for i in range(len(batch)):
        replies, own = batch.column("probes")[i].as_py(), slice(block_bounds[i], block_bounds[i + 1])
        near = np.zeros(0, np.int64)
        if replies:
            hits = np.zeros(block_bounds[i + 1] - block_bounds[i], bool)
            hits[~hot[own]] = _unpack(blocks[own][~hot[own]], replies, buckets)
            some = at[own][hot[own]]
            if len(some):
                hits[hot[own]] = (facts.block_least[some] < docs[i]) | (begins[own][hot[own]] & (facts.block_most[some] > docs[i]))
            near = _windows_near(hits, int(bounds[i + 1] - bounds[i]))
        starts.append(near)
        found.append(full[full_bounds[i] + near])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in starts])]).astype(np.int64), starts


def _rest(hashes: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of hashes that are not hot, those hashes, bounds by row)."""
    rest = np.flatnonzero(~_place(hashes, hot)[0])
    return rest, hashes[rest], np.searchsorted(rest, bounds)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, removed array<struct<first, last>>, kept text): one row per document.

    ``removed`` lists runs of removed words by their first and last word numbers,
    from 0; ``kept`` is the other words joined by one space.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("row"), "text")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET_BYTES) + 1
    shared = base.sparkSession.sparkContext.broadcast(_hot_facts(base, total))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            hashes, bounds = W.word_hashes(batch.column("text"), lower=False)
            values, bounds = W.windows(hashes, bounds, BLOCK, short=False)
            begins, facts = _block_starts(bounds), shared.value
            hot, at = _place(values, facts.blocks)
            if hot.any():
                row = np.repeat(np.arange(len(batch)), np.diff(bounds))[hot]
                own, at = np.asarray(batch.column("doc_id"))[row], at[hot]
                hit = (facts.block_least[at] < own) | (begins[hot] & (facts.block_most[at] > own))
                if hit.any():
                    yield _flagged(row[hit], batch, buckets)
            rest, values, bounds = _rest(values, bounds, facts.blocks)
            entries = (values & _U(0xFFFFFFFE)).astype(np.uint32) | begins[rest].astype(np.uint32)
            yield _pack(values, entries, bounds, batch.column("doc_id"), batch.column("row"), buckets)

    probes = _answers(base.where("doc_id is not null").mapInArrow(probe, _PACKED), buckets, "uint32", _judge_probes).withColumnRenamed("replies", "probes")
    asked = base.join(materialize(probes, "probes"), ["doc_id", "row"], "left")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            some, facts = batch.filter(batch.column("probes").is_valid()), shared.value
            if len(some):
                values, bounds, _ = _candidates(some, buckets, facts)
                hot, at = _place(values, facts.windows)
                if hot.any():
                    row = np.repeat(np.arange(len(some)), np.diff(bounds))[hot]
                    hit = facts.window_least[at[hot]] < np.asarray(some.column("doc_id"))[row]
                    if hit.any():
                        yield _flagged(row[hit], some, buckets)
                _, values, bounds = _rest(values, bounds, shared.value.windows)
                yield _pack(values, values, bounds, some.column("doc_id"), some.column("row"), buckets)

    windows = _answers(asked.mapInArrow(extend, _PACKED), buckets, "uint64", _judge_windows).withColumnRenamed("replies", "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = shared.value
        for batch in W.slices(batches, "text"):
            touched = np.asarray(batch.column("windows").is_valid())
            some = batch.filter(pa.array(touched))
            values, bounds, starts = _candidates(some, buckets, facts)
            hot, at = _place(values, facts.windows)
            replies, ids, place = some.column("windows"), some.column("doc_id").to_pylist(), 0
            out = []
            for i, text in enumerate(batch.column("text")):
                words = text.as_py().encode().split() if text.is_valid else []
                runs: list[dict] = []
                n = len(words)
                if touched[i]:
                    own = slice(bounds[place], bounds[place + 1])
                    hit = np.zeros(len(starts[place]), bool)
                    hit[~hot[own]] = _unpack(values[own][~hot[own]], replies[place].as_py(), buckets)
                    if hot[own].any():
                        hit[hot[own]] = facts.window_least[at[own][hot[own]]] < ids[place]
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, starts[place][hit], 1)
                    np.add.at(marks, starts[place][hit] + WINDOW, -1)
                    gone = np.cumsum(marks)[:n] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    runs = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]
                    words = [w for w, g in zip(words, gone) if not g]
                    place += 1
                out.append((n, n - len(words), runs, b" ".join(words).decode()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array([o[3] for o in out], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    final = asked.join(windows, ["doc_id", "row"], "left")
    return final.select("doc_id", "text", "probes", "windows").mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string")
