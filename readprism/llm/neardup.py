"""Near-duplicate documents by MinHash, verified through odd sketches.

A document's set is its distinct shingles (hashed word windows). Documents with
equal sets form a class; all further work is on classes, so thousands of copies
cost one node. Each class has ``samples`` MinHash values. They serve twice:

* the first ``bands * rows`` of them are cut into bands, and classes that share
  a band's key are candidates;
* all of them are folded into an odd sketch: sample i toggles the bit that
  (i, value) hashes to, so the XOR of two sketches holds the parity of what the
  samples don't share, and its population count z estimates the similarity as
  ``1 + n / (4 k) * ln(1 - 2 z / n)`` for k samples and n bits. Pairs estimated
  below ``threshold - margin`` are dropped; the margin is over five standard
  errors, so a link is not lost to it.

What is left is confirmed exactly, on the full sets, in cells of one text and up
to ``MEMBERS`` others that are held against it.

Candidates are not all pairs of a bucket. First every member is held against its
bucket's head, of its heads first against the one with
the nearest sketch; then against the others, if that left them in different
components. Only buckets that still hold several components go on: in them, every
pair of different components of which one is not the bucket's main component is
compared by size and sketch, in cells of two blocks of ``BLOCK`` rows. Rows with a
partner that passes come together once more, with their texts, and a cell
confirms pairs until it knows its rows to be connected. No bucket has to fit in
one task, and no step returns more rows than it has. The head is the member whose
buckets are the largest taken together (of equals, that of the least class number): copies
that were changed in places of their own share most with what they were made from, so
they are joined through it, though few of them are linked with each other. Pairs within a component
need no further link: no component is lost by leaving them out. A bucket of n
classes in n components makes (n / BLOCK)^2 cells of sketches; texts go only
where sketches are alike.

Joins read written tables or plain exchanges on both sides, so that Spark may
split the rows of a very common key over several tasks.

Defined results: text is lower-cased for A-Z only. No words (or a null text):
size 0, linked with nothing. Fewer words than a shingle has: the whole sequence
is the only shingle. Rows with a null id take part; a component's id is its
least non-null id. Repeated rows are in one component. Empty tables give empty
results; further columns, whatever their names, are ignored by
``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readprism.llm import words as W
from readprism.llm.components import components
from readprism.llm.shared import Scratch, apart, materialize

_U = np.uint64
BLOCK = 512
MEMBERS = 512
WORD_BITS = 20


@dataclass(frozen=True)
class NearDup:
    """Parameters: links have ``100 * intersection >= percent * union``."""

    shingle: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 4
    samples: int = 128
    bits: int = 1024
    margin: float = 0.2

    @property
    def floor(self) -> float:
        return self.percent / 100 - self.margin


def _multipliers(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20260)
    return rng.integers(1, 1 << 63, samples, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, samples, dtype=np.uint64)


def minhashes(values: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """MinHash values of each (non-empty) row: shape (rows, samples)."""
    a, b = _multipliers(samples)
    out = np.empty((samples, len(bounds) - 1), np.uint64)
    for i in range(samples):
        out[i] = np.minimum.reduceat(values * a[i] + b[i], bounds[:-1])
    return out.T


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of MinHash samples: shape (rows, bits / 64)."""
    n, k = samples.shape
    at = W.mix(samples + (np.arange(k, dtype=np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)) % _U(bits)
    flips = np.zeros((n, bits), np.uint8)
    np.bitwise_xor.at(flips, (np.arange(n)[:, None], at.astype(np.int64)), 1)
    return np.packbits(flips, axis=1, bitorder="little").view(np.uint64)


def estimate(distance: np.ndarray | float, samples: int, bits: int):
    """Similarity from the population count of two sketches' XOR."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * np.asarray(distance, float) / bits, 1e-9))


def distance_limit(p: NearDup) -> int:
    """The largest population count whose estimate is at least the floor."""
    return int(np.flatnonzero(estimate(np.arange(p.bits // 2), p.samples, p.bits) >= p.floor).max())


SIGNATURE = "doc_id long, row_key long, n_shingles long, node binary, sketch binary, bands array<long>"


def signatures(docs: DataFrame, p: NearDup) -> DataFrame:
    """Per document: the size of its set, its class, its odd sketch and its band keys (nothing of an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            hashes, bounds = W.word_hashes(batch.column("text"), lower=True)
            values, bounds = W.distinct(*W.windows(hashes, bounds, p.shingle, short=True))
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            packed = np.concatenate([[0], np.cumsum(sizes[full])])
            node = np.zeros((len(full), 2), np.uint64)
            keys = np.zeros((len(full), p.bands), np.uint64)
            sketch = np.zeros((len(full), p.bits // 64), np.uint64)
            if len(full):
                node[:, 0] = np.add.reduceat(W.mix(values ^ _U(0xA5A5A5A5A5A5A5A5)), packed[:-1])
                node[:, 1] = np.add.reduceat(W.mix(values + _U(0x1234567887654321)), packed[:-1])
                samples = minhashes(values, packed, p.samples)
                sketch = odd_sketches(samples, p.bits)
                steps = _multipliers(p.rows + 1)[0]
                for band in range(p.bands):
                    part = samples[:, band * p.rows : (band + 1) * p.rows]
                    keys[:, band] = W.mix((part * steps[: p.rows]).sum(axis=1, dtype=np.uint64) + np.full(len(full), band, np.uint64) * steps[p.rows])
            back = np.full(len(sizes), -1)
            back[full] = np.arange(len(full))
            take = pa.array(back, mask=back < 0)
            lists = W.list_array(pa.array(keys.ravel().view(np.int64)), np.arange(len(full) + 1) * p.bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), W.fixed_binary(node).take(take), W.fixed_binary(sketch).take(take), lists.take(take)],
                ["doc_id", "row_key", "n_shingles", "node", "sketch", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text").mapInArrow(sign, SIGNATURE)


def _keyed(docs: DataFrame) -> DataFrame:
    """(id_key, row_key, text): both keys are never null, so that joins on them are plain."""
    return docs.select(_id_key(F.col("doc_id").cast("long")).alias("id_key"), F.xxhash64("text").alias("row_key"), "text")


def _id_key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id, doc_id.isNull())


def _marking(wanted: DataFrame) -> tuple[DataFrame, Column]:
    """A bitmap of the keys (id_key, row_key) of ``wanted``, and the column to join it by.

    The bitmap has at most ``2**WORD_BITS`` words of 64 bits, whatever the number of
    rows, and so may be broadcast. It only keeps texts out of a shuffle: all wanted
    rows and a few others pass, and exact joins follow.
    """
    spot = F.xxhash64("id_key", "row_key")
    word, bit = F.shiftrightunsigned(spot, 64 - WORD_BITS), F.expr("shiftleft(1L, cast(xxhash64(id_key, row_key) & 63 as int))")
    return wanted.select(word.alias("mark_word"), bit.alias("bit")).groupBy("mark_word").agg(F.bit_or("bit").alias("mark_bits")), word


def _marked(rows: DataFrame, wanted: DataFrame, *, others: bool = False) -> DataFrame:
    """The rows that the bitmap of ``wanted`` lets pass, or the others."""
    bitmap, word = _marking(wanted)
    bit = F.expr("shiftleft(1L, cast(xxhash64(id_key, row_key) & 63 as int))")
    hit = F.coalesce(F.col("mark_bits").bitwiseAND(bit) != 0, F.lit(False))
    placed = rows.withColumn("mark_word", word).join(F.broadcast(bitmap), "mark_word", "left")
    return placed.where(~hit if others else hit).select(*rows.columns)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id_key, row_key, text) of wanted documents and a few others; rows that repeat are one."""
    return _marked(_keyed(docs), wanted).groupBy("id_key", "row_key").agg(F.first("text").alias("text"))


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sets (ascending) reach the threshold."""
    shared = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _close(pairs: DataFrame, nodes: DataFrame, p: NearDup) -> DataFrame:
    """(u, v, z) of the distinct pairs (u, v) whose sizes and odd sketches pass; z is the population count."""
    facts = nodes.select("id", "size", "sketch")
    one, two = (facts.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
    both = pairs.distinct().join(one, "u").join(two, "v").where(100 * F.least("size_u", "size_v") >= p.percent * F.greatest("size_u", "size_v"))
    limit, width = distance_limit(p), p.bits // 64

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_sketches(batch.column(c), width) for c in ("sketch_u", "sketch_v"))
            z = np.bitwise_count(a ^ b).sum(axis=1)
            keep = np.flatnonzero(z <= limit)
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(keep)), batch.column("v").take(pa.array(keep)), pa.array(z[keep].astype(np.int32))], ["u", "v", "z"])

    return both.select("u", "v", "sketch_u", "sketch_v").mapInArrow(near, "u long, v long, z int")


def _sketches(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, p: NearDup, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold.

    A cell has the text of v and those of up to about ``MEMBERS`` others; texts
    travel twice, once to meet their pairs and once to their cells.
    """
    degree = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    members = pairs.join(degree.withColumnRenamed("v", "w"), apart(F.col("v")) == apart(F.col("w"))).select(F.col("u").alias("id"), "v", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("asks"))
    heads = degree.select(F.col("v").alias("id"), "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"))
    where = nodes.select("id", _id_key(F.col("least.doc_id")).alias("id_key"), F.col("least.row_key").alias("row_key"))
    wanted = scratch.write(members.unionByName(heads).join(where, "id"), "wanted")
    cells = _texts(docs, wanted).join(wanted, ["id_key", "row_key"]).select(F.xxhash64("v", "block").alias("cell"), "v", "block", "asks", "id", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, np.uint64)
        for batch in W.slices(batches, "text"):
            values, bounds = W.distinct(*W.windows(*W.word_hashes(batch.column("text"), lower=True), p.shingle, short=True))
            ids, vs, asks = (batch.column(c).to_pylist() for c in ("id", "v", "asks"))
            found: list[tuple[int, int]] = []
            for i in range(len(batch)):
                own = values[bounds[i] : bounds[i + 1]]
                if not asks[i]:
                    at, head = vs[i], own
                elif at == vs[i] and _linked(own, head, p.percent):
                    found.append((ids[i], at))
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], ["u", "v"])

    return cells.repartition("cell").sortWithinPartitions("cell", "v", "block", "asks").mapInArrow(verify, "u long, v long")


def _between(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs (u, v, z) of different components."""
    if roots is None:
        return pairs
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "uv")
    return pairs.join(one, "u", "left").join(two, "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v", "z")


def _joined(pairs: DataFrame, roots: DataFrame | None, nodes: DataFrame, docs: DataFrame, p: NearDup, scratch: Scratch) -> DataFrame | None:
    """Components (node, root) after confirming ``pairs`` (u, v, z): first each u's nearest v, then all that are still apart."""
    for last in (False, True):
        pairs, seen = scratch.measured(_between(pairs, roots), "pairs")
        if not seen.n:
            break
        now = pairs if last else scratch.write(pairs.groupBy("u").agg(F.min_by("v", F.struct("z", "v")).alias("v")), "nearest")
        links, seen = scratch.measured(_confirmed(now, nodes, docs, p, scratch), "links")
        pairs = pairs.join(now, ["u", "v"], "left_anti")
        if seen.n:
            roots = _more(links, roots, scratch)
    return roots


def _more(links: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Components after more links; the known ones are stars, so few rounds join them with the new links."""
    return components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), scratch)


def _rest_links(buckets: DataFrame, roots: DataFrame | None, nodes: DataFrame, docs: DataFrame, p: NearDup, scratch: Scratch) -> DataFrame:
    """Confirmed links between different components that share a bucket, a spanning part of them.

    A bucket's main component is that of its head. Rows of it have one home
    block; all other rows (strays) have a home block too and meet every block. A
    cell is a block of homes and a block of strays, so its size is bounded. Cells
    of sketches say which of their rows have a partner at all; cells of those
    rows, with their texts, hold the pairs against each other by full sets until
    the cell knows them connected. A pair is compared in the first band it shares.
    """
    known = nodes.select("id", F.col("id").alias("root")).where("false") if roots is None else roots.select(F.col("node").alias("id"), "root")
    heads = known.select(F.col("id").alias("head"), F.col("root").alias("main"))
    rooted = buckets.join(known, "id", "left").join(heads, "head", "left").select("key", "id", F.coalesce("root", "id").alias("root"), F.coalesce("main", "head").alias("main"))
    rooted = scratch.write(rooted.withColumn("stray", F.col("root") != F.col("main")), "rooted")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int"), F.ceil(F.count_if("stray") / BLOCK).cast("int")
    mixed = rooted.groupBy("key").agg(blocks[0].alias("blocks"), blocks[1].alias("chunks")).where("chunks > 0").withColumnRenamed("key", "mixed")
    placed = rooted.join(mixed, apart(F.col("key")) == apart(F.col("mixed")))
    home, chunk = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")
    homes = placed.select("key", "id", "root", F.lit(False).alias("moved"), home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    moves = placed.where("stray").select("key", "id", "root", F.lit(True).alias("moved"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("home"), chunk.alias("chunk"))
    cells = homes.unionByName(moves).select(F.xxhash64("key", "home", "chunk").alias("cell"), "key", "id", "root", "moved")
    limit, width = distance_limit(p), p.bits // 64

    def candidates(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
        """(root labels, flags of strays, for each stray its possible partners, the nearest first) of a cell."""
        size, moved, key = np.asarray(rows.column("size")), np.asarray(rows.column("moved")), rows.column("key")[0].as_py()
        label = np.unique(np.asarray(rows.column("root")), return_inverse=True)[1]
        sketch = _sketches(rows.column("sketch"), width)
        bands = rows.column("bands").combine_chunks().values.to_numpy().reshape(len(rows), -1)
        bands = bands[:, : int(np.flatnonzero(bands[0] == key)[0])]
        home = np.flatnonzero(~moved)

        def partners() -> Iterator[tuple[int, np.ndarray]]:
            for s in np.flatnonzero(moved):
                near = home[(label[home] != label[s]) & (100 * np.minimum(size[home], size[s]) >= p.percent * np.maximum(size[home], size[s]))]
                z = np.bitwise_count(sketch[near] ^ sketch[s]).sum(axis=1)
                near = near[np.argsort(z, kind="stable")[: int((z <= limit).sum())]]
                if len(near):
                    yield s, near[~(bands[near] == bands[s]).any(axis=1)]

        return label, moved, partners()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "cell"):
            label, _, found = candidates(rows)
            used = np.zeros(len(label), bool)
            for s, near in found:
                used[near] = True
                used[s] |= len(near) > 0
            yield from rows.select(["cell", "key", "id", "root", "moved"]).take(pa.array(np.flatnonzero(used))).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "cell"):
            ids, (label, _, found) = np.asarray(rows.column("id")), candidates(rows)
            sets: list[np.ndarray] = []
            for part in rows.select(["text"]).to_batches():
                for piece in W.slices(iter([part]), "text"):
                    values, bounds = W.distinct(*W.windows(*W.word_hashes(piece.column("text"), lower=True), p.shingle, short=True))
                    sets += [values[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
            links: list[tuple[int, int]] = []
            for s, near in found:
                for h in near:
                    if label[h] != label[s] and _linked(sets[s], sets[h], p.percent):
                        links.append((max(ids[s], ids[h]), min(ids[s], ids[h])))
                        label[label == label[h]] = label[s]
            yield pa.RecordBatch.from_arrays([pa.array([link[j] for link in links], pa.int64()) for j in (0, 1)], ["u", "v"])

    facts = nodes.select("id", "size", "sketch", "bands")
    first = cells.join(facts, "id").repartition("cell").sortWithinPartitions("cell").mapInArrow(find, "cell long, key long, id long, root long, moved boolean")
    used, seen = scratch.measured(first, "cells")
    if not seen.n:
        return nodes.select(F.col("id").alias("u"), F.col("id").alias("v")).where("false")
    where = nodes.select("id", _id_key(F.col("least.doc_id")).alias("id_key"), F.col("least.row_key").alias("row_key"))
    wanted = scratch.write(used.select("id").distinct().join(where, "id"), "wanted")
    texts = _texts(docs, wanted).join(wanted, ["id_key", "row_key"]).select("id", "text")
    return used.join(facts, "id").join(texts, "id").repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(compare, "u long, v long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = np.asarray(batch.column(key))
        edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []
        for a, b in zip(edges, np.append(edges[1:], len(ids)) if len(ids) else []):
            if held and held[0].column(key)[0].as_py() != ids[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _rooted(docs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, row_key, n_shingles, root): one row per document; ``root`` numbers its component, null for an empty set."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(signatures(docs, p), "signatures")
    classes = signed.where("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least")
    )
    # The numbers hold for this table, as it is written once and read from then on.
    nodes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("of"), "n")
    shared = scratch.write(keyed.join(sizes, apart(F.col("key")) == apart(F.col("of"))).drop("of"), "shared")
    central = shared.join(shared.groupBy("id").agg(F.sum("n").alias("near")), "id")
    heads = central.groupBy("key").agg(F.min(F.struct(-F.col("near"), "id"))["id"].alias("head")).withColumnRenamed("key", "of")
    buckets, seen = scratch.measured(shared.drop("n").join(heads, apart(F.col("key")) == apart(F.col("of"))).drop("of"), "buckets")
    roots = None
    if seen.n:
        stars = _close(buckets.where("id != head").select(F.col("id").alias("u"), F.col("head").alias("v")), nodes, p)
        roots = _joined(stars, roots, nodes, docs, p, scratch)
        links, seen = scratch.measured(_rest_links(buckets, roots, nodes, docs, p, scratch), "links")
        roots = _more(links, roots, scratch) if seen.n else roots
    numbered = signed.select("doc_id", "row_key", "n_shingles", "node").join(nodes.select("node", "id"), "node", "left")
    if roots is not None:
        numbered = numbered.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    else:
        numbered = numbered.withColumnRenamed("id", "root")
    found = materialize(numbered.select("doc_id", "row_key", "n_shingles", "root"), "components")
    scratch.drop()
    return found


def near_duplicates(docs: DataFrame, p: NearDup | None = None) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id): one row per document; ``row_key`` is a hash of the text."""
    grouped = _rooted(docs, p or NearDup())
    ids = materialize(grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return grouped.join(ids, "root", "left").select("doc_id", "row_key", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, p: NearDup | None = None) -> DataFrame:
    """``docs`` with one document of each component: that of the least id (null last), ties by a hash of the text.

    Documents without words are kept, one of each (id, text). Of rows that repeat
    in id and text, the one of the least hash of all its columns stays. Only
    documents that go or repeat (and few others, by a bitmap of bounded size) are
    shuffled; all others pass the scan untouched.
    """
    found = _rooted(docs, p or NearDup()).select("doc_id", "row_key", "root", _id_key(F.col("doc_id")).alias("id_key"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "id_key"))
    keep = materialize(found.where("root is not null").groupBy("root").agg(least.alias("least")).select("least.id_key", "least.row_key"), "keep")
    copies = found.groupBy("id_key", "row_key").agg(F.count(F.lit(1)).alias("n"), F.first("root").alias("root"))
    touched = materialize(
        copies.join(keep.withColumn("kept", F.lit(True)), ["id_key", "row_key"], "left").select("id_key", "row_key", "n", (F.col("root").isNotNull() & F.col("kept").isNull()).alias("goes")).where("goes or n > 1"), "touched"
    )
    rows = docs.select(_id_key(F.col("doc_id").cast("long")).alias("id_key"), F.xxhash64("text").alias("row_key"), F.struct("*").alias("row"))
    untouched = _marked(rows, touched, others=True).select("row")
    some = _marked(rows, touched).groupBy("id_key", "row_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return untouched.unionByName(some.join(touched.where("goes"), ["id_key", "row_key"], "left_anti").select("row")).select("row.*")
