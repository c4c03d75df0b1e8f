"""The trie of conversation prefixes, from a Cartesian tree over the LCP array of sorted conversations.

Conversations become sequences of turn digests (128 bits of role and text; texts
don't travel), equal sequences one row with their ids hashed in order. Sequences
are sorted by ranges into blocks. L[i], the number of turns that sequence i shares with the
one before it, spans the Cartesian tree: a node of depth d that starts at
sequence i (L[i] < d) reaches to the nearest later L smaller than d. A block finds
nearest smaller values by one stack with an entry for each depth, so equal values
share a node, and depths at which nothing branches are there too. Children add
their sums to the parent as they leave the stack.

Nodes that begin and end in one block are done there. A block also gives its
minima and sums (one row), what it adds to nodes of earlier blocks that end in it
(one row for each depth), and its own nodes that are still open (likewise). The block minima tell
in which block an open node ends and in which block a node's parent began; sums
over whole blocks between, and joins by block and depth, complete them. What
the driver sees is one row of numbers for each block.

Defined results: rows without a ``conv_id`` belong to no conversation and are left
out. Turns are ordered by ``turn``, null first, ties by digest; rows that repeat
are turns of their own. Without conversations there are no nodes. Texts are hashed
and counted whole; other columns are not read. A conversation's digests are one row (24
bytes a turn), and the ids of equal conversations are hashed one after the other
in one task, as a stream, since their digest asks for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readprism.llm.shared import Scratch

FAMILY, MOST_SHARED = 20, 4
DIGEST = 16
_FAR = 1 << 60
_EMPTY = hashlib.sha256(b"").hexdigest()
_SEQUENCE = "key binary, words array<int>, cnt long, conv_id long, ends string"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: What a block returns. kind: node (done), child (its parent's id is open), open, chain, block.
_PARTS = [
    ("kind", pa.string()), ("block", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("mass", pa.int64()), ("fresh", pa.int64()), ("ahead", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("parent_conv_id", pa.int64()), ("outside", pa.bool_()),
    ("first_l", pa.int64()), ("inner_l", pa.int64()), ("inner_n", pa.int64()), ("next_l", pa.int64()),
]
_TYPES = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
_PARTS_SCHEMA = ", ".join(f"{n} {_TYPES[t]}" for n, t in _PARTS)


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, digest, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    turn = F.struct(F.col("turn"), F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary")).alias("digest"), words.alias("words"))
    known = conversations.where(F.col("conv_id").isNotNull())
    return known.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key, words): the digests of each rebuilt conversation, one after the other, and words by turn."""
    heads = turns.select(F.col("conv_id").alias("first"), F.slice("turns", 1, MOST_SHARED - 1).alias("head"))
    own = turns.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", shared_turns(F.col("conv_id")))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    both = own.join(heads, "first", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", F.expr("slice(turns, 1, 0)")), 1, F.col("h")), rest).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return both.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys: how many ids, the least, and the digest of all in order."""
    key, held, done = None, None, []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done))
        kinds = (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "words", "cnt", "conv_id", "ends"])

    for batch in batches:
        for k, words, conv in zip(batch.column("key").to_pylist(), batch.column("words"), batch.column("conv_id").to_pylist()):
            if k == key:
                held[1] += 1
                held[3].update(b",%d" % conv)
                continue
            if held:
                done.append((key, *held[:3], held[3].hexdigest()))
            key, held = k, [words.as_py(), 1, conv, hashlib.sha256(b"%d" % conv)]
            if len(done) == 4096:
                yield rows()
                done = []
    if held:
        done.append((key, *held[:3], held[3].hexdigest()))
        yield rows()


def sequences(conversations: DataFrame) -> DataFrame:
    """(key, words, cnt, conv_id, ends): the distinct rebuilt conversations."""
    return conversations.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "words", "conv_id").mapInArrow(_runs, _SEQUENCE)


def _with_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(batch), pa.int64()), *batch.columns], ["block", *batch.schema.names])


def common(a: bytes, b: bytes) -> int:
    """How many whole digests two keys share from the start."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    x, y = (np.frombuffer(k, np.uint8, n * DIGEST) for k in (a, b))
    return int(np.argmax(x != y)) // DIGEST


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [-1 if a is None else common(a, b) for a, b in zip(batch.column("before").to_pylist(), batch.column("first").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("place"), pa.array(shared, pa.int64())], ["block", "place", "first_l"])


def borders(blocks: DataFrame) -> dict[int, tuple[int, int, int]]:
    """By block: its place, L of its first sequence, and L of the next block's first one (-1 at either end)."""
    order = Window.orderBy("first")
    ends = blocks.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    rows = ends.select("block", "first", F.lag("last").over(order).alias("before"), F.row_number().over(order).cast("long").alias("place")).mapInArrow(_borders, "block long, place long, first_l long").collect()
    rows.sort(key=lambda r: r["place"])
    return {r["block"]: (i, r["first_l"], n["first_l"] if n else -1) for i, (r, n) in enumerate(zip(rows, [*rows[1:], None]))}


class _Entry:
    """A node on the stack, of this block or (``outside``) of an earlier one, with the sums so far of what lies below it."""

    __slots__ = ("depth", "outside", "n", "leaves", "least", "mass", "fresh", "children", "ahead", "ends", "waiting")

    def __init__(self, depth: int, outside: bool, fresh: int = 0, ahead: int = 0, ends: str = _EMPTY):
        self.depth, self.outside, self.fresh, self.ahead, self.ends = depth, outside, fresh, ahead, ends
        self.n = self.leaves = self.mass = self.children = 0
        self.least, self.waiting = _FAR, []

    def add(self, other: "_Entry") -> None:
        self.n += other.n
        self.leaves += other.leaves
        self.mass += other.mass
        self.fresh += other.fresh
        self.least = min(self.least, other.least)

    def row(self, kind: str, block: int) -> dict:
        return {"kind": kind, "block": block, "depth": self.depth, "conv_id": self.least, "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "mass": self.mass, "fresh": self.fresh, "ahead": self.ahead, "ends_sha256": self.ends}


def block_parts(rows: list[dict], place: int, first_l: int, next_l: int) -> list[dict]:
    """What one block of sorted sequences gives; see ``_PARTS``.

    mass: for each conversation, the words of all its turns; fresh: the words of
    new turns; ahead: the words of the turns above a node. A node saves
    mass - n_convs * ahead - fresh.
    """
    out: list[dict] = []
    stack = [_Entry(d, True) for d in range(first_l + 1)]
    whole, inner, inner_n, before = _Entry(-1, True), _FAR, 0, b""

    def close(least: int) -> None:
        while stack and stack[-1].depth > least:
            node = stack.pop()
            if not node.children and not node.outside:
                node.leaves = 1
                whole.leaves += 1
            if stack:
                stack[-1].add(node)
            if node.outside:
                out.append(node.row("chain", place))
                continue
            row = node.row("node", place) | {"saved_tokens": node.mass - node.n * node.ahead - node.fresh}
            for child in node.waiting:
                out.append(child | {"kind": "node", "parent_conv_id": node.least})
            if not stack:
                out.append(row)
            elif stack[-1].outside:
                out.append(row | {"kind": "child", "outside": True})
            else:
                stack[-1].waiting.append(row)

    for i, r in enumerate(rows):
        shared = first_l if i == 0 else common(before, r["key"])
        before = r["key"]
        if i:
            inner_n = 1 if shared < inner else inner_n + (shared == inner)
            inner = min(inner, shared)
        close(shared)
        total, ahead = sum(r["words"]), sum(r["words"][:shared]) if shared > 0 else 0
        for depth in range(shared + 1, len(r["words"]) + 1):
            own = r["words"][depth - 1] if depth else 0
            if stack:
                stack[-1].children += 1
            stack.append(_Entry(depth, False, own, ahead, _EMPTY if depth < len(r["words"]) else r["ends"]))
            ahead += own
            whole.fresh += own
        top = stack[-1]
        top.n, top.mass, top.least = r["cnt"], r["cnt"] * total, r["conv_id"]
        whole.n, whole.mass, whole.least = whole.n + top.n, whole.mass + top.mass, min(whole.least, top.least)
    close(next_l)
    while stack and not stack[-1].outside:
        node = stack.pop()
        if stack and not stack[-1].outside:
            stack[-1].add(node)
        out += [child | {"kind": "child", "outside": False} for child in node.waiting]
        out.append(node.row("open", place) | {"outside": bool(stack) and stack[-1].outside})
    out.append(whole.row("block", place) | {"first_l": first_l, "inner_l": inner, "inner_n": inner_n, "next_l": next_l})
    return out


def parts(blocks: DataFrame, at: dict[int, tuple[int, int, int]]) -> DataFrame:
    """The parts of all blocks."""

    def of_block(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["key", "words", "cnt", "conv_id", "ends"]).to_pylist(), key=lambda r: r["key"])
        found = block_parts(rows, *at[table.column("block")[0].as_py()])
        return pa.table({name: pa.array([r.get(name) for r in found], kind) for name, kind in _PARTS})

    return blocks.groupBy("block").applyInArrow(of_block, _PARTS_SCHEMA)


@dataclass
class Minima:
    """Minima and sums of all blocks in order: a few numbers for each."""

    first_l: np.ndarray
    inner_l: np.ndarray
    inner_n: np.ndarray
    next_l: np.ndarray
    n: np.ndarray
    leaves: np.ndarray
    mass: np.ndarray
    fresh: np.ndarray
    least: np.ndarray

    def end(self, block: int, depth: int) -> int:
        """The block in which a node that is open at the end of ``block`` ends: the nearest with a smaller value."""
        lowest = np.minimum(self.inner_l, self.next_l)
        width, at = 64, block + 1
        while at < len(lowest):
            below = np.flatnonzero(lowest[at : at + width] < depth)
            if len(below):
                return at + int(below[0])
            at, width = at + width, 2 * width
        raise ValueError(f"no end of the node at depth {depth} of block {block}")

    def origin(self, block: int, depth: int) -> int:
        """The block in which the node of an earlier block began that ``block`` starts in at ``depth``."""
        lowest = np.minimum(self.inner_l, self.first_l)
        width, at = 64, block
        while at > 0:
            low = max(0, at - width)
            below = np.flatnonzero(lowest[low:at] < depth)
            if len(below):
                return low + int(below[-1])
            at, width = low, 2 * width
        raise ValueError(f"no origin of the node at depth {depth} in block {block}")

    def children(self, a: int, b: int, depth: int) -> int:
        """How many children of a node at ``depth`` that spans the blocks from a to b begin there."""
        return int((self.first_l[a:b] == depth).sum() + self.inner_n[a:b][self.inner_l[a:b] == depth].sum())


def _minima(found: DataFrame) -> Minima:
    rows = sorted(found.where("kind = 'block'").select("block", "first_l", "inner_l", "inner_n", "next_l", "n_convs", "n_leaves", "mass", "fresh", "conv_id").collect())
    return Minima(*(np.array(c, np.int64) for c in list(zip(*rows))[1:]))


def _reach(opens: DataFrame, minima: Minima) -> DataFrame:
    """Open nodes with the sums of the blocks that they span, and the block where they end."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.concatenate([[0], np.cumsum(getattr(minima, v))]) for k, v in (("n_convs", "n"), ("n_leaves", "leaves"), ("mass", "mass"), ("fresh", "fresh"))}
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                a, r["end"] = r["block"] + 1, minima.end(r["block"], r["depth"])
                for name, ahead in sums.items():
                    r[name] += int(ahead[r["end"]] - ahead[a])
                r["conv_id"] = min(r["conv_id"], int(minima.least[a : r["end"]].min(initial=_FAR)))
                r["n_children"] += minima.children(a, r["end"], r["depth"])
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("end", pa.int64())))

    return opens.mapInArrow(add, _PARTS_SCHEMA + ", end long")


def _with_origin(rows: DataFrame, minima: Minima) -> DataFrame:
    """Rows with ``origin``, the block in which their parent began."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[int, int], int] = {}
            found = []
            for block, depth, outside in zip(*(batch.column(c).to_pylist() for c in ("block", "depth", "outside"))):
                if outside and (block, depth) not in known:
                    known[block, depth] = minima.origin(block, depth - 1)
                found.append(known[block, depth] if outside else block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "origin"])

    return rows.mapInArrow(add, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", origin long")


def prefix_trie(conversations: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: see ``_COLUMNS``.

    ``n_blocks``: into how many blocks to cut the sorted sequences (by default,
    as many as Spark's shuffle partitions); the result does not depend on it.
    """
    spark = conversations.sparkSession
    passing, kept = Scratch(spark), Scratch(spark)
    turns = passing.write(own_turns(conversations.select("conv_id", "turn", "role", "text")), "turns")
    distinct = passing.write(sequences(rebuilt(turns)), "sequences")
    ranges = distinct.repartitionByRange("key") if n_blocks is None else distinct.repartitionByRange(n_blocks, "key")
    blocks = passing.write(ranges.sortWithinPartitions("key").mapInArrow(_with_block, "block long, " + _SEQUENCE), "blocks")
    at = borders(blocks)
    if not at:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _COLUMNS))
    found = kept.write(parts(blocks, at), "parts")
    minima = _minima(found)
    passing.drop()
    tails = found.where("kind = 'chain'").select(F.col("block").alias("end"), "depth", *[F.col(c).alias(f"{c}_") for c in ("conv_id", "n_convs", "n_children", "n_leaves", "mass", "fresh")])
    ended = _reach(found.where("kind = 'open'"), minima).join(tails, ["end", "depth"])
    sums = {c: F.col(c) + F.col(f"{c}_") for c in ("n_convs", "n_children", "n_leaves", "mass", "fresh")}
    ended = ended.select("block", "depth", "outside", "ahead", "ends_sha256", F.least("conv_id", "conv_id_").alias("conv_id"), *[v.alias(c) for c, v in sums.items()])
    ended = kept.write(ended.withColumn("saved_tokens", F.col("mass") - F.col("n_convs") * F.col("ahead") - F.col("fresh")), "ended")
    rest = [c for c in _COLUMNS if c != "parent_conv_id"]
    children = found.where("kind = 'child'").select("block", "outside", *rest).unionByName(ended.select("block", "outside", *rest))
    above = ended.select(F.col("block").alias("origin"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    placed = _with_origin(children.where("depth > 0"), minima).join(above, ["origin", "depth"], "left").select(*_COLUMNS)
    roots = children.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*_COLUMNS)
    return found.where("kind = 'node'").select(*_COLUMNS).unionByName(placed).unionByName(roots)
