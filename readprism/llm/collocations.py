"""Phrase collocations: frequent phrases whose words occur together more often than apart.

Texts are written once as shards of plain text: A-Z in lower case, one space
between words, a line break between pieces, so that a phrase between two spaces
is guarded by delimiters on both sides. Then

1. every shard sends the sketch cells of its phrases of one to five words, with
   saturating counts, packed by cell; cells are dealt out over the tasks in groups, so
   the sketch grows with the corpus and no task or broadcast holds it whole;
2. a cell whose sum reaches ``least`` is an upper bound that does; each shard gets
   back those of its own cells;
3. a shard's phrases with such a cell, as have all phrases within them, are
   compiled into Aho-Corasick automata of bounded size with their guards, and the shard is
   scanned for overlapping matches. Counts go back to the groups of cells, packed, and are
   summed over shards there; the exact threshold follows.

A phrase within a frequent phrase is at least as frequent, and hot cells are the
same for all shards, so every phrase of ``least`` occurrences is counted in every
shard that has it. Within a shard, phrases with one 64-bit hash are one phrase (of
a million phrases two share one once in 4e7 shards). Scores are integers of up to 38 digits.
A phrase within an equally frequent longer one is also within one that has just one word
more, so only those are compared.

Defined results: null and empty texts have no words; a null ``lang`` is ``und``.
Rows that repeat count again. An empty table has no phrases. Other columns are not
read. A piece of text longer than a shard is a shard of its own, read whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprism.llm.shared import Scratch
from readprism.llm.words import LOWER, hash_windows, split_hashes, string_bytes

LONGEST = 5
LEAST = 100
TOP = 2000
SHARD = 8 << 20
#: Bytes of a shard whose cells are counted at once.
COUNTED = 2 << 20
#: Letters of the phrases in one automaton.
COMPILED = 1 << 20
#: Phrases of the corpus for each cell, and cells of a group.
LOAD, CELLS = 8, 1 << 21
UNKNOWN = "und"
_CODEC = pa.Codec("zstd", 1)
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes(LOWER).translate(bytes.maketrans(_BREAKS + b"\t", b"\n" * len(_BREAKS) + b" "))
_SPLIT = np.zeros(256, bool)
_SPLIT[[0x20, 0x0A]] = True


def plain_text(text: bytes) -> bytes:
    """`` word word \\n word ``: single spaces around words, a line break where pieces meet."""
    text = b" " + text.translate(_PLAIN).replace(b"\n", b" \n ") + b" "
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    while b"\n \n" in text:
        text = text.replace(b"\n \n", b"\n")
    return text


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """A plain text in parts of about ``size`` bytes, cut where pieces meet."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b"\n", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _compressed(text: bytes) -> bytes:
    return _CODEC.compress(text, asbytes=True)


def _decompressed(packed: bytes, size: int) -> bytes:
    return _CODEC.decompress(packed, size, asbytes=True)


def shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, n_words, size, packed): the plain text of ``docs`` (lang, text) by language, compressed, in shards of about ``SHARD`` bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size, held = TaskContext.get().partitionId(), 0, 0, {}

        def rows() -> pa.RecordBatch:
            names = sorted(held)
            texts = [b"\n".join(held[k]) for k in names]
            words = [t.count(b" ") - t.count(b"\n") - 1 for t in texts]
            shard = pa.array([(task << 32) + made] * len(names), pa.int64())
            sizes, packed = pa.array(map(len, texts), pa.int64()), pa.array(map(_compressed, texts), pa.binary())
            return pa.RecordBatch.from_arrays([shard, pa.array(names, pa.string()), pa.array(words, pa.int64()), sizes, packed], ["shard", "lang", "n_words", "size", "packed"])

        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1], offsets[1:]):
                for part in _parts(plain_text(data[a:b].tobytes()), SHARD):
                    if not part.strip(b" \n"):
                        continue
                    held.setdefault(UNKNOWN if lang is None else lang, []).append(part)
                    size += len(part)
                    if size >= SHARD:
                        yield rows()
                        made, size, held = made + 1, 0, {}
        if held:
            yield rows()

    return docs.select("lang", "text").mapInArrow(cut, "shard long, lang string, n_words long, size long, packed binary")


def _texts(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, str, bytes]]:
    """(shard, lang, plain text) of rows of ``shards``, one text unpacked at a time."""
    for shard, lang, size, packed in zip(*(rows.column(c).to_pylist() for c in ("shard", "lang", "size", "packed"))):
        yield shard, lang, _decompressed(packed, size)


class Phrases:
    """Hashes of all phrases of a shard's text in one language."""

    def __init__(self, lang: str, text: bytes):
        self.data = np.frombuffer(text, np.uint8)
        self.hashes = split_hashes(self.data, _SPLIT)
        word = ~_SPLIT[self.data]
        self.starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        self.ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
        self.piece = np.cumsum(self.data == 0x0A)[self.starts]
        self.seed = int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, whether they lie in one piece)."""
        hashes = hash_windows(self.hashes, n, self.seed)
        return hashes, self.piece[: len(hashes)] == self.piece[n - 1 : n - 1 + len(hashes)]


def _cells(hashes: np.ndarray, groups: int) -> np.ndarray:
    """group * CELLS + cell of each hash."""
    return (hashes >> np.uint64(24)) % np.uint64(groups) * np.uint64(CELLS) + (hashes & np.uint64(CELLS - 1))


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending cells of one group with counts: low bytes of the steps, their high bytes, and counts as bytes, compressed.

    Wider steps pass over cells with a count of 0.
    """
    steps = np.diff(cells.astype(np.int64), prepend=-1) - 1
    places = np.cumsum((steps >> 16) + 1) - 1
    size = int(places[-1]) + 1 if len(places) else 0
    planes = np.full((3, size), 0xFF, np.uint8)
    planes[2] = 0
    planes[0, places], planes[1, places], planes[2, places] = steps & 0xFF, (steps >> 8) & 0xFF, np.minimum(counts, 255)
    return size.to_bytes(4, "little") + _compressed(planes.tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``_pack`` had, with its cells of count 0."""
    size = int.from_bytes(packed[:4], "little")
    planes = np.frombuffer(_decompressed(packed[4:], 3 * size), np.uint8).reshape(3, size)
    return np.cumsum(planes[0].astype(np.int64) + (planes[1].astype(np.int64) << 8) + 1) - 1, planes[2]


def _packed_cells(phrases: Phrases, groups: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(group, packed cells) of all phrases of a text."""
    seen = []
    for n in range(1, LONGEST + 1):
        hashes, whole = phrases.of(n)
        seen.append(_cells(hashes[whole], groups))
    cells, counts = np.unique(np.concatenate(seen), return_counts=True)
    edges = np.searchsorted(cells, np.arange(groups + 1, dtype=np.uint64) * np.uint64(CELLS))
    for g, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            yield g, _pack(cells[a:b] - np.uint64(g * CELLS), np.minimum(counts[a:b], most))


def sketch_rows(texts: DataFrame, groups: int, least: int) -> DataFrame:
    """(shard, grp, packed): the cells that phrases of each shard fall into, with counts, by group of cells."""
    most = min(least, 255)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, text in _texts(batch):
                for part in _parts(text, COUNTED):
                    own = list(_packed_cells(Phrases(lang, part), groups, most))
                    columns = [pa.array([shard] * len(own), pa.int64()), pa.array([g for g, _ in own], pa.int64()), pa.array([p for _, p in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "grp", "packed"])

    return texts.select("shard", "lang", "size", "packed").mapInArrow(rows, "shard long, grp long, packed binary")


def hot_cells(rows: DataFrame, least: int) -> DataFrame:
    """(shard, hot): those of a shard's cells whose sum over all shards reaches the threshold, as 64-bit numbers."""
    most = min(least, 255)

    def of_group(rows: pa.Table) -> pa.Table:
        first, sums = rows.column("grp")[0].as_py() * CELLS, np.zeros(CELLS, np.int64)
        packed = rows.column("packed").to_pylist()
        for p in packed:
            cells, counts = _unpack(p)
            sums[cells] += counts
        hot = sums >= most
        found = []
        for p in packed:
            cells, counts = _unpack(p)
            found.append((cells[hot[cells] & (counts > 0)] + first).tobytes())
        return pa.table({"shard": rows.column("shard"), "hot": pa.array(found, pa.binary())})

    return rows.groupBy("grp").applyInArrow(of_group, "shard long, hot binary").where(F.length("hot") > 0)


def _patterns(phrases: Phrases, text: bytes, groups: int, hot: np.ndarray) -> dict[str, int]:
    """The shard's phrases whose cells are hot, with those of all phrases within them; each between two spaces, with its group."""
    found, before = {}, None
    for n in range(1, LONGEST + 1):
        hashes, fine = phrases.of(n)
        if before is not None:
            fine = fine & before[: len(fine)] & before[1 : len(fine) + 1]
        at = np.flatnonzero(fine)
        cells = _cells(hashes[at], groups).astype(np.int64)
        place = np.minimum(np.searchsorted(hot, cells), len(hot) - 1)
        kept = hot[place] == cells
        at, cells = at[kept], cells[kept]
        before = np.zeros(len(hashes), bool)
        before[at] = True
        _, first = np.unique(hashes[at], return_index=True)
        for i, group in zip(at[first].tolist(), (cells[first] // CELLS).tolist()):
            found[text[phrases.starts[i] - 1 : phrases.ends[i + n - 1] + 1].decode()] = group
    return found


def _automata(patterns: list[str]) -> Iterator[ahocorasick.Automaton]:
    """Automata of all patterns, each of about ``COMPILED`` letters; a pattern's value is its place."""
    automaton, size = ahocorasick.Automaton(), 0
    for i, pattern in enumerate(patterns):
        automaton.add_word(pattern, i)
        size += len(pattern)
        if size >= COMPILED or i == len(patterns) - 1:
            automaton.make_automaton()
            yield automaton
            automaton, size = ahocorasick.Automaton(), 0


def count_phrases(texts: DataFrame, hot: DataFrame, groups: int) -> DataFrame:
    """(grp, lang, size, phrases, counts): a shard's phrases with hot cells, packed, and how often they occur in it, by group of cells."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        cells, rows = np.sort(np.frombuffer(b"".join(right.column("hot").to_pylist()), np.int64)), []
        for _, lang, data in _texts(left) if len(cells) else ():
            group, text = _patterns(Phrases(lang, data), data, groups, cells), data.decode()
            known, counts = sorted(group), Counter()
            for automaton in _automata(known):
                counts.update(i for _, i in automaton.iter(text))
            by_group: dict[int, list[int]] = {}
            for i in counts:
                by_group.setdefault(group[known[i]], []).append(i)
            for g, own in by_group.items():
                lines = "\n".join(known[i][1:-1] for i in sorted(own)).encode()
                rows.append((g, lang, len(lines), _compressed(lines), np.array([counts[i] for i in sorted(own)], np.int64).tobytes()))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        columns = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["grp", "lang", "size", "phrases", "counts"])

    return texts.select("shard", "lang", "size", "packed").groupBy("shard").cogroup(hot.groupBy("shard")).applyInArrow(scan, "grp long, lang string, size long, phrases binary, counts binary")


def frequent(counted: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, cnt): the sums of ``count_phrases`` over all shards that reach the threshold."""

    def of_group(rows: pa.Table) -> pa.Table:
        langs, phrases, counts = [], [], []
        for lang, size, packed, own in zip(*(rows.column(c).to_pylist() for c in ("lang", "size", "phrases", "counts"))):
            counts.append(np.frombuffer(own, np.int64))
            phrases.append(pa.array(_decompressed(packed, size).decode().split("\n"), pa.string()))
            langs.append(pa.repeat(lang, len(counts[-1])))
        flat = pa.table({"lang": pa.chunked_array(langs), "phrase": pa.chunked_array(phrases), "cnt": np.concatenate(counts)})
        sums = flat.group_by(["lang", "phrase"]).aggregate([("cnt", "sum")]).rename_columns({"cnt_sum": "cnt"})
        return sums.filter(pc.greater_equal(sums.column("cnt"), least)).select(["lang", "phrase", "cnt"])

    return counted.groupBy("grp").applyInArrow(of_group, "lang string, phrase string, cnt long")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): candidates by their lowest-scoring cut, without those inside an equally frequent longer one."""
    words = F.split("phrase", " ")
    phrases = counts.withColumn("m", F.size(words)).where("m > 1")
    cuts = phrases.select("lang", "phrase", "m", F.col("cnt").alias("a"), words.alias("w"), F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, m - k), ' ')").alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("cnt").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("cnt").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    found = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest.alias("cut"))
    within = F.array(*[F.array_join(F.slice(words, start, F.col("m") - 1), " ") for start in (1, 2)])
    covered = phrases.where("m > 2").select("lang", F.explode(within).alias("phrase"), F.col("cnt").alias("a")).distinct()
    return found.join(covered, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, by score and count descending, then phrase; first by parts, so no task ranks a language whole."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (lang, text)."""
    kept, passing = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    texts, seen = passing.measured(shards(docs), "shards", F.sum("n_words").alias("words"))
    groups = max(1, -(-LONGEST * (seen.words or 0) // (LOAD * CELLS)))
    hot = hot_cells(sketch_rows(texts, groups, least), least)
    counts = kept.write(frequent(count_phrases(texts, hot, groups), least), "phrases")
    totals = kept.write(texts.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    passing.drop()
    return ranked(scored(counts, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
