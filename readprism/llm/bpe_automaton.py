"""Byte-level BPE by a deterministic automaton, compiled from the merges of a public tokenizer.

Compiling starts from one state with an arc for each byte. A merge (a, b) -> c is
a gadget: the state that arcs of ``a`` lead to loses its arc ``b`` (it is copied
first if other arcs lead to it too), and every state that has an arc ``a`` gets
an arc ``c`` to where ``a b`` led; a pair that no path has gives nothing. So all arcs of one token lead to one state, and
the automaton is a table of those targets and, for each state, of the arcs it
lost, with the merge that took them: an arc of ``c`` is there unless it was lost,
or that of its left part was lost before ``c`` was made, and so on to the left.

A word has exactly one path of arcs that spell it, and so has each prefix of
it. Encoding goes through the word once, byte by byte: a trie gives the tokens
that end there, and the transition table says which of them follows the state
reached where it starts. Decoding emits the arcs' labels. Words come from the
usual pattern of byte-level tokenizers; added tokens are cut out of the text first.

Spark deals out the texts; a task keeps the paths of at most ``HELD`` words.

Defined results: a null or empty text has no ids (an empty array), null or
empty ids no text (an empty one). Ids outside of the vocabulary are left out when
decoding, and bytes that are not UTF-8 become U+FFFD. Rows keep all their columns;
a new column whose name is taken gets ``_`` after it. Rows may repeat, an empty
table stays empty, and texts of any length are read whole.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from readprism.llm.shared import free_name
from readprism.llm.words import slices

#: Fixed value: how byte-level tokenizers split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HELD = 1 << 19
_KEPT_BYTES = 64
_NEVER = 1 << 40
_SLICE = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spine(left: dict[int, tuple[int, int]], token: int) -> tuple[tuple[int, int], ...]:
    """A token, its left part, the left part of that, ...; each with the merge that last could use it so."""
    out, limit = [], _NEVER - 1
    while token >= 0:
        out.append((token, limit))
        token, limit = left[token]
    return tuple(out)


def _there(gone: dict[int, int], spine: tuple[tuple[int, int], ...]) -> bool:
    """Whether a state that lost the arcs ``gone`` has an arc of a token."""
    return all(gone.get(t, _NEVER) > limit for t, limit in spine)


@dataclass
class Automaton:
    """The compiled tables; tokens and states are numbers."""

    labels: list[bytes | None]
    #: Tokens of the vocabulary's bytes and merges: (token, its left part or -1, the merge that made it or -1).
    made: np.ndarray
    #: The state to which the arcs of each token lead.
    target: np.ndarray
    #: Arcs that states lost: (state, token, merge).
    lost: np.ndarray
    added: dict[str, int]

    @property
    def states(self) -> int:
        return int(self.target.max(initial=0)) + 1

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("labels", "made", "target", "lost", "added")}

    @cached_property
    def _lost(self) -> list[dict[int, int]]:
        found: list[dict[int, int]] = [{} for _ in range(self.states)]
        for state, token, merge in self.lost.tolist():
            found[state][token] = merge
        return found

    @cached_property
    def _tokens(self) -> ahocorasick.Automaton:
        """A trie of labels: its values are a token, the label's length, and the token's left parts with the merge that followed each."""
        left = {t: (part, merge) for t, part, merge in self.made.tolist()}
        trie = ahocorasick.Automaton()
        for token in left:
            trie.add_word(self.labels[token].decode("latin-1"), (token, len(self.labels[token]), _spine(left, token)))
        trie.make_automaton()
        return trie

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc of ``token``."""
        spine = self._tokens.get(self.labels[token].decode("latin-1"))[2]
        return _there(self._lost[state], spine)

    def path(self, word: bytes) -> array:
        """The tokens of one word."""
        n, lost, target = len(word), self._lost, self._targets
        reached: list[dict[int, int] | None] = [lost[0]] + [None] * n
        arc = [(0, 0)] * (n + 1)
        for last, (token, size, spine) in self._tokens.iter(word.decode("latin-1")):
            to = last + 1
            if reached[to] is not None:
                continue
            gone = reached[to - size]
            for part, limit in spine:
                if part in gone and gone[part] <= limit:
                    break
            else:
                reached[to] = lost[target[token]]
                arc[to] = (token, to - size)
        out, at = [], n
        while at:
            token, at = arc[at]
            out.append(token)
        out.reverse()
        return array("i", out)

    @cached_property
    def _targets(self) -> list[int]:
        return self.target.tolist()

    @cached_property
    def _split(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")

    @cached_property
    def _held(self) -> "_Paths":
        return _Paths(self)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as the bytes of 32-bit numbers."""
        held = self._held
        if len(held) > HELD:
            held.clear()
        if not any(name in text for name in self.added):
            return b"".join(map(held.__getitem__, split_words(text)))
        parts = [np.int32(self.added[x]).tobytes() if i % 2 else b"".join(map(held.__getitem__, split_words(x))) for i, x in enumerate(self._split.split(text))]
        return b"".join(parts)

    @cached_property
    def _emitted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all labels' bytes, where each starts, its size)."""
        sizes = np.array([len(x or b"") for x in self.labels], np.int64)
        return np.frombuffer(b"".join(x or b"" for x in self.labels), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of rows of ids: row i has ``ids[bounds[i]:bounds[i + 1]]``."""
        data, starts, sizes = self._emitted
        known = (ids >= 0) & (ids < len(sizes))
        ids = np.where(known, ids, 0)
        n = np.where(known, sizes[ids], 0)
        ends = np.concatenate([[0], np.cumsum(n)])
        out = data[np.repeat(starts[ids] - ends[:-1], n) + np.arange(ends[-1])]
        edges = ends[bounds]
        heads = out[edges[:-1][edges[:-1] < len(out)]]
        text = out.tobytes()
        try:
            text.decode()
            if not ((heads & 0xC0) == 0x80).any():
                return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(text)).cast(pa.string())
        except UnicodeDecodeError:
            pass
        return pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])], pa.string())


class _Paths(dict):
    """Ids of words met before; long words are not kept."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        found = self.automaton.path(data).tobytes()
        if len(data) <= _KEPT_BYTES:
            self[word] = found
        return found


def compile_merges(labels: list[bytes | None], alphabet: list[int], merges: list[tuple[int, int, int]], added: dict[str, int]) -> Automaton:
    """The automaton of ``merges`` (left, right, token made), first things first, over the tokens of single bytes."""
    target = np.zeros(len(labels), np.int64)
    lost: list[dict[int, int]] = [{}]
    held_by = [_NEVER]  # the first state is also where words start, so it is never changed
    made = {t: (-1, -1) for t in alphabet}
    for k, (left, right, token) in enumerate(merges):
        if left not in made or right not in made or not _there(lost[target[left]], _spine(made, right)):
            continue  # an earlier merge always takes one of the two first
        state = int(target[left])
        target[token] = target[right]
        held_by[target[right]] += 1
        if held_by[state] > 1:
            held_by[state] -= 1
            held_by.append(1)
            lost.append(dict(lost[state]))
            target[left] = state = len(lost) - 1
        lost[state][right] = k
        made[token] = (left, k)
    gone = [(s, t, k) for s, arcs in enumerate(lost) for t, k in arcs.items()]
    return Automaton(labels, np.array([(t, *x) for t, x in made.items()], np.int64).reshape(-1, 3), target, np.array(gone, np.int64).reshape(-1, 3), added)


def load(path: str) -> Automaton:
    """The automaton of a byte-level BPE tokenizer's JSON file; ``ValueError`` for files of other kinds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and (spec.get("decoder") or {}).get("type") == "ByteLevel"
    if model.get("type") != "BPE" or not plain or not byte_level or spec.get("normalizer"):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    added = {}
    for t in spec.get("added_tokens") or []:
        if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added token {t['content']!r} has rules of its own")
        added[t["content"]] = t["id"]
    letters, vocab = _byte_letters(), model["vocab"]
    labels: list[bytes | None] = [None] * (max([*vocab.values(), *added.values()]) + 1)
    for name, token in vocab.items():
        labels[token] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
    for name, token in added.items():
        labels[token] = name.encode()
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    if len({a + b for a, b in pairs}) < len(pairs) or not all(c in vocab for c in letters):
        raise ValueError(f"{path}: a token has two merges, or a byte has no token")
    return compile_merges(labels, [vocab[c] for c in letters], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], added)


_PATTERN = regex.compile(WORDS)


def _unsettled() -> np.ndarray:
    """By code point: whether this Python's Unicode tables don't know it; the splitting library's tables may be older or newer."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


_UNSETTLED: list[np.ndarray] = []


def split_words(text: str) -> list[str]:
    """The words of a text. Where it has code points of unsettled kind, the tokenizers library splits it."""
    if text.isascii():
        return _PATTERN.findall(text)
    if not _UNSETTLED:
        _UNSETTLED.append(_unsettled())
    if not _UNSETTLED[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
        return _PATTERN.findall(text)
    from tokenizers import pre_tokenizers

    pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
    return [text[a:b] for _, (a, b) in pieces]


def _shipped(df: DataFrame, automaton: Automaton):
    """A function that gives the tables in a task; they go to every executor once, sized by the vocabulary."""
    sent = df.sparkSession.sparkContext.broadcast(automaton)
    return lambda: sent.value


def encode(docs: DataFrame, automaton: Automaton, text: str = "text", *, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the tokens of each whole text; on request also ``decoded``, the text that these ids give."""
    name, tables = free_name("ids", docs.columns), _shipped(docs, automaton)
    back = free_name("decoded", docs.columns)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables()
        for batch in slices(batches, text, _SLICE):
            rows = [own.encode(x) if x else b"" for x in batch.column(text).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])
            ids = np.frombuffer(b"".join(rows), np.int32)
            added = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids))] + ([own.decode(ids, bounds)] if decoded else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, name, back][: batch.num_columns + len(added)])

    added = [StructField(name, ArrayType(IntegerType()))] + ([StructField(back, StringType())] if decoded else [])
    return docs.mapInArrow(tokens, StructType([*docs.schema.fields, *added]))


def decode(docs: DataFrame, automaton: Automaton, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of each row's ids."""
    name, tables = free_name("decoded", docs.columns), _shipped(docs, automaton)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables()
        for batch in batches:
            column = batch.column(ids).cast(pa.large_list(pa.int64()))
            sizes = np.diff(column.offsets.to_numpy()) * np.asarray(column.is_valid())
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            values = column.flatten().fill_null(-1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode(values, bounds)], [*batch.schema.names, name])

    return docs.mapInArrow(texts, StructType([*docs.schema.fields, StructField(name, StringType())]))
