"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from readprism.llm import collocations as C


def by_hand(rows, least, top):
    n, f = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(lang, i + 1, s[2].decode(), *s[3:]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_plain_text():
    cases = {"": " ", "A  b\tC.d": " a b c \n d ", "..\r\n,": " \n ", " x ": " x ", "É Z": " É z "}
    for text, expected in cases.items():
        assert C.plain_text(text.encode()).decode() == expected


def test_parts_are_cut_between_pieces():
    rng = random.Random(4)
    for _ in range(200):
        text = C.plain_text("".join(rng.choice("ab  .") for _ in range(rng.randint(0, 400))).encode())
        parts = list(C._parts(text, 40))
        pieces = lambda t: [p.split() for p in t.split(b"\n") if p.split()]
        assert [p for t in parts for p in pieces(t)] == pieces(text)
        assert all(t.count(b" ") - t.count(b"\n") - 1 == len(t.replace(b"\n", b" ").split()) for t in parts if t.strip(b" \n"))


def test_packed_cells():
    rng = np.random.default_rng(1)
    for size in (0, 1, 50, 5000):
        cells = np.unique(rng.integers(0, C.CELLS, size))
        counts = rng.integers(1, 400, len(cells))
        got, n = C._unpack(C._pack(cells.astype(np.uint64), counts))
        assert (got[n > 0] == cells).all() and (n[n > 0] == np.minimum(counts, 255)).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "new", "York", "c d", "<x>", "a ", "…", "日本"]
    rows = []
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! ?"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", None, "und", "zh"]), rng.choice([text, text, None, text + " new york is big"])))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, top in ((10, 2000), (100, 7), (300, 50)):
        assert rows_of(C.collocations(docs, least=least, top=top)) == by_hand(rows, least, top)


def test_common_words_repeats_and_long_texts(spark):
    long = "one two three four five six, " * 40_000 + "the the the the the the the. " * 300
    rows = [("en", long)] + [("en", "the very same text of all")] * 150 + [("de", "")] + [(None, "x " * 500)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, shard int, phrase string")
    assert rows_of(C.collocations(docs)) == by_hand(rows, 100, 2000)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert rows_of(C.collocations(docs)) == []
    assert rows_of(C.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string"))) == []


def test_large_numbers_are_exact(spark):
    """Products beyond 64 bits, and quotients just below an integer."""
    rng, rows, expected = random.Random(9), [], {}
    for i in range(200):
        a = rng.randint(100, 10**11)
        left, right, n = rng.randint(a, 10**12), rng.randint(a, 10**12), 10**13 + 7
        rows += [("en", f"x{i} y{i}", a), ("en", f"x{i}", left), ("en", f"y{i}", right)]
        expected[f"x{i} y{i}"] = 1000 * a * n // (left * right)
    rows += [("en", "u v", 3 * 10**11 - 1), ("en", "u", 10**12), ("en", "v", 3 * 10**11)]
    expected["u v"] = 1000 * (3 * 10**11 - 1) * (10**13 + 7) // (10**12 * 3 * 10**11)
    counts = spark.createDataFrame(rows, "lang string, phrase string, cnt long")
    totals = spark.createDataFrame([("en", 10**13 + 7)], "lang string, n long")
    assert {r["phrase"]: r["score"] for r in C.scored(counts, totals).collect()} == expected
