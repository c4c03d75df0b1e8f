"""Vectorised word and window hashes against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from readprism.llm import words as W


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 64)


def test_words_and_windows(small_pieces):
    rng, alphabet = random.Random(3), " \t\n\x0babAB€é\x1f"
    for t in range(150):
        rows = [None if rng.random() < 0.1 else "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(rng.randint(0, 8))]
        rows += ["x" * 9000 + " y"] * (t % 3 == 0)
        column = pa.array(rows, pa.string())
        if t % 2 and len(rows) > 2:
            column, rows = column.slice(1), rows[1:]
        hashes, bounds = W.word_hashes(column, lower=False)
        words = [re.findall(r"[^\x20\x09-\x0D]+", r or "") for r in rows]
        assert [len(w) for w in words] == list(np.diff(bounds))
        named = dict(zip([w for ws in words for w in ws], hashes))
        assert len(set(named.values())) == len(named)
        assert all(named[w] == h for w, h in zip([w for ws in words for w in ws], hashes))
        for k in (1, 3):
            for short in (True, False):
                values, edges = W.windows(hashes, bounds, k, short=short)
                expected = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if short and w else []) for w in words]
                assert [len(e) for e in expected] == list(np.diff(edges))
                seen = dict(zip([x for e in expected for x in e], values))
                assert len(set(seen.values())) == len(seen)
                assert [len(set(e)) for e in expected] == list(np.diff(W.distinct(values, edges)[1]))


def test_plain_words_and_prefixes():
    a, b = W.plain_word_hashes(pa.array(["Été, “trash”!! x", None, "été trash x"]), (4,))
    assert list(b) == [0, 3, 3, 6] and (a[:3] == a[3:]).all()
    c, _ = W.plain_word_hashes(pa.array(["trashed tras trashy"]), (4,))
    assert c[0, 1] == c[2, 1] and c[1, 0] == c[1, 1] and len({c[0, 0], c[1, 0], c[2, 0]}) == 3
