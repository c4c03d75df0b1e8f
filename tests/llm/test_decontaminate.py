"""Spaced seeds: exact, substituted and partial leaks, and clean documents."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readprism.llm import decontaminate as D
from readprism.llm.shared import materialize


def text(rng, n):
    return [f"v{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    items = [text(rng, n) for n in (40, 40, 25, 14, 9, 5)]
    around = lambda mid: " ".join(text(rng, 60) + mid + text(rng, 60))
    spaced = list(items[0])
    for i in range(6, 40, 9):
        spaced[i] = "changed"
    docs = {
        1: around(items[0]), 2: around(items[1]).upper().replace(" ", "!! "), 3: around(spaced), 4: around(items[2][:20]), 5: around(items[3]), 6: around(items[4]),
        7: " ".join(items[0]), 8: around(items[0]) + " " + around(items[1]), 9: around(items[0][:9]), 10: around(text(rng, 300)), 11: None, 12: "", 13: around(items[5]),
        14: around(items[0][:6] + text(rng, 6) + items[0][20:26]),
    }
    rows = [*((k, t, 1, "x") for k, t in docs.items()), (None, around(items[1]), 1, "x"), (1, docs[1], 1, "x")]
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate(items)] + [(90, None, 0), (91, "", 0), (None, " ".join(items[3]), 0)], "item_id long, text string, doc_id int")
    return spark.createDataFrame(rows, "doc_id long, text string, start int, words string").repartition(3), bench


def test_leaks(tables):
    docs, bench = tables
    found = D.contaminations(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert pairs == {(1, 0), (2, 1), (3, 0), (4, 2), (5, 3), (5, None), (6, 4), (7, 0), (8, 0), (8, 1), (13, 5), (None, 1)}
    by = {(r.doc_id, r.item_id): r for r in found}
    assert (by[1, 0].doc_start, by[1, 0].item_start, by[1, 0].n_words, by[1, 0].n_equal) == (60, 0, 40, 40)
    assert by[3, 0].n_equal == 36 and by[3, 0].n_words == 40


def test_clean_documents_stay(tables):
    docs, bench = tables
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [9, 10, 11, 12, 14]


def test_empty(tables):
    docs, bench = tables
    assert D.contaminations(docs.where("false"), bench).count() == 0
    assert D.decontaminate(docs, bench.where("false")).count() == docs.count()


def test_best_overlap_is_maximal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        doc, item = rng.integers(0, 2, 20), rng.integers(0, 2, 12)
        shift = int(rng.integers(-8, 16))
        at, n, equal = D.best_overlap(doc, item, shift, D.Overlap())
        scores = [0] + [sum(1 if doc[k + shift] == item[k] else -2 for k in range(i, j)) for i in range(12) for j in range(i + 1, 13) if i + shift >= 0 and j + shift <= 20]
        assert equal - 2 * (n - equal) == max(scores)


def test_no_accepted_pattern_lacks_a_seed():
    for n in range(D.SHORTEST, 17):
        for gaps in itertools.combinations(range(1, n - 1), min(n // 4, n - D.SHORTEST)):
            item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            doc = item.copy()
            doc[list(gaps)] += np.uint64(7)
            one, two = (dict(zip(*map(np.ndarray.tolist, D.seeds(x, np.array([0, n]), ())))) for x in (item, doc))
            assert any(two.get(v) == at for v, at in one.items()), (n, gaps)


def test_widest_overlap_is_maximal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        doc, item = (rng.random(20) < 0.25).astype(int), np.zeros(12, int)
        shift = int(rng.integers(-8, 16))
        at, n, equal = D.widest_overlap(doc, item, shift, D.Overlap())
        same = {i: doc[i + shift] == item[i] for i in range(12) if 0 <= i + shift < 20}
        every = [(0, 0)] + [(sum(same[k] for k in range(i, j)), i - j) for i in same for j in range(i + 1, 13) if j - 1 in same and 4 * sum(same[k] for k in range(i, j)) >= 3 * (j - i)]
        assert (equal, -n) == max(every) and equal == sum(same[k] for k in range(at, at + n))


def test_short_and_evenly_substituted_copies(spark):
    rng = random.Random(6)
    items = [text(rng, n) for n in (15, 20, 40, 60, 10, 12)]
    places = [(2, 12), (4, 9, 14, 19), range(3, 40, 4), range(3, 60, 4), (2, 7), (2, 5, 8)]
    rows = []
    for i, (item, gaps) in enumerate(zip(items, places)):
        copy = [f"changed{k}" if k in gaps else w for k, w in enumerate(item)]
        rows.append((i, " ".join(text(rng, 30) + copy + text(rng, 30))))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminations(docs, bench).collect()} == {(i, i) for i in range(6)}
    assert D.decontaminate(docs, bench).count() == 0


def accepted(doc, item):
    """Whether any stretch of any diagonal is an overlap, by trying all."""
    n = len(item)
    if n < 5:
        return doc == item
    if n < 8:
        return any(doc[i : i + n] == item for i in range(len(doc) - n + 1))
    for diagonal in range(-n + 1, len(doc)):
        same = [0]
        for i in range(n):
            same.append(same[-1] + (0 <= i + diagonal < len(doc) and doc[i + diagonal] == item[i]))
        for i in range(n):
            for j in range(i + 8, n + 1):
                equal = same[j] - same[i]
                if 0 <= i + diagonal and j + diagonal <= len(doc) and equal >= min(13, max(8, 0.7 * n)) and equal >= 0.75 * (j - i):
                    return True
    return False


def test_against_all_stretches(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(60)}"
    items = [[word() for _ in range(n)] for n in (1, 3, 4, 5, 7, 8, 10, 14, 20, 30)] + [["la"] * 12, ["a", "b"] * 10]
    docs = [["la"] * 40, ["a", "b"] * 30 + ["la"] * 11, []]
    for item in items:
        docs += [item, item + ["x"], [word() for _ in range(5)] + item + [word() for _ in range(3)]]
        for share in (0.1, 0.25, 0.35):
            docs.append([word() for _ in range(rng.randrange(9))] + [w if rng.random() > share else word() for w in item] + [word() for _ in range(rng.randrange(9))])
        docs.append(item[: len(item) * 3 // 4] + [word()])
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(None, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminations(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()}
    assert found == {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if accepted(d, item)}


def test_long_overlaps_and_repetitive_texts(spark):
    rng = random.Random(14)
    item, gap = text(rng, 500), text(rng, 130)
    cut = item[:200] + gap + item[330:]
    rows = [(1, " ".join(text(rng, 900) + item + text(rng, 900))), (2, " ".join(text(rng, 50) + cut)), (3, "ha " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("bad_id", "own_id", "row", "region", "words", "seeds", "start")})
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "ha " * 40)], "item_id long, text string").withColumn("item", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_words, r.n_equal) for r in D.contaminations(docs, bench).collect()}
    assert got[2, 7] == (50, 0, 200, 200)
    assert got[1, 7] == (900, 0, 500, 500) and got[3, 8] == (0, 0, 40, 40) and len(got) == 3
    kept = materialize(D.decontaminate(docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("clean"))), bench), "kept")
    assert kept.columns == docs.columns and kept.count() == 3
