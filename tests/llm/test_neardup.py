"""Near duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from readprism.llm import neardup as N
from readprism.llm.components import components
from readprism.llm.shared import Scratch, materialize


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(rows, p):
    full = [sets(t, p.shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(full[i] & full[j])
            if full[i] and full[j] and 100 * shared >= p.percent * (len(full[i]) + len(full[j]) - shared):
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in ids.items()}
    return [(rows[i][0], len(full[i]), least[find(i)]) for i in range(len(rows))]


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 150]))]
        out += [(len(out) + i, " ".join(edited(base, rng.choice([0, 0, 1, 2, 4]), rng))) for i in range(rng.choice([1, 2, 12]))]
    hot = [f"h{i}" for i in range(120)]
    out += [(1000 + i, " ".join(edited(hot, 2, rng))) for i in range(150)]
    out += [(2000 + i, " ".join(hot)) for i in range(80)]
    out += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "one"), (3004, "ONE"), (3005, "two words"), (None, "one"), (None, None), (3006, "É " * 50), (3003, "one")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("p", [N.NearDup(), N.NearDup(shingle=3, percent=85, bands=16)])
def test_against_all_pairs(spark, rows, p, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "MEMBERS", 8)
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], "doc_id long, text string, node int, key int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df, p).collect()), key=str)
    assert got == sorted(brute(rows, p), key=str)


def test_deduplicate(spark, rows):
    names = ["keep_id", "keep_key", "row", "id_key", "row_key", "root", "goes", "mark_word", "mark_bits", "node", "id", "key", "size", "sketch", "bands", "__row_key"]
    df = spark.createDataFrame([(k, t, *range(len(names))) for k, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = materialize(N.deduplicate(df), "kept")
    assert kept.columns == df.columns and kept.schema == df.schema and kept.select(*names).distinct().count() == 1
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    components_ = {c for k, n, c in brute(rows, N.NearDup()) if n}
    assert sorted({k for k, t in found if sets(t, 5)}) == sorted(components_)
    assert sum(not sets(t, 5) for _, t in found) == len({(k, t) for k, t in rows if not sets(t, 5)})


def test_deduplicate_by_component_not_by_id(spark):
    rng = random.Random(3)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(14)]
    rows = [(None, t) for t in texts[:8]] + [(None, texts[0]), (None, texts[1] + " more")] + [(7, t) for t in texts[8:12]] + [(7, texts[8]), (9, texts[12]), (None, texts[12] + " more"), (None, texts[13]), (7, texts[13] + " more")]
    kept = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    base = {t.removesuffix(" more") for _, t in kept}
    assert len(kept) == 14 and base == set(texts)
    assert {k for k, t in kept if t.removesuffix(" more") in texts[12:]} == {9, 7} and sum(k is None for k, _ in kept) == 8


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0 and N.deduplicate(df).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(4)
    shared, p = rng.integers(0, 1 << 63, 900, dtype=np.uint64), N.NearDup()
    for own in (20, 60, 100):
        both = []
        for _ in range(2):
            values = np.concatenate([shared, rng.integers(0, 1 << 63, own, dtype=np.uint64)])
            both.append(N.odd_sketches(N.minhashes(values, np.array([0, len(values)]), p.samples), p.bits)[0])
        z = np.bitwise_count(both[0] ^ both[1]).sum()
        assert abs(N.estimate(z, p.samples, p.bits) - 900 / (900 + 2 * own)) < 0.13


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (26, 25), (24, 24)] + [(8, i) for i in range(100, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert all(got[n] == 1 for n in (2, 3, 4)) and got[26] == 25 and all(got[i] == 8 for i in range(100, 150)) and not {24, 8, 1} & set(got)


def test_copies_changed_in_places_of_their_own_are_joined_through_what_they_share(spark, monkeypatch):
    """No two copies are linked, each is with the original: no pairs are left for the cells of all pairs."""
    words = [f"w{i}" for i in range(200)]
    rows = [(300, " ".join(words))]
    for i in range(60):
        own = list(words)
        for j in range(4):
            own[(3 + i * 3 + j * 50) % 200] = f"x{i}y{j}"
        rows.append((i, " ".join(own)))
    seen, rest = [], N._rest_links
    monkeypatch.setattr(N, "_rest_links", lambda buckets, roots, *more: seen.append((roots.count(), roots.select("root").distinct().count())) or rest(buckets, roots, *more))
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), N.NearDup(shingle=3, percent=85, bands=16)).collect()
    assert {r["component_id"] for r in found} == {0} and seen == [(60, 1)]
