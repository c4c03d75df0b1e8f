"""Url filter, mixing, substring deduplication and nearest neighbours on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from readprism.llm import mixture, rp_forest, substring_dedup, url_filter
from readprism.llm.shared import materialize

# --- urls ----------------------------------------------------------------------

URLS = [
    ("https://A.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("http://example.com/en/8#t", "example.com", "/en/8", "com/en/", "block"),
    ("http://x.net/de/1", "x.net", "/de/1", "net/de/", "allow"), ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("http://a.org/es/", "a.org", "/es/", "org/es/", "block"),
    ("http://a.org/es", "a.org", "/es", None, "allow"), ("http://casino-win.example.com", "casino-win.example.com", "", None, "block"),
    ("http://casinos.example.org/x", "casinos.example.org", "/x", None, "allow"), ("http://free-stuff.example.org/", "free-stuff.example.org", "/", None, "allow"),
    ("http://a.example.org/?q=FREE+bets", "a.example.org", "/", None, "block"), ("http://free.example.org/free/free", "free.example.org", "/free/free", None, "allow"),
    ("example.com/en/1", "", "", None, "allow"), ("a/casino", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://h?p://q/x", "h", "", None, "allow"),
]


def test_urls(spark):
    rows = [(i, u, "x") for i, (u, *_) in enumerate(URLS)] + [(None, URLS[0][0], "x"), (0, URLS[0][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.url_verdicts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], URLS[r.page_id]
    assert url_filter.url_verdicts(df.where("false")).count() == 0


# --- mixing --------------------------------------------------------------------


def shared_out(sizes, weights, budget, cap):
    """Targets by sharing out again and again until none is above its cap."""
    total, targets, open_ = budget * sum(sizes.values()), {}, dict(weights)
    while open_:
        left = total - sum(targets.values())
        full = [s for s in open_ if left * open_[s] / sum(open_.values()) >= cap * sizes[s]]
        if not full:
            return targets | {s: left * w / sum(open_.values()) for s, w in open_.items()}
        for s in full:
            targets[s] = cap * sizes[s]
            del open_[s]
    return targets


@pytest.mark.parametrize("seed", range(4))
def test_mixture(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", "B", "é", None, "zz", "hot"]
    rows = [(i, None if rng.random() < 0.05 else "w " * rng.choice([0, 1, 5, 40]), rng.choice(sources + ["hot"] * 5), 3.0, 0) for i in range(600)]
    rows += [(7, "same text", "hot", 1.0, 0)] * 50 + [(None, "no id", "a", 1.0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, size int").repartition(4)
    one = sorted(map(tuple, mixture.mix(df).collect()), key=str)
    assert one == sorted(map(tuple, mixture.mix(df.repartition(7)).collect()), key=str)
    got = mixture.mix(df, bins=8).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    targets = shared_out(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(targets[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - targets[s]) <= 51
        assert all(0 <= r.epochs * r.size <= r.taken <= 2 * r.size for r in own)
    assert sorted(r.taken for r in got) == sorted(r[-1] for r in one)
    assert mixture.mix(df.where("false")).count() == 0


def test_quality_prefers(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s") for i in range(2000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(2000)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    got = mixture.mix(df, labels=labels, budget=0.5).collect()
    share = sum(r.taken for r in got if r.doc_id % 2) / sum(r.taken for r in got)
    assert 0.65 < share < 0.9 and sum(r.taken for r in got) == 10_000
    clash = df.withColumns({c: F.lit("x") for c in ("taken", "epochs", "row", "key", "size", "target", "rest", "cut", "part", "s", "text_hash", "plan_source")})
    full = materialize(mixture.mixed_documents(clash), "mixed")
    assert full.columns == [*clash.columns, "epochs_", "taken_"] and full.agg(F.sum("taken_")).first()[0] == 30_000
    assert full.select(*clash.columns[3:]).distinct().collect() == [("x",) * 12]


def test_loaded_vocabulary_and_long_urls(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("# terms\nstrict Bad-Word\nsoft one\n\nsoft two\nsoft bad-word\n")
    strict, soft = url_filter.load_vocabulary(spark, str(tmp_path / "terms.txt"))
    assert (strict, soft) == (("bad-word",), ("one", "two"))
    urls = ["http://a/x/bad-word/", "http://a/xbad-word", "http://a/one/one", "http://a/one-two", "http://a/" + "x" * 1_000_000 + "/BAD-WORD", None, "no scheme one two"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(df, rules=(), strict=strict, soft=soft).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block"}
    (tmp_path / "wrong.txt").write_text("mild x\n")
    with pytest.raises(ValueError):
        url_filter.load_vocabulary(spark, str(tmp_path / "wrong.txt"))


# --- substrings ----------------------------------------------------------------


def cut(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (key, _), w in zip(rows, words):
        if key is not None:
            for j in range(len(w) - 12):
                first[tuple(w[j : j + 13])] = min(key, first.get(tuple(w[j : j + 13]), key))
    out = []
    for (key, _), w in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if key is not None and first[tuple(w[j : j + 13])] < key:
                gone[j : j + 13] = [True] * 13
        out.append((key, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("bucket", "hot"), [(1 << 24, 16), (3000, 4), (3000, 10**9)])
def test_substrings(spark, monkeypatch, bucket, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    rng = random.Random(6)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((12, 13, 14, 20, 60))]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [f"r{rng.randrange(9)}" for _ in range(rng.randint(0, 20))]
            if rng.random() < 0.7:
                one = rng.choice(passages)
                a = rng.randrange(len(one))
                w += one if rng.random() < 0.6 else one[a:]
        rows.append((rng.choice([i, -i]), rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(200, None), (201, ""), (202, " "), (None, rows[0][1]), (5, " ".join(passages[4])), (5, " ".join(passages[4])), (203, "a " * 100), (204, "a " * 40), (205, " ".join(passages[4]))]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, row int").repartition(4)
    got = substring_dedup.repeated_spans(df).collect()
    mine = sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got], key=str)
    assert mine == sorted(cut(rows), key=str)
    assert all(r.n_removed == sum(x["last"] - x["first"] + 1 for x in r.removed) for r in got)
    assert substring_dedup.repeated_spans(df.where("false")).count() == 0


def test_a_passage_in_every_document_does_not_fill_a_bucket(spark, monkeypatch):
    rng = random.Random(4)
    hot = " ".join(f"h{i}" for i in range(40))
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(20)) + " " + hot) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes, packed = {}, substring_dedup._answers
    for least in (16, 10**9):
        monkeypatch.setattr(substring_dedup, "HOT", least)
        monkeypatch.setattr(substring_dedup, "_answers", lambda rows, *a: sizes.setdefault(least, []).append(rows.agg(F.sum(F.length("entries"))).first()[0]) or packed(rows, *a))
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.repeated_spans(df).collect())
        assert got == [(i, 60, 40 if i else 0) for i in range(600)]
    assert sizes[16][0] < sizes[10**9][0] / 2 and (sizes[16][1] or 0) < sizes[10**9][1] / 6


# --- neighbours ----------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in v] for v in rng.standard_normal((900, 12)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0], 0) for i in range(300)]
    odd = [(2000, None, 0), (2020, [0.0] * 12, 0), (2040, [float("nan")] + [1.0] * 11, 0), (2060, [float("inf")] * 12, 0), (2080, [1.0], 0), (2100, [None] + [1.0] * 11, 0), (None, vectors[1], 0), (0, vectors[0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, vector array<float>, score int").repartition(3)
    got = {}
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    table = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    found = all_ = 0
    assert set(got) == {i for i in table if i % 20 == 0}
    for q, mine in got.items():
        mine.sort()
        exact = sorted(((-float((table[q] * v).sum()), i) for i, v in table.items() if i != q))[:20]
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(m[2] == pytest.approx(float(table[q] @ table[m[1]]), rel=1e-12) for m in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        found, all_ = found + len({m[1] for m in mine} & {i for _, i in exact}), all_ + 20
    assert found / all_ >= 0.9


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 3, -1.0), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (20, 3, 3, -1.0)]
    assert rp_forest.nearest(df.where("false"), F.lit(True)).count() == 0


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))] + [(400 + i, [1.0] * 8) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>").repartition(3)
    found, sizes = [], []
    fit = rp_forest.fit
    for cell in (1 << 20, 4):
        monkeypatch.setattr(rp_forest, "CELL", cell)
        monkeypatch.setattr(rp_forest, "fit", lambda known, p: sizes.append(fit(known, p)) or sizes[-1])
        found.append(sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0).collect()))
    assert found[0] == found[1] and len(found[0]) > 400
    (_, one), (forest, many) = sizes
    assert all((x == 1).all() for x in one) and any((x > 1).any() for x in many)
    assert all((t.share * 401 / x <= 4 + 1e-9).all() for t, x in zip(forest.trees, many))


@pytest.mark.parametrize(("n", "dim"), [(22, 2), (22, 12), (25, 2), (60, 12), (2000, 12)])
def test_neighbours_are_complete(spark, n, dim):
    rng = np.random.default_rng(n + dim)
    vectors = rng.standard_normal((n, dim))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    got = {}
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, 20):
        scores = vectors @ vectors[q]
        exact = set([i for i in np.argsort(-scores, kind="stable") if i != q][:20])
        assert len(got[q]) == min(20, n - 1)
        hits += len(got[q] & exact)
    assert hits >= 0.9 * sum(map(len, got.values()))


def test_ties_by_the_smallest_id(spark):
    axes = [[float(j == i % 30) for j in range(30)] for i in range(30)]
    rows = [(i, axes[i % 30] if i < 60 else [2.0 * x for x in axes[i % 30]]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(5)
    got = {}
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0, rp_forest.Search(recall=1.0)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, mine in got.items():
        own = np.array(rows[q][1])
        exact = sorted((-float(own @ np.array(v)), i) for i, v in rows if i != q)[:20]
        assert [(m[1], m[2]) for m in sorted(mine)] == [(i, -s) for s, i in exact]


def test_calibration_on_all_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 8)) * 4
    vectors = centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 8)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<double>").repartition(4)
    hits = 0
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0, rp_forest.Search(sample=400, tests=80)).collect():
        scores = vectors @ vectors[r.query_id]
        scores[r.query_id] = -np.inf
        hits += r.score >= np.sort(scores)[-20] - 1e-9
    assert hits >= 0.9 * 150 * 20


def test_url_filter_without_terms(spark):
    from readprism.llm import url_filter

    pages = spark.createDataFrame([(1, "http://casino.example.com/"), (2, None), (3, "http://a.net/de/x")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.strict_hits, r.soft_hits) for r in url_filter.url_verdicts(pages, strict=(), soft=()).collect()}
    assert got == {1: ("allow", 0, 0), 2: ("allow", 0, 0), 3: ("allow", 0, 0)}
    assert url_filter.url_verdicts(pages.where("false"), strict=(), soft=()).count() == 0
