"""Ordinal classifier: thresholds, held-out accuracy and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from readprism.llm import ordinal as O
from readprism.llm.shared import materialize

GOOD, BAD, WORSE = ("calm clear plain kind fair".split(), "nasty vile".split(), "$$$ ### %%%".split())


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        if junk:
            words = [w + rng.choice(WORSE) for w in words]
        rows.append((i, " ".join(words), int(not junk), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([(i, t, 7) for i, t, _, _ in rows] + [(5000, None, 1), (5001, "", 1), (5002, " \n", 1), (None, "plain words here", 1)], "doc_id long, text string, tail int")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows[:1000]] + [(1, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out(spark, tables):
    rows, docs, labels = tables
    model = O.train(docs, O.graded(labels))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in O.score(docs, model, "doc_id").collect()}
    truth = {i: 0 if x else 1 + q for i, _, q, x in rows}
    held = [i for i in truth if i >= 1000]
    kept = {i for i in held if got[i].tail >= 0.5}
    good = {i for i in held if truth[i] == 2}
    assert len(good - kept) <= 0.03 * len(good) and len(kept - good) <= 0.03 * len(held)
    assert all(0 <= got[i].tail <= got[i].expected_grade <= 2 for i in held)
    assert [got[i].expected_grade for i in (5000, 5001, 5002)] == [0, 0, 0]


def test_selection_keeps_columns_and_repeats(spark, tables):
    _, docs, labels = tables
    kept = O.select_quality(docs.unionByName(docs), labels)
    assert kept.columns == docs.columns
    counts = kept.groupBy("doc_id").count().where("doc_id is not null")
    assert {r["count"] for r in counts.collect()} == {2}
    assert kept.where("text is null or trim(text) = ''").count() == 0


def test_clashing_columns_and_long_texts(spark, tables):
    _, docs, labels = tables
    more = docs.withColumns({c: F.lit(1) for c in ("grade", "rated_id", "id", "slots", "tail", "expected_grade", "c0", "c1")})
    kept = materialize(O.select_quality(more, labels.withColumn("text", F.lit("x"))), "kept")
    assert kept.columns == more.columns and 0 < kept.count() < docs.count()
    model = O.train(docs, O.graded(labels))
    long = spark.createDataFrame([(1, "good words " * 400_000)], "doc_id long, text string")
    assert 0 <= O.score(long, model, "doc_id").first().tail <= 1


def test_labels_of_missing_documents_take_no_place(tables):
    _, docs, labels = tables
    missing = labels.select((F.col("doc_id") + 10**9).alias("doc_id"), "quality", "toxic")
    one, two = (O.train(docs, O.graded(x), sample=40) for x in (labels, labels.unionByName(missing)))
    assert np.allclose(one.thresholds, two.thresholds)


def test_same_result_again(tables):
    _, docs, labels = tables
    one, two = (O.train(docs.repartition(n), O.graded(labels)) for n in (2, 5))
    assert np.allclose(one.thresholds, two.thresholds, atol=1e-6)


def test_no_and_single_grades(spark, tables):
    _, docs, labels = tables
    none = O.train(docs, O.graded(labels.where("false")))
    assert O.score(docs.where("doc_id = 1"), none, "doc_id").first().tail == 1
    one = O.train(docs, O.graded(labels.where("quality = 0 and toxic = 0")))
    assert O.score(docs.where("doc_id = 1"), one, "doc_id").first().expected_grade == 1
    assert O.select_quality(docs.where("false"), labels).count() == 0


def test_features_are_per_document():
    texts = pa.array(["a b c", None, "a a a a", "x" * 100_000 + " y"])
    slots, bounds, n = O.features(texts)
    assert list(n) == [3, 0, 4, 2]
    alone = O.features(texts.slice(2, 1))[0]
    assert (slots[bounds[2] : bounds[3]] == alone).all()


def test_fit_is_the_best_of_its_likelihood():
    """Against the likelihood written out plainly: no step from the fitted weights and thresholds makes it better."""
    rng = np.random.default_rng(4)
    n, true = 900, np.array([1.5, -1.0, 0.7, 0.0])
    has = rng.random((n, 4)) < 0.5
    latent = has @ true + rng.logistic(size=n)
    grades = (latent > -0.5).astype(int) + (latent > 1.2)
    slots, bounds = np.concatenate([np.flatnonzero(h) * 1000 for h in has]), np.concatenate([[0], np.cumsum(has.sum(axis=1))])
    model = O.fit(slots, bounds, grades, steps=3000, rate=0.02, l1=0.0)

    def loss(weights, thresholds):
        total = 0.0
        for h, g in zip(has, grades):
            s = sum(w for w, x in zip(weights, h) if x)
            below = [0.0, *(1 / (1 + np.exp(s - t)) for t in thresholds), 1.0]
            total -= np.log(below[g + 1] - below[g])
        return total / n

    weights, thresholds = model.weights[[0, 1000, 2000, 3000]], model.thresholds
    best = loss(weights, thresholds)
    for step in (0.02, 0.1, 0.5):
        for i in range(6):
            for sign in (-1, 1):
                moved = np.concatenate([weights, thresholds])
                moved[i] += sign * step
                assert loss(moved[:4], moved[4:]) > best - 1e-7, (i, sign, step)
    assert np.abs(weights - true).max() < 0.5 and loss(true, [-0.5, 1.2]) >= best


def test_query_against_one_document_at_a_time(spark):
    """The query's grades and tails, with sums and probabilities in plain Python."""
    from readprism.llm import queries as Q
    from readprism.llm.shared import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = O.train(docs, O.graded(table(spark, sf, "labels")))
    got = {r.doc_id: r for r in Q.op2_ordinal_quality(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and model.constant is None
    for r in rows:
        slots, _, words = O.features(pa.array([r.text], pa.string()))
        score = sum(float(model.weights[s]) for s in slots.tolist())
        tails = [1 / (1 + float(np.exp(t - score))) if words[0] else 0.0 for t in model.thresholds]
        assert got[r.doc_id].tail == pytest.approx(tails[-1], abs=1e-6) and got[r.doc_id].expected_grade == pytest.approx(sum(tails), abs=1e-6)
        assert got[r.doc_id].kept == (got[r.doc_id].tail >= 0.5)
