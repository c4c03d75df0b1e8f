"""The pipeline's stages on a small table, one after the other."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from readprism.llm import shared

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = shared.table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r for r in shared.table(spark, SF, "labels").collect()}
    for name, stage in P.STAGES:
        docs = shared.materialize(stage(spark, docs, SF), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.columns[: len(columns)] == columns
        if name == "quality":
            assert not any(labels[i].toxic for i in now if i in labels)
        if name == "personal_data":
            assert now == ids and not docs.where("text rlike '@mail[0-9]+[.]example[.]com' and text rlike 'und[.]34@mail7'").count()
        ids = now
    assert docs.where("taken <= 0 or taken is null").count() == 0 and len(ids) > 50
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mix"]


def run_all(spark, docs, sf_dir):
    for name, stage in P.STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    return docs


def test_nulls_repeats_and_clashing_columns(spark):
    docs = shared.table(spark, SF, "documents")
    names = ("entities", "taken", "epochs", "grade", "rated_id", "keep_id", "bad_id", "row", "root", "found")
    odd = docs.limit(1).withColumn("text", F.explode(F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" \n")))).withColumn("doc_id", F.lit(10**6).cast("long"))
    nameless = docs.orderBy("doc_id").limit(30).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string"))
    more = docs.unionByName(docs).unionByName(odd).unionByName(nameless).withColumns({c: F.lit("own") for c in names})
    plain, got = run_all(spark, docs, SF), run_all(spark, more, SF)
    assert got.columns == [*more.columns, "epochs_", "taken_"]
    assert got.select(*names).distinct().collect() == [("own",) * len(names)]
    assert got.groupBy("doc_id", "text").count().where("count > 1").isEmpty() and got.where("doc_id is null or doc_id = 1000000").isEmpty()
    kept = P.near_duplicates(spark, P.quality(spark, more, SF), SF)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in P.near_duplicates(spark, P.quality(spark, docs, SF), SF).select("doc_id").collect()}
    assert {r.doc_id for r in plain.select("doc_id").collect()} and not got.isEmpty()


def test_no_documents(spark):
    docs = shared.table(spark, SF, "documents")
    assert run_all(spark, docs.where("false"), SF).columns == [*docs.columns, "epochs", "taken"]


def small_tables(tmp_path, spark, docs, labels=(), benchmark=()):
    for name, rows, ddl in (("documents", docs, "doc_id long, text string, source string, lang string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(list(rows), ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def drawn_texts(n, size, seed=1):
    import random

    rng = random.Random(seed)
    return [" ".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + str(rng.randrange(10**6)) for _ in range(size)) for _ in range(n)]


def test_planted_copies_and_passages(spark, tmp_path):
    """Without labels all documents with words pass; what is planted goes, all else stays, by a plain account of the rules."""
    texts = drawn_texts(40, 120)
    items = drawn_texts(3, 30, seed=2)
    rows = [(i, t, f"s{i % 3}", "en") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "s0", "en") for i in range(5)]
    rows += [(200 + i, texts[10 + i].rsplit(" ", 2)[0], "s1", "en") for i in range(5)]
    leaked = items[0].split()
    leaked[4] = leaked[19] = "other"
    rows += [(300, texts[20] + " " + items[1] + " " + texts[21], "s2", "en"), (301, " ".join(leaked), "s2", "en"), (400, None, "s0", "en"), (401, " ", "s0", "en")]
    long = " ".join(drawn_texts(1, 300_000, seed=3))
    rows.append((500, long, "long", "en"))
    sf = small_tables(tmp_path, spark, rows, benchmark=enumerate(items))
    docs = shared.table(spark, sf, "documents")
    seen = {}
    for name, stage in P.STAGES:
        docs = shared.materialize(stage(spark, docs, sf), name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    everything = set(range(40)) | {*range(100, 105), *range(200, 205), 300, 301, 500}
    assert seen["quality"] == everything

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = {i: shingles(t) for i, t, _, _ in rows if i in everything and i != 500}
    copies = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert copies == {*range(100, 105), *range(200, 205)} and seen["near_duplicates"] == everything - copies
    assert seen["decontamination"] == everything - copies - {300, 301} == seen["personal_data"]
    assert docs.where("doc_id = 500").selectExpr("length(text)").first()[0] == len(long)
    assert {r.doc_id for r in P.run(spark, sf).select("doc_id").collect()} == seen["mix"]


def test_an_empty_benchmark_and_no_labels(spark, tmp_path):
    rows = [(i, t, "s", "en") for i, t in enumerate(drawn_texts(6, 50))]
    sf = small_tables(tmp_path, spark, rows)
    got = P.run(spark, sf)
    assert got.agg(F.sum("taken")).first()[0] == 450 and {r.doc_id for r in got.select("doc_id").collect()} == set(range(6))
