"""Modules against plain Python on hand-made and random reads."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readprism.functions import bases as B
from readprism.operators import adapters, composition, kmers, lengths, quality, sequences
from readprism.operators import tallies as T
from readprism.plans import relations
from tests import brute

A0, A3 = B.ADAPTERS[0], B.ADAPTERS[3]
CASES = {
    "poly_a_19": ("A" * 19, "I" * 19), "poly_a_20": ("A" * 20, "I" * 20), "lower": ("acgtnacgtn", "IIIIIIIIII"), "iupac": ("RYACGTK", "ABCDEFG"), "one": ("A", "#"),
    "six": ("ACGTAC", "IIIIII"), "seven": ("ACGTACG", "IIIIIII"), "below": ("ACGT", "\x20\x20!!"), "above": ("ACGT", "~~~~"), "adapter": ("AC" + A0 + "G", "I" * 37),
    "overlap": (A3 + A3[2:] + A3, "I" * 55), "lower_adapter": (A3.lower(), "5" * 19), "n_10": ("N" + "A" * 9, "I" * 10), "n_11": ("N" * 11 + "A" * 89, "I" * 100), "n_21": ("N" * 21 + "C" * 79, "I" * 100),
    "long": ("ACGTN" * 250, "I" * 1250),
}


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(5)
    rows = list(CASES.values())
    for _ in range(300):
        n = rng.choice([1, 5, 16, 40, 75])
        rows.append(("".join(rng.choice("ACGTNacgt") for _ in range(n)), "".join(chr(rng.randint(33, 74)) for _ in range(n))))
    return rows + rows[:40] + [CASES["seven"]] * 9


@pytest.fixture(scope="module")
def ready(spark, reads):
    rows = [(i, f"r{i}", s, q) for i, (s, q) in enumerate([*reads, ("", "")])]
    return B.prepared(spark.createDataFrame(rows, "read_idx long, id string, seq string, qual string").repartition(5)).cache()


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_basic(ready, reads):
    r = composition.basic_stats(ready).first()
    bases = sum(len(s) for s, _ in reads)
    gc = sum(c in "GC" for s, _ in reads for c in s.upper())
    assert (r.total_sequences, r.total_bases, r.min_len, r.max_len, r.gc_percent) == (len(reads), bases, 1, 1250, (100 * gc + bases // 2) // bases)


def test_by_read(ready, reads):
    assert as_dict(composition.per_seq_gc(ready), "gc", "cnt") == Counter(brute.percent(s, "GC") for s, _ in reads)
    assert as_dict(composition.per_seq_n(ready), "n_percent", "cnt") == Counter(brute.percent(s, "N") for s, _ in reads)
    assert as_dict(quality.per_seq_quality(quality.mean_quality_counts(ready, 33)), "mean_q", "cnt") == Counter(brute.mean_q(q) for _, q in reads)
    low = quality.quality_flags(quality.mean_quality_counts(ready, 33)).first()
    assert (low["reads"], low["low"]) == (len(reads), sum(brute.mean_q(q) < 20 for _, q in reads))
    flags = composition.n_flags(ready).first()
    shares = [brute.percent(s, "N") for s, _ in reads]
    assert (flags["gt20"], flags["gt10"]) == (sum(p > 20 for p in shares), sum(10 < p <= 20 for p in shares))


def test_by_position(ready, reads):
    counts = composition.position_counts(ready, 33).cache()
    expected = brute.positions(reads)
    for r in quality.per_base_quality(counts).collect():
        values = [q for _, q in expected[r.base]]
        assert r["mean"] == sum(values) / len(values)
        assert [r[n] for n in quality.QUANTILES] == [brute.nearest_rank(values, s) for s in quality.QUANTILES.values()]
    for r in composition.per_base_content(counts).collect():
        known = [b for b, _ in expected[r.base] if b in "ACGT"]
        assert [r[x] for x in "gatc"] == [known.count(x) * 100.0 / len(known) if known else 0.0 for x in "GATC"]
    for r in composition.per_base_n(counts).collect():
        known = [b for b, _ in expected[r.base] if b in "ACGTN"]
        assert r.n_percent == (known.count("N") * 100.0 / len(known) if known else 0.0)


def test_sequences(ready, reads):
    counts = Counter(s.upper() for s, _ in reads)
    table = sequences.sequence_counts(ready).cache()
    levels = Counter()
    for c in counts.values():
        levels[min(c, 7)] += c
    got = sequences.duplication_levels(table).collect()
    assert {r.level: r.reads for r in got} == {i: levels[i] for i in range(1, 8)}
    assert sum(r.relative for r in got) == pytest.approx(1)
    over = {r.sequence: (r.cnt, r.percent, r.source) for r in sequences.overrepresented(table).collect()}
    assert over["A" * 20][2] == "Poly-A" and over["A" * 19][2] == "No Hit" and over[A3][2] == "Adapter"
    assert {s: v[0] for s, v in over.items() if len(s) < 150} == {s: c for s, c in counts.items() if 1000 * c >= len(reads) and len(s) < 150}
    first = {}
    for s, _ in reads:
        first.setdefault(s.upper(), s)
    shown = {r.sequence: (r.cnt, r.percent, r.source) for r in sequences.overrepresented(table, ready).collect()}
    assert shown == {(first[s] if len(s) < 150 else first["ACGTN" * 250][:150]): v for s, v in over.items()}
    assert "acgtnacgtn" in shown and "ACGTNACGTN" not in shown
    prints, plain = sequences.fingerprints(ready).cache(), ready.drop("read_idx", "written")
    assert {r.level: r.reads for r in sequences.duplication_levels(prints).collect()} == {i: levels[i] for i in range(1, 8)}
    for least in (0.1, 0.0001):  # broadcast and plain join
        expected = sequences.overrepresented(table, least_percent=least), sequences.overrepresented(table, ready, least_percent=least)
        for want, rows in zip(expected, (plain, ready), strict=True):
            assert sorted(map(tuple, sequences.reported(prints, rows, least_percent=least).collect())) == sorted(map(tuple, want.collect()))
    assert len(sequences.frequent_sequences_sketch(ready, k=3).collect()) == 3


def test_repeated_and_null_read_numbers(spark):
    rows = [(0, "acgt"), (0, "ACGT"), (0, "Acgtt"), (None, "ggg"), (None, "GGG")]
    ready = B.prepared(spark.createDataFrame([(*r, "I" * len(r[1])) for r in rows], "read_idx long, seq string, qual string"))
    shown = {r.sequence: r.cnt for r in sequences.overrepresented(sequences.sequence_counts(ready), ready).collect()}
    assert shown == {"ACGT": 2, "Acgtt": 1, "GGG": 2}
    again = {r.sequence: r.cnt for r in sequences.reported(sequences.fingerprints(ready), ready).collect()}
    assert again == shown


def test_sequences_that_share_a_fingerprint_are_told_apart(spark, monkeypatch):
    rows = [("AAAA",)] * 6 + [("CCCC",)] * 3 + [("GGGG",)] * 91
    ready = B.prepared(spark.createDataFrame(rows, "seq string").selectExpr("seq", "'IIII' as qual"))
    monkeypatch.setattr(sequences, "printed", lambda reads: reads.select("*", F.when(F.col("seq") == "GGGG", 1).otherwise(0).alias("h1"), F.lit(0).alias("h2")))
    prints = sequences.fingerprints(ready)
    assert prints.count() == 2
    got = sorted((r.sequence, r.cnt, r.percent) for r in sequences.reported(prints, ready, least_percent=5).collect())
    assert got == [("AAAA", 6, 6.0), ("GGGG", 91, 91.0)]


def test_no_reads_no_sequences(spark):
    ready = B.prepared(spark.createDataFrame([], "read_idx long, seq string, qual string"))
    prints = sequences.fingerprints(ready)
    assert not sequences.reported(prints, ready).collect()
    assert [r.reads for r in sequences.duplication_levels(prints).collect()] == [0] * 7


def test_adapters(ready, reads):
    hits = Counter(h for s, _ in reads for h in brute.adapter_starts(s))
    got = {(r.position, i): r[f"a{i}"] for r in adapters.adapter_by_position(adapters.adapter_counts(ready)).collect() for i in range(5)}
    assert len(got) == 1250 * 5
    assert {k: v for k, v in got.items() if v} == {k: c * 100.0 / len(reads) for k, c in hits.items()}
    any_ = adapters.adapter_any(ready).first()
    assert [any_[f"a{i}"] for i in range(5)] == [sum(a in s.upper() for s, _ in reads) * 100.0 / len(reads) for a in B.ADAPTERS]


def test_kmers(ready, reads):
    counts = brute.kmers(reads)
    table = kmers.kmer_counts(ready).cache()
    assert {(r.kmer, r.bin): r.cnt for r in table.collect()} == counts
    total = sum(counts.values())
    by_bin, by_word = Counter(), Counter()
    for (w, b), c in counts.items():
        by_bin[b] += c
        by_word[w] += c
    best = {}
    for (w, b), c in sorted(counts.items(), key=lambda x: (x[0][0], x[0][1])):
        ratio = (c / by_bin[b]) / (by_word[w] / total)
        if w not in best or ratio > best[w][0]:
            best[w] = (ratio, b)
    top = sorted(((-v, w, b) for w, (v, b) in best.items() if v >= 3))[:50]
    got = kmers.enriched_kmers(table).orderBy(F.desc("obs_exp"), "kmer").collect()
    assert [(-r.obs_exp, r.kmer, (r.max_pos - 5) // 10) for r in got] == top


def test_lengths(ready, reads):
    assert as_dict(lengths.length_dist(ready), "length", "cnt") == Counter(len(s) for s, _ in reads)
    bins = lengths.length_bins(ready).orderBy("bin").collect()
    assert [r.cnt for r in bins] == [sum(len(str(len(s))) - 1 == i for s, _ in reads) for i in range(8)]
    s = lengths.length_summary(ready).first()
    assert s["mean"] == sum(len(x) for x, _ in reads) / len(reads)
    held, sizes, target = 0, sorted((len(x) for x, _ in reads), reverse=True), sum(len(x) for x, _ in reads) / 2
    for n in sizes:
        held += n
        if held >= target:
            break
    assert lengths.exact_nxx(ready).first().n_exact == n


@pytest.mark.parametrize(("lo", "hi", "offset"), [(33, 70, 33), (58, 90, 33), (59, 74, 33), (59, 75, 64), (64, 70, 64), (63, 74, 33)])
def test_phred(spark, lo, hi, offset):
    rows = [(0, "AC", chr(lo) + chr(hi)), (1, "", "")]
    assert quality.phred_offset(spark.createDataFrame(rows, "read_idx long, seq string, qual string")).first()["offset"] == offset


def test_partitioning_does_not_matter(ready):
    for parts in (1, 7):
        other = ready.repartition(parts)
        assert sorted(map(tuple, kmers.kmer_counts(other).collect())) == sorted(map(tuple, kmers.kmer_counts(ready).collect()))


def test_tallies_in_small_pieces(ready, monkeypatch):
    batches = ready.select("seq", "qual").toArrow().to_batches()

    def folded():
        total = Counter()
        parts = list(T.fold(batches, 33, T.KINDS))
        for part in parts:
            for row in part.to_pylist():
                total[tuple(row[k] for k in ("kind", "a", "b", "c"))] += row["cnt"]
        return total, len(parts)

    whole, n = folded()
    monkeypatch.setattr(T, "PIECE", 50)
    monkeypatch.setattr(T, "HELD", 20)
    again, more = folded()
    assert again == whole == {(r.kind, r.a, r.b, r.c): r.cnt for r in T.tallies(ready).collect()} and more > n


def test_short_and_null_qualities(spark):
    rows = [("ACGT", "II"), ("AC", None), ("RY", "")]
    ready = B.prepared(spark.createDataFrame(rows, "seq string, qual string"))
    assert sorted(((r.base, r.b, r.q, r.cnt) for r in composition.position_counts(ready, 33).collect())) == sorted([(1, "A", 40, 1), (2, "C", 40, 1), (3, "G", 0, 1), (4, "T", 0, 1), (1, "A", 0, 1), (2, "C", 0, 1), (1, "*", 0, 1), (2, "*", 0, 1)])
    assert as_dict(quality.per_seq_quality(quality.mean_quality_counts(ready, 33)), "mean_q", "cnt") == {20: 1, None: 1, 0: 1}
    none = ready.where("false")
    assert not T.tallies(none).count() and tuple(quality.quality_flags(quality.mean_quality_counts(none, 33)).first()) == (0, 0) and not adapters.adapter_by_position(adapters.adapter_counts(none)).count()


def test_long_reads_have_a_quality_for_each_letter(spark, tmp_path):
    sizes = {1: 1, 2: 32, 3: 33, 4: 300_001}
    spark.createDataFrame([(k, "acgt x" * (n // 4) + "a" * (n % 4)) for k, n in sizes.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = relations.long_reads(spark, str(tmp_path)).select("rid", F.length("seq"), F.length("qual")).collect()
    assert {tuple(r) for r in got} == {(f"d{k}", n, n) for k, n in sizes.items()}


def test_counts_kept_do_not_grow_with_the_reads():
    rng = np.random.default_rng(7)
    held = T.Folder(33, ("position", "kmer", "gc"))
    for _ in range(30):
        seqs = ["".join(s) for s in rng.choice(list("ACGT"), (300, 40))]
        assert not list(held.add(pa.RecordBatch.from_pydict({"seq": seqs, "qual": ["I" * 40] * 300})))
    assert all(c.size == 0 and len(c.parts) == 0 and len(c.small) <= 4**T.K * T.BINS for c in held.held.values())
    assert sum(r["cnt"] for part in held.rest() for r in part.to_pylist()) == 30 * 300 * (40 + 34 + 1)


@pytest.mark.parametrize("name", ["adapter_by_position", "samples_adapter_by_position", "samples_per_seq_gc", "samples_per_base_quality", "per_seq_gc"])
def test_derived_reads_are_made_once(spark, name):
    from readprism import queries

    found = queries.queries()[name](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("CASE WHEN ((l_partkey") == 1 and plan.count("MapInArrow") <= 1


def test_positions_without_an_adapter_are_filled(spark):
    a = B.ADAPTERS[3]
    rows = [("ACG" + a + "AC", "I"), (a, "I"), ("A" * 40, "I"), ("ACG" + a, "I")]
    ready = B.prepared(spark.createDataFrame(rows, "seq string, qual string"))
    got = sorted(tuple(r) for r in adapters.adapter_by_position(adapters.adapter_counts(ready)).collect())
    assert got == [(p, 0.0, 0.0, 0.0, {1: 25.0, 4: 50.0}.get(p, 0.0), 0.0) for p in range(1, 41)]
