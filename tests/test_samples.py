"""Many samples in one run: against runs of each sample alone, and merged states against the whole."""

import random

import pytest

from readprism.functions import bases as B
from readprism.operators import adapters, composition, lengths, quality, samples, sequences


def drawn(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        size = rng.choice([0, 1, 7, 20, 60])
        seq = rng.choice(["".join(rng.choice("ACGTNacgtX") for _ in range(size)), "GATTACA" * 4, "AC" + B.ADAPTERS[3] + "G"])
        rows.append((rng.choice(["a", "a", "a", "b", "c", None]), seq, "".join(rng.choice("#5@I") for _ in range(len(seq)))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "sample string, seq string, qual string").repartition(3)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_each_sample_as_if_alone(spark):
    rows = drawn(1, 900)
    tables = samples.module_tables(samples.accumulate(frame(spark, rows)))
    for sample in ("a", "b", "c", None):
        own = B.prepared(spark.createDataFrame([r[1:] for r in rows if r[0] == sample], "seq string, qual string"))
        positions, counts = composition.position_counts(own, 33), sequences.sequence_counts(own)
        alone = {
            "basic_stats": composition.basic_stats(own), "per_base_quality": quality.per_base_quality(positions), "per_seq_quality": quality.per_seq_quality(quality.mean_quality_counts(own, 33)),
            "per_base_content": composition.per_base_content(positions), "per_seq_gc": composition.per_seq_gc(own), "per_base_n": composition.per_base_n(positions), "per_seq_n": composition.per_seq_n(own),
            "length_dist": lengths.length_dist(own), "duplication_levels": sequences.duplication_levels(counts), "overrepresented": sequences.overrepresented(counts),
            "adapter_by_position": adapters.adapter_by_position(adapters.adapter_counts(own)),
        }
        assert set(alone) == set(tables)
        for name, df in alone.items():
            here = tables[name].where("sample is null" if sample is None else f"sample = '{sample}'").drop("sample")
            assert rows_of(here) == rows_of(df), (sample, name)


def test_merged_states_are_the_state_of_all(spark, tmp_path):
    one, two = drawn(2, 300), [("d", "ACGT", "IIII"), *drawn(3, 200)]
    samples.accumulate(frame(spark, one)).save(str(tmp_path / "one"))
    samples.accumulate(frame(spark, two)).save(str(tmp_path / "two"))
    parts = [samples.load(spark, str(tmp_path / n)) for n in ("one", "two")]
    whole, merged = samples.accumulate(frame(spark, one + two)), samples.merge(*parts)
    assert rows_of(merged.tallies) == rows_of(whole.tallies) and rows_of(merged.sequences) == rows_of(whole.sequences)
    nothing = samples.accumulate(frame(spark, one).where("false"))
    assert rows_of(samples.merge(merged, nothing).tallies) == rows_of(whole.tallies)
    assert all(not t.collect() for t in samples.module_tables(nothing).values())


def test_more_samples_than_a_task_keeps(spark):
    n = 3 * samples.OPEN
    reads = spark.range(6 * n).selectExpr(f"cast(id % {n} as string) as sample", "repeat('ACGT', 5) as seq", "repeat('I', 20) as qual")
    got = samples.basic_stats(samples.accumulate(reads, kinds=("length", "strong"))).collect()
    assert len(got) == n and {(r.total_sequences, r.total_bases, r.gc_percent) for r in got} == {(6, 120, 50)}


def test_a_folder_of_files(spark, tmp_path):
    """A folder is one job; each file is a sample."""
    from pyspark.sql import functions as F

    from readprism.sources.fastq import read_fastq

    for i in range(12):
        (tmp_path / f"s{i}.fastq").write_text("@r\nACGTN\n+\nIIIII\n" * (i + 1))
    reads = read_fastq(spark, str(tmp_path), columns=("seq", "qual", "file")).withColumn("sample", F.regexp_extract("file", r"([^/]+)\.fastq$", 1))
    got = {r.sample: r.total_sequences for r in samples.basic_stats(samples.accumulate(reads)).collect()}
    assert got == {f"s{i}": i + 1 for i in range(12)}


@pytest.mark.parametrize("split", [40, 1000])
def test_state_does_not_depend_on_partitions(spark, split):
    rows = drawn(4, 200)
    df = spark.createDataFrame(rows, "sample string, seq string, qual string")
    assert rows_of(samples.accumulate(df.repartition(split % 7 + 1)).tallies) == rows_of(samples.accumulate(df.coalesce(1)).tallies)


def test_tables_of_one_pass_are_those_of_the_reads(spark):
    from readprism.operators import tallies

    for rows in (drawn(7, 400), []):
        reads = B.prepared(spark.createDataFrame([r[1:] for r in rows], "seq string, qual string"))
        counted = tallies.tallies(reads, 33, tallies.LONG_KINDS)
        hist = lengths.lengths_of(counted)
        for a, b in [
            (composition.basic_of(counted), composition.basic_stats(reads)), (composition.gc_of(counted), composition.per_seq_gc(reads)), (composition.n_of(counted), composition.per_seq_n(reads)),
            (composition.flags_of(counted), composition.n_flags(reads)), (adapters.any_of(counted), adapters.adapter_any(reads)), (lengths.bins_of(hist), lengths.length_bins(reads)), (lengths.summary_of(hist), lengths.length_summary(reads)),
        ]:
            assert sorted(a.columns) == sorted(b.columns) and rows_of(a) == rows_of(b)


def test_a_module_alone_is_the_same_and_counts_no_more_than_it_needs(spark):
    reads = frame(spark, drawn(5, 300))
    tables = samples.module_tables(samples.accumulate(reads))
    assert set(samples.MODULE_KINDS) == set(tables)
    for name, table in tables.items():
        assert rows_of(samples.module_table(reads, name)) == rows_of(table), name
    plan = samples.module_table(reads, "per_base_content")._jdf.queryExecution().optimizedPlan().toString()
    assert "qual" not in plan.split("MapInArrow")[1].split("LogicalRDD")[0]
