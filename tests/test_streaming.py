"""Streams of reads: FASTQ files as they arrive, and the folded state against one run over all reads."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from readprism.functions import bases as B
from readprism.operators import adapters, composition, kmers, quality, samples, tallies
from readprism.sources import bgzf, fastq
from readprism.streaming import histograms
from readprism.streaming.source import stream_fastq


def drawn(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = rng.choice(["".join(rng.choice("ACGTNacgt") for _ in range(rng.randint(1, 40))), "GATTACA" * 3, "C" + B.ADAPTERS[0] + "G"])
        out.append((f"r{seed}.{i}", seq, "".join(rng.choice("#5@I+") for _ in seq)))
    return out


def text_of(rows):
    return "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rows).encode()


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def arrive(folder, name, data):
    """A file appears whole, by a rename."""
    hidden = folder.parent / ("_" + name)
    hidden.write_bytes(data)
    os.rename(hidden, folder / name)


def in_batches(spark, path, rows, batches):
    """One micro-batch for each part of the rows, without a stream around it."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], "id string, seq string, qual string")
        histograms.add_batch(part, i, path)


def test_files_of_all_kinds_arrive(spark, tmp_path):
    folder = tmp_path / "in files"
    folder.mkdir()
    parts = [drawn(i, 60) for i in range(5)]
    arrive(folder, "a.fastq", text_of(parts[0]))
    arrive(folder, "b.fastq.gz", gzip.compress(text_of(parts[1])))
    arrive(folder, "notes.txt", b"no reads")
    arrive(folder, "empty.fastq", b"")
    state = str(tmp_path / "state")

    def go():
        stream = stream_fastq(spark, str(folder), split_bytes=500, columns=("seq", "qual", "file"), tasks=3, maxFilesPerTrigger=1)
        histograms.start(stream.withColumn("sample", F.regexp_extract("file", r"([^/.]+)\.f[^/]*$", 1)), state).awaitTermination()

    go()
    go()  # nothing new
    assert {r["sample"]: r["total_sequences"] for r in samples.basic_stats(histograms.merged(spark, state)).collect()} == {"a": 60, "b": 60}
    arrive(folder, "c.fq.gz", bgzf.pack(text_of(parts[2]), 300))
    arrive(folder, "0 late.fastq", text_of(parts[3]).replace(b"\n", b"\r\n"))
    arrive(folder, "d.fastq", text_of(parts[4])[:-1])
    go()  # a restart goes on where the last run ended
    named = [(n, s, q) for n, rows in zip(("a", "b", "c", "0 late", "d"), parts, strict=True) for _, s, q in rows]
    whole = samples.accumulate(spark.createDataFrame(named, "sample string, seq string, qual string"))
    got = histograms.merged(spark, state)
    assert rows_of(got.tallies) == rows_of(whole.tallies) and rows_of(got.sequences) == rows_of(whole.sequences)


@pytest.mark.parametrize("split", [1, 90, 10_000])
def test_ranges_of_a_stream_are_those_of_the_reader(spark, tmp_path, split):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = drawn(9, 80)
    arrive(folder, "x.fastq", text_of(rows))
    arrive(folder, "y.fq.gz", bgzf.pack(text_of(rows), 200))
    stream = stream_fastq(spark, str(folder), split_bytes=max(split, 40))
    seen = []
    stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, fastq.read_fastq(spark, str(folder)).collect()))


def test_state_is_that_of_all_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(histograms, "FOLD", 3)
    rows, path = drawn(1, 200), str(tmp_path / "state")
    in_batches(spark, path, rows, 10)
    assert histograms.current(histograms.parts(spark, path)) == [(0, 8), (9, 9)]
    got = histograms.merged(spark, path)
    ready = B.prepared(spark.createDataFrame(rows, "id string, seq string, qual string"))
    one, all_ = got.tallies, tallies.tallies(ready, 33, samples.KINDS)
    assert rows_of(one.drop("sample")) == rows_of(all_)
    assert rows_of(kmers.enriched_kmers(kmers.kmers_of(one))) == rows_of(kmers.enriched_kmers(kmers.kmer_counts(ready)))
    tables = samples.module_tables(got)
    assert rows_of(tables["adapter_by_position"].drop("sample")) == rows_of(adapters.adapter_by_position(adapters.adapter_counts(ready)))
    assert rows_of(tables["per_base_quality"].drop("sample")) == rows_of(quality.per_base_quality(composition.position_counts(ready, 33)))
    assert rows_of(samples.module_tables(samples.accumulate(ready.withColumn("sample", F.lit(None))))["duplication_levels"]) == rows_of(tables["duplication_levels"])


def test_number_of_parts_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(histograms, "FOLD", 2)
    path, most = str(tmp_path / "state"), 0
    for i in range(17):
        histograms.add_batch(spark.createDataFrame([("ACGT", "IIII")], "seq string, qual string"), i, path)
        most = max(most, len(os.listdir(tmp_path / "state" / "parts")))
        assert samples.basic_stats(histograms.merged(spark, path)).first()["total_sequences"] == i + 1
    assert most <= 12 and histograms.current(histograms.parts(spark, path)) == [(0, 15), (16, 16)]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(histograms, "FOLD", 2)
    path = str(tmp_path / "state")
    reads = spark.createDataFrame([("ACGT", "IIII")], "seq string, qual string")
    total = lambda: samples.basic_stats(histograms.merged(spark, path)).first()["total_sequences"]
    histograms.add_batch(reads, 0, path)
    histograms.add_batch(reads, 0, path)
    assert total() == 1
    # The batch's own part is done, but its fold was cut off before its mark.
    write, calls = histograms._write, []

    def broken(state, where, part):
        calls.append(part)
        if part == (0, 1):
            state.tallies.write.parquet(histograms._path(where, part))
            raise OSError("lost")
        write(state, where, part)

    monkeypatch.setattr(histograms, "_write", broken)
    with pytest.raises(OSError, match="lost"):
        histograms.add_batch(reads, 1, path)
    assert total() == 2
    monkeypatch.setattr(histograms, "_write", write)
    histograms.add_batch(reads, 1, path)
    histograms.add_batch(reads, 1, path)
    assert calls == [(1, 1), (0, 1)] and total() == 2
    assert histograms.current(histograms.parts(spark, path)) == [(0, 1)]


def test_state_of_another_query(spark, tmp_path):
    path = str(tmp_path / "state")
    reads = spark.createDataFrame([("ACGT", "IIII")], "seq string, qual string")
    with pytest.raises(ValueError, match="another query"):
        histograms.add_batch(reads, 3, path)
    for i in range(3):
        histograms.add_batch(reads, i, path)
    with pytest.raises(ValueError, match="another query"):
        histograms.add_batch(reads, 0, path)


def test_no_batches_yet(spark, tmp_path):
    state = histograms.merged(spark, str(tmp_path / "none"))
    assert all(not t.collect() for t in samples.module_tables(state).values())
