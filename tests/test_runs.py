"""Files, reports, verdicts, the command line and the streaming state."""

import gzip
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import Row

from readprism import cli
from readprism.operators import verdicts
from readprism.plans.report import Context, Report, run
from readprism.sinks import bundle, latex, text_report
from readprism.sources.fastq import read_fastq, write_fastq


def fastq(rows, end="\n"):
    return "".join(f"@{i}{end}{s}{end}+{end}{q}{end}" for i, s, q in rows).encode()


ROWS = [(f"r{i}", "ACGTN"[: 1 + i % 5] * (1 + i % 3), "@+I5#"[: 1 + i % 5] * (1 + i % 3)) for i in range(200)]


@pytest.mark.parametrize("split", [1, 7, 64, 100_000])
def test_split_files(spark, tmp_path, split):
    (tmp_path / "x.fastq").write_bytes(fastq(ROWS))
    got = read_fastq(spark, str(tmp_path / "x.fastq"), split_bytes=max(split, 40)).orderBy("read_idx").collect()
    assert [(r.id, r.seq, r.qual) for r in got] == ROWS


def test_gzip_and_line_ends(spark, tmp_path):
    (tmp_path / "x.fastq.gz").write_bytes(gzip.compress(fastq(ROWS[:90], "\r\n")) + gzip.compress(fastq(ROWS[90:])))
    got = read_fastq(spark, str(tmp_path / "x.fastq.gz")).orderBy("read_idx").collect()
    assert [(r.id, r.seq, r.qual) for r in got] == ROWS


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id string, seq string, qual string").coalesce(1)
    write_fastq(df, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part*"))
    part.rename(tmp_path / "y.fastq")
    assert read_fastq(spark, str(tmp_path / "y.fastq")).count() == len(ROWS)


def test_bad_files(spark, tmp_path):
    (tmp_path / "bad.fastq").write_bytes(b"@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ record at 0"):
        read_fastq(spark, str(tmp_path / "bad.fastq")).collect()
    (tmp_path / "empty.fastq").write_bytes(b"")
    with pytest.raises(ValueError, match="input file is empty"):
        run(read_fastq(spark, str(tmp_path / "empty.fastq")), Context("empty.fastq", "empty"))


def test_texts(spark, tmp_path):
    reads = spark.createDataFrame([(0, "ACGT", "IIII"), (1, "ACGN", "II#I")], "read_idx long, seq string, qual string")
    report = run(reads, Context("t.fastq", "t"))
    text = text_report.data_text(report)
    assert text.startswith(">>Basic Statistics\tpass\n#Measure\tValue\nFilename\tt.fastq\nFile type\tConventional base calls\nEncoding\tSanger / Illumina 1.9\nTotal Sequences\t2\nFiltered Sequences\t0\nSequence length\t4\n%GC\t50\n>>END_MODULE\n")
    assert "\n3\t21.0\t2\t2\t40\t2\t40\n" in text and "#Base\tG\tA\tT\tC\n1\t0.0\t100.0\t0.0\t0.0\n" in text
    assert text_report.summary_text(report).splitlines()[5] == "FAIL\tPer base N content\tt.fastq"
    made = datetime(2026, 1, 2, tzinfo=UTC)
    folder = bundle.write_report(report, tmp_path, made=made)
    first = (tmp_path / "t_fastqc.zip").read_bytes()
    bundle.write_report(report, tmp_path, made=made)
    assert (tmp_path / "t_fastqc.zip").read_bytes() == first
    assert sorted(zipfile.ZipFile(tmp_path / "t_fastqc.zip").namelist()) == ["t_fastqc/fastqc_data.txt", "t_fastqc/fastqc_report.html", "t_fastqc/summary.txt"]
    latex.export(report, folder / "latex", "supplement")
    assert len(list((folder / "latex/figures").glob("*.svg"))) == 10


def test_page_escapes():
    report = Report(Context("<b>&.fq", "s", "long"), {"basic_stats": [Row(total_sequences=1, min_len=1, max_len=2, gc_percent=3)], "length_summary": [Row(min_len=1, max_len=2, mean=1.25, n50=5, n90=5)], "length_bins": [], "per_seq_quality": [], "per_seq_gc": [], "per_seq_n": [], "adapter_any": [Row(a0=0.0, a1=0.0, a2=0.0, a3=0.0, a4=0.0)]}, dict.fromkeys(("basic_stats", "length_dist", "per_seq_quality", "per_seq_gc", "per_seq_n", "adapter_content"), "PASS"))
    from readprism.sinks.html_report import html_text

    assert "<b>&.fq" not in html_text(report)
    assert "Mean\t1.2\n" in text_report.data_text(report)
    assert text_report.scientific(1e-4) == "1.00e-4"


def test_command_line(spark, tmp_path):
    (tmp_path / "x.fastq.gz").write_bytes(gzip.compress(fastq(ROWS)))
    assert cli.main(["run", str(tmp_path / "x.fastq.gz"), "--out", str(tmp_path / "o"), "--mode", "long", "--export-latex", "summary"]) == 0
    assert (tmp_path / "o/x.fastq_fastqc/fastqc_report.html").exists() and (tmp_path / "o/x.fastq_fastqc.zip").exists()
    with pytest.raises(SystemExit):
        cli.main(["run", "-", "--out", str(tmp_path)])


def statuses(df):
    return {r.module: r.status for r in df.collect()}


def test_verdict_edges(spark):
    def tables(**over):
        base = {
            "per_base_quality": "select 30 as median", "quality_flags": "select 100L as reads, 0L as low", "per_base_content": "select 25d as g, 25d as a, 25d as t, 25d as c", "per_base_n": "select 0d as n_percent",
            "duplication_levels": "select 1 as level, 100L as reads union all select 2, 0L", "frequent": "select 0d as percent where false", "adapter_by_position": "select 0d a0, 0d a1, 0d a2, 0d a3, 0d a4", "kmer_enrichment": "select 1d as obs_exp",
        }
        return {k: spark.sql(v) for k, v in (base | over).items()}

    edges = [
        ("per_base_quality", "per_base_quality", "select {} as median", [(25, "PASS"), (24, "WARN"), (20, "WARN"), (19, "FAIL")]),
        ("per_seq_quality", "quality_flags", "select 100L as reads, {}L as low", [(10, "PASS"), (11, "WARN"), (20, "WARN"), (21, "FAIL")]),
        ("per_base_content", "per_base_content", "select {}d as g, 25d as a, 25d as t, 25d as c", [(35, "PASS"), (36, "WARN"), (45, "WARN"), (46, "FAIL")]),
        ("per_base_n", "per_base_n", "select {}d as n_percent", [(5, "PASS"), (6, "WARN"), (20, "WARN"), (21, "FAIL")]),
        ("duplication_levels", "duplication_levels", "select 1 as level, 100L - {0}L as reads union all select 2, {0}L", [(50, "PASS"), (51, "WARN"), (80, "WARN"), (81, "FAIL")]),
        ("overrepresented", "frequent", "select {}d as percent", [(0.04, "PASS"), (0.05, "WARN"), (0.1, "FAIL")]),
        ("adapter_content", "adapter_by_position", "select 0d a0, 0d a1, {}d a2, 0d a3, 0d a4", [(5, "PASS"), (6, "WARN"), (10, "WARN"), (11, "FAIL")]),
        ("kmer_content", "kmer_enrichment", "select {}d as obs_exp", [(2.9, "PASS"), (3, "WARN"), (5, "FAIL")]),
    ]
    for module, table, sql, cases in edges:
        for value, status in cases:
            assert statuses(verdicts.short_verdicts(tables(**{table: sql.format(value)})))[module] == status, (module, value)


def test_long_verdict_edges(spark):
    def tables(**over):
        base = {"per_seq_quality": "select 30 as mean_q, 100L as cnt", "n_flags": "select 100L as reads, 0L as gt20, 0L as gt10", "adapter_any": "select 0d a0, 0d a1, 0d a2, 0d a3, 0d a4"}
        return {k: spark.sql(v) for k, v in (base | over).items()}

    edges = [
        ("per_seq_quality", "per_seq_quality", "select {} as mean_q, 51L as cnt union all select 40, 50L", [(10, "PASS"), (9, "WARN"), (7, "WARN"), (6, "FAIL")]),
        ("per_seq_n", "n_flags", "select 100L as reads, 0L as gt20, {}L as gt10", [(5, "PASS"), (6, "WARN")]),
        ("per_seq_n", "n_flags", "select 100L as reads, {}L as gt20, 100L as gt10", [(5, "WARN"), (6, "FAIL")]),
        ("adapter_content", "adapter_any", "select 0d a0, {}d a1, 0d a2, 0d a3, 0d a4", [(5, "PASS"), (6, "WARN"), (10, "WARN"), (11, "FAIL")]),
    ]
    for module, table, sql, cases in edges:
        for value, status in cases:
            assert statuses(verdicts.long_verdicts(tables(**{table: sql.format(value)})))[module] == status, (module, value)
