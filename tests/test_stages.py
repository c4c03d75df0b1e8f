"""Stages of a run and what they took."""

import pytest

from readprism import cli
from readprism.functions import bases as B
from readprism.plans.report import MODULES, Context, run
from readprism.plans.stages import Stages, observed
from readprism.sources.fastq import read_fastq

ROWS = [("ACGTN"[: 1 + i % 5] * (1 + i % 3), "@+I5#"[: 1 + i % 5] * (1 + i % 3)) for i in range(200)]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "x.fastq").write_text("".join(f"@r\n{s}\n+\n{q}\n" for s, q in ROWS))
    return tmp_path / "x.fastq"


@pytest.mark.parametrize("mode", ["short", "long"])
def test_stages_of_a_run(spark, path, mode):
    reads, stages = read_fastq(spark, str(path), split_bytes=500, columns=("read_idx", "seq", "qual")), Stages(spark)
    measured, plain = run(reads, Context("x", "x", mode), stages), run(reads, Context("x", "x", mode))
    assert measured == plain
    found = {s.name: s for s in stages.done}
    assert [s.name for s in stages.done][:2] == ["input", "histograms"] and len(found) == len(stages.done)
    assert (found["histograms"].reads, found["histograms"].bases) == (len(ROWS), sum(len(s) for s, _ in ROWS))
    assert found["histograms"].jobs >= 1 and found["histograms"].tasks > 3 and found["histograms"].seconds > 0
    if mode == "short":
        assert found["sequences"].rows == len({s for s, _ in ROWS})
    for name, rows in measured.rows.items():
        assert found[name].rows == len(rows)
    assert set(MODULES[mode]) - {"adapter_content", "kmer_content", "length_dist"} <= set(found)


def test_job_group_is_given_back_and_failures_are_listed(spark):
    spark.sparkContext.setJobGroup("mine", "of the caller")
    stages = Stages(spark)
    with pytest.raises(ZeroDivisionError), stages.stage("broken"):
        spark.range(10).count()
        raise ZeroDivisionError
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    assert [(s.name, s.jobs > 0, s.reads) for s in stages.done] == [("broken", True, None)]
    assert stages.table().splitlines()[0].split("\t") == ["stage", "seconds", "reads", "bases", "rows", "jobs", "tasks"]
    assert stages.table().splitlines()[1].split("\t")[2:5] == ["", "", ""]
    for p in ("spark.jobGroup.id", "spark.job.description"):
        spark.sparkContext.setLocalProperty(p, None)


def test_no_reads_are_observed_as_none(spark):
    watched, seen = observed(B.prepared(spark.createDataFrame([], "seq string, qual string")))
    assert watched.count() == 0 and seen.get == {"reads": 0, "bases": 0}


def test_command_line_prints_the_table(spark, path, tmp_path, capsys):
    assert cli.main(["run", str(path), "--out", str(tmp_path / "out"), "--stats", "--no-zip"]) == 0
    lines = [line.split("\t") for line in capsys.readouterr().err.splitlines() if "\t" in line]
    named = {line[0]: line[1:] for line in lines}
    assert {"offset", "input", "histograms", "sequences", "verdicts", "files"} <= set(named)
    assert named["histograms"][1:3] == [str(len(ROWS)), str(sum(len(s) for s, _ in ROWS))]
