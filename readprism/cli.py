"""Command line: ``python -m readprism run reads.fastq.gz --out results``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from readprism.operators.quality import SNIFFED_READS, phred_offset
from readprism.plans.report import Context, run
from readprism.plans.stages import Stages
from readprism.sinks import latex
from readprism.sinks.bundle import write_report
from readprism.sources.fastq import read_fastq


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readprism", description="Quality control of sequencing reads on Spark")
    one = top.add_subparsers(dest="command", required=True).add_parser("run", help="check one FASTQ file")
    one.add_argument("reads", help="FASTQ file, gzip or plain")
    one.add_argument("--out", required=True, type=Path)
    one.add_argument("--threads", type=int, default=os.cpu_count() or 1, help="local Spark threads, unless a master is configured")
    one.add_argument("--sample-name")
    one.add_argument("--phred-offset", choices=("auto", "33", "64"), default="auto")
    one.add_argument("--mode", choices=("short", "long"), default="short")
    one.add_argument("--no-zip", action="store_true")
    one.add_argument("--no-kmer", action="store_true", help="leave the k-mer module out")
    one.add_argument("--export-latex", choices=("summary", "supplement"))
    one.add_argument("--stats", action="store_true", help="print seconds, reads, bases, rows, jobs and tasks of each stage to standard error")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.threads < 1:
        raise SystemExit("--threads must be at least 1")
    if args.reads == "-":
        raise SystemExit("reading from standard input is not supported")
    if "://" not in args.reads and not Path(args.reads).is_file():
        raise SystemExit(f"no such file: {args.reads}")
    builder = SparkSession.builder.appName("readprism").config("spark.sql.session.timeZone", "UTC")
    spark = SparkSession.getActiveSession() or (builder if os.environ.get("SPARK_MASTER") else builder.master(f"local[{args.threads}]")).getOrCreate()
    stages = Stages(spark)
    reads = read_fastq(spark, args.reads, columns=("read_idx", "seq", "qual"))
    with stages.stage("offset"):
        if args.phred_offset == "auto":
            found = phred_offset(read_fastq(spark, args.reads, columns=("qual",), records=SNIFFED_READS)).first()["offset"]
            if found is None and reads.isEmpty():
                raise SystemExit("input file is empty")
            offset = found or 33
        else:
            offset = int(args.phred_offset)
    name = Path(args.reads).name
    context = Context(name, args.sample_name or Path(name).stem, args.mode, offset, not args.no_kmer)
    report = run(reads, context, stages if args.stats else None)
    with stages.stage("files"):
        folder = write_report(report, args.out, zipped=not args.no_zip)
        if args.export_latex:
            latex.export(report, folder / "latex", args.export_latex)
    if args.stats:
        print(stages.table(), file=sys.stderr)
    return 0
