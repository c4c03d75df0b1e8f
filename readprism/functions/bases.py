"""Expressions on one read: composition, quality and classification.

Reads are rows (seq, qual) of ASCII strings. All expressions are built in and
run inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_Q = 93
LOW_QUALITY = 20

# Adapters in report order, and the 12-mers that name an adapter as source.
ADAPTERS = (
    "AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC",
    "TGGAATTCTCGGGTGCCAAGG",
    "GTTCAGAGTTCTACAGTCCGACGATC",
    "CTGTCTCTTATACACATCT",
    "CGCCTTGGCCGTACAGCAG",
)
SOURCE_MERS = ("AGATCGGAAGAG", "TGGAATTCTCGG", "ATCTCGTATGCC", "CTGTCTCTTATA", "CGCCTTGGCCGT")
# Lengths of long reads by power of ten, and the length that stands for each bin.
LENGTH_LABELS = ("1-9", "10-99", "100-999", "1k-9k", "10k-99k", "100k-999k", "1M-9M", "10M+")
LENGTH_MIDS = (5, 55, 550, 5_500, 55_000, 550_000, 5_500_000, 10_000_000)
TRIM = 150


def nonempty(reads: DataFrame) -> DataFrame:
    """Reads that have bases.

    The projection below the condition holds a random number, so Catalyst doesn't push a copy
    of the condition below it: the expression of a derived ``seq`` would be worked out twice.
    """
    return reads.withColumn("_drawn", F.rand(0)).where((F.length("seq") > 0) & (F.col("_drawn") < 2)).drop("_drawn")


def prepared(reads: DataFrame) -> DataFrame:
    """Non-empty reads as (seq in upper case, qual, n); of numbered reads also ``read_idx`` and ``written``, the bases as they stand."""
    order = ["read_idx", F.col("seq").alias("written")] if "read_idx" in reads.columns else []
    return nonempty(reads).select(*order, F.upper("seq").alias("seq"), "qual", F.length("seq").alias("n"))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are one of ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def percent_rounded(part: Column, whole: Column) -> Column:
    """100 * part / whole in integers, halves up."""
    return (F.lit(100) * part + _div(whole, 2)) / whole


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def gc_percent(seq: Column, n: Column) -> Column:
    """GC share of a whole read, N included in its length."""
    return F.least(F.floor(percent_rounded(count_of(seq, "GC"), n)), F.lit(100)).cast("int")


def n_percent(seq: Column, n: Column) -> Column:
    return F.least(F.floor(percent_rounded(count_of(seq, "N"), n)), F.lit(100)).cast("int")


def length_bin(n: Column) -> Column:
    return F.least(F.length(n.cast("string")) - 1, F.lit(len(LENGTH_LABELS) - 1))


def likely_source(seq: Column) -> Column:
    """Where an overrepresented sequence (upper case, trimmed) may come from."""
    adapter = F.lit(False)
    for mer in SOURCE_MERS:
        adapter = adapter | F.contains(seq, F.lit(mer))
    return F.when(seq.rlike("^A{20,}$"), "Poly-A").when(seq.rlike("^T{20,}$"), "Poly-T").when(adapter, "Adapter").otherwise("No Hit")
