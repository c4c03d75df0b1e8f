"""Duplicate and overrepresented sequences, exact; and approximate options.

At scale, sequences are counted by fingerprints of 128 bits (``fingerprints``): a
read, however long, is two numbers and a count in the shuffle. Bases travel only
for the few fingerprints that may be reported (``reported``), and those sequences are
counted by their bases again, so sequences that share a fingerprint are told apart in
what is reported. In the duplication levels, which look at numbers alone, two
of n distinct sequences are taken as one with a probability of n * n / 2^129: 1e-15 for 1e12.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprism.functions import bases as B

LEVELS = 7
REPORTED_PERCENT = 0.1
#: Up to so many fingerprints are broadcast.
FEW = 100_000
PRINT = ("h1", "h2")


def sequence_counts(reads: DataFrame) -> DataFrame:
    """(seq, cnt, first_idx if reads are numbered): the shared input of both modules.

    Copies are combined before the shuffle, so a sequence that very many reads
    share is one row of each task.
    """
    first = [F.min("read_idx").alias("first_idx")] if "read_idx" in reads.columns else []
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("cnt"), *first)


def printed(reads: DataFrame) -> DataFrame:
    """Reads with the two halves of their sequence's fingerprint, which are hashes of different seeds."""
    return reads.select("*", F.xxhash64("seq").alias("h1"), F.xxhash64(F.lit(1), "seq").alias("h2"))


def fingerprints(reads: DataFrame) -> DataFrame:
    """(h1, h2, cnt): reads by the fingerprint of their sequence; copies are combined before the shuffle."""
    return printed(reads).groupBy(*PRINT).agg(F.count(F.lit(1)).alias("cnt"))


def shares(counts: DataFrame, least_percent: float = REPORTED_PERCENT) -> DataFrame:
    """Of fingerprints or sequences with counts, those of at least so many percent of all reads, with ``total`` and ``percent``."""
    total = counts.agg(F.sum("cnt").alias("total"))
    share = F.col("cnt") * F.lit(100.0) / F.col("total")
    return counts.crossJoin(F.broadcast(total)).where(share >= least_percent).withColumn("percent", share)


def reported(prints: DataFrame, reads: DataFrame, *, least_percent: float = REPORTED_PERCENT) -> DataFrame:
    """(sequence, cnt, percent, source) like ``overrepresented``, from the fingerprints of ``reads`` and one more pass over them.

    A sequence is at most as frequent as its fingerprint, so none is missed; there
    are at most 100 / ``least_percent`` such fingerprints. Of numbered reads a sequence is
    shown as its first read has it, otherwise in upper case.
    """
    found = shares(prints, least_percent).select(*PRINT, "total")
    some = printed(reads).join(F.broadcast(found) if least_percent * FEW >= 100 else found, list(PRINT))
    folded = F.substr("seq", F.lit(1), F.lit(B.TRIM))
    counted, shown = F.count(F.lit(1)).alias("cnt"), folded
    if {"read_idx", "written"} <= set(reads.columns):
        numbered = F.when(F.col("read_idx").isNotNull(), F.struct("read_idx", F.substr("written", F.lit(1), F.lit(B.TRIM)).alias("text")))
        counts = some.groupBy("seq", "total").agg(counted, F.min(numbered).alias("first"))
        shown = F.coalesce(F.col("first.text"), folded)
    else:
        counts = some.groupBy("seq", "total").agg(counted)
    share = F.col("cnt") * F.lit(100.0) / F.col("total")
    return counts.where(share >= least_percent).select(shown.alias("sequence"), "cnt", share.alias("percent"), B.likely_source(folded).alias("source"))


def duplication_levels(counts: DataFrame) -> DataFrame:
    """(level, reads, relative): reads whose sequence occurs 1, 2, ... 7 or more times, as a fraction."""
    by_level = counts.groupBy(F.least("cnt", F.lit(LEVELS)).cast("int").alias("level")).agg(F.sum("cnt").alias("reads"))
    levels = counts.sparkSession.range(1, LEVELS + 1).select(F.col("id").cast("int").alias("level"))
    full = levels.join(F.broadcast(by_level), "level", "left").withColumn("reads", F.coalesce("reads", F.lit(0).cast("long")))
    total = F.sum("reads").over(Window.partitionBy())
    return full.select("level", "reads", F.when(total > 0, F.col("reads").cast("double") / total.cast("double")).otherwise(F.lit(0.0)).alias("relative"))


def overrepresented(counts: DataFrame, reads: DataFrame | None = None, *, least_percent: float = REPORTED_PERCENT) -> DataFrame:
    """(sequence, cnt, percent, source) of sequences of at least 0.1 percent of reads: at most a thousand rows.

    With numbered ``reads`` a sequence is shown as its first read has it, otherwise
    in upper case. The few sequences are broadcast to find those reads; counting
    itself carries only numbers.
    """
    total = counts.agg(F.sum("cnt").alias("total"))
    share = F.col("cnt") * F.lit(100.0) / F.col("total")
    folded = F.substr("seq", F.lit(1), F.lit(B.TRIM))
    found = counts.crossJoin(F.broadcast(total)).where(share >= least_percent)
    shown = folded
    if reads is not None and {"read_idx", "written"} <= set(reads.columns):
        numbered = reads.select(F.col("read_idx").alias("first_idx"), "seq", "written")
        firsts = numbered.join(F.broadcast(found.select("first_idx", "seq")), ["first_idx", "seq"]).groupBy("seq").agg(F.min("written").alias("written"))
        found = found.join(F.broadcast(firsts), "seq", "left")
        shown = F.coalesce(F.substr("written", F.lit(1), F.lit(B.TRIM)), folded)
    return found.select(shown.alias("sequence"), "cnt", share.alias("percent"), B.likely_source(folded).alias("source"))


def source_classes(counts: DataFrame) -> DataFrame:
    """(source, sequences, reads): distinct sequences and reads by likely source."""
    source = B.likely_source(F.substr("seq", F.lit(1), F.lit(B.TRIM)))
    return counts.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("sequences"), F.sum("cnt").alias("reads"))


def frequent_sequences_sketch(reads: DataFrame, *, k: int = 100, size: int = 10_000) -> DataFrame:
    """(seq, cnt): the ``k`` most frequent by Spark's heavy-hitter sketch of ``size`` entries, of bounded memory."""
    top = reads.agg(F.expr(f"approx_top_k(seq, {int(k)}, {int(size)})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("seq"), F.col("t.count").alias("cnt"))


def distinct_sequences_sketch(reads: DataFrame, *, lg_k: int = 14) -> DataFrame:
    """One row ``sequences``: number of distinct sequences by a mergeable sketch."""
    return reads.agg(F.hll_sketch_estimate(F.hll_sketch_agg("seq", lg_k)).alias("sequences"))
