"""Read lengths: exact for short reads, powers of ten and N50/N90 for long ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprism.functions import bases as B
from readprism.operators import tallies as T


def length_dist(reads: DataFrame) -> DataFrame:
    """(length, cnt)."""
    return reads.groupBy(F.col("n").alias("length")).agg(F.count(F.lit(1)).alias("cnt"))


def lengths_of(table: DataFrame) -> DataFrame:
    """(length, cnt) from tallies."""
    return T.of_kind(table, "length").select(F.col("a").alias("length"), "cnt")


def length_bins(reads: DataFrame) -> DataFrame:
    """(bin, label, cnt) for all eight bins, empty ones too."""
    return bins_of(length_dist(reads))


def bins_of(hist: DataFrame) -> DataFrame:
    """Length bins from counts of lengths (length, cnt)."""
    counts = hist.select(B.length_bin(F.col("length")).alias("bin"), "cnt").groupBy("bin").agg(F.sum("cnt").alias("cnt"))
    labels = hist.sparkSession.createDataFrame([(i, label, mid) for i, (label, mid) in enumerate(zip(B.LENGTH_LABELS, B.LENGTH_MIDS))], "bin int, label string, mid long")
    return labels.join(F.broadcast(counts), "bin", "left").select("bin", "label", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"), "mid")


def length_summary(reads: DataFrame) -> DataFrame:
    """One row: min, max, mean, and N50 and N90 by bin midpoints (0 if midpoints never reach the share)."""
    return summary_of(length_dist(reads))


def summary_of(hist: DataFrame) -> DataFrame:
    """The length summary from counts of lengths (length, cnt)."""
    bases = F.sum(F.col("length").cast("long") * F.col("cnt"))
    stats = hist.agg(F.sum("cnt").alias("reads"), bases.alias("bases"), F.min("length").alias("min_len"), F.max("length").alias("max_len")).where("reads > 0")
    longest_first = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    walked = bins_of(hist).withColumn("held", F.sum(F.col("cnt") * F.col("mid")).over(longest_first)).crossJoin(F.broadcast(stats))
    reach = lambda share: F.coalesce(F.max(F.when(F.col("held") >= F.floor(F.col("bases") * F.lit(share)), F.col("mid"))), F.lit(0).cast("long"))
    return walked.groupBy("reads", "bases", "min_len", "max_len").agg(reach(0.5).alias("n50"), reach(0.9).alias("n90")).select(
        "min_len", "max_len", (F.col("bases").cast("double") / F.col("reads").cast("double")).alias("mean"), "n50", "n90"
    )


def exact_nxx(reads: DataFrame, share: float = 0.5) -> DataFrame:
    """One row ``n_exact``: the length at which reads, longest first, hold the share of all bases; by a histogram of lengths."""
    hist = length_dist(reads).withColumn("bases", F.col("length").cast("long") * F.col("cnt"))
    held = hist.withColumn("held", F.sum("bases").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("bases").over(Window.partitionBy()))
    return held.where(F.col("held") >= F.col("all") * F.lit(share)).agg(F.max("length").alias("n_exact"))
