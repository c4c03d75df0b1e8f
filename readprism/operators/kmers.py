"""Words of seven bases: counts by relative position, and those enriched somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprism.operators import tallies as T

TOP = 50
WARN, FAIL = 3.0, 5.0


def kmer_counts(reads: DataFrame) -> DataFrame:
    """(kmer, bin, cnt): every window of seven bases of A, C, G and T, by tenth of the read."""
    return kmers_of(T.tallies(reads, kinds=["kmer"]))


def kmers_of(table: DataFrame) -> DataFrame:
    """Word counts from tallies: at most 4^7 * 10 rows."""
    base = lambda j: F.substr(F.lit("ACGT"), F.shiftright("a", 2 * j).bitwiseAND(F.lit(3)) + 1, F.lit(1))
    return T.of_kind(table, "kmer").select(F.concat(*[base(j) for j in reversed(range(T.K))]).alias("kmer"), F.col("b").alias("bin"), "cnt")


def kmer_enrichment(counts: DataFrame) -> DataFrame:
    """(kmer, cnt, obs_exp, bin): each word's largest ratio of its share in a bin to its overall share; the first bin of equals.

    At most 4^7 * 10 rows come in, so the totals are windows over a small table.
    """
    word, by_bin, whole = Window.partitionBy("kmer"), Window.partitionBy("bin"), Window.partitionBy()
    totals = counts.withColumn("kmer_cnt", F.sum("cnt").over(word)).withColumn("bin_cnt", F.sum("cnt").over(by_bin)).withColumn("total", F.sum("cnt").over(whole))
    ratio = (F.col("cnt").cast("double") / F.col("bin_cnt").cast("double")) / (F.col("kmer_cnt").cast("double") / F.col("total").cast("double"))
    best = F.row_number().over(word.orderBy(F.desc("obs_exp"), "bin"))
    return totals.withColumn("obs_exp", ratio).withColumn("place", best).where("place = 1").select("kmer", F.col("kmer_cnt").alias("cnt"), "obs_exp", "bin")


def enriched_kmers(counts: DataFrame) -> DataFrame:
    """(kmer, cnt, neg_log10_p, obs_exp, max_pos): the 50 most enriched words of a ratio of at least 3."""
    exponent = F.when(F.col("obs_exp") <= 1.0, F.lit(0.0)).otherwise(F.least(F.lit(50.0), F.lit(2.0) * (F.col("obs_exp") - F.lit(1.0))))
    top = kmer_enrichment(counts).where(F.col("obs_exp") >= WARN).orderBy(F.desc("obs_exp"), "kmer").limit(TOP)
    return top.select("kmer", "cnt", exponent.alias("neg_log10_p"), "obs_exp", (F.col("bin") * 10 + 5).alias("max_pos"))
