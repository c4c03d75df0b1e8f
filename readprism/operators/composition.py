"""Whole-run statistics and composition by position and by read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprism.functions import bases as B
from readprism.operators import tallies as T


def basic_stats(reads: DataFrame) -> DataFrame:
    """One row: reads, bases, shortest, longest, GC percent (0 and null lengths without reads)."""
    totals = reads.select("n", B.count_of(F.col("seq"), "GC").alias("gc")).agg(
        F.count(F.lit(1)).alias("total_sequences"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("total_bases"),
        F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.coalesce(F.sum(F.col("gc").cast("long")), F.lit(0)).alias("gc"),
    )
    percent = F.expr("case when total_bases > 0 then (100 * gc + total_bases div 2) div total_bases else 0 end")
    return totals.select("total_sequences", "total_bases", "min_len", "max_len", percent.cast("int").alias("gc_percent"))


def position_counts(reads: DataFrame, offset: int) -> DataFrame:
    """(base, b, q, cnt): bases and qualities at each 1-based position; ``*`` stands for other letters."""
    return positions_of(T.tallies(reads, offset, ["position"]))


def positions_of(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Position counts from tallies; ``by``: of each value of these columns."""
    return T.of_kind(table, "position").select(*by, F.col("a").alias("base"), F.substr(F.lit(T.LETTERS), F.col("b") + 1, F.lit(1)).alias("b"), F.col("c").alias("q"), "cnt")


def letter_counts(reads: DataFrame) -> DataFrame:
    """(base, b, cnt): like ``position_counts`` without qualities, which then aren't read."""
    return letters_of(T.tallies(reads, kinds=["base"]))


def letters_of(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Letter counts from tallies; ``by``: of each value of these columns."""
    return T.of_kind(table, "base").select(*by, F.col("a").alias("base"), F.substr(F.lit(T.LETTERS), F.col("b") + 1, F.lit(1)).alias("b"), "cnt")


def base_counts(positions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(base, a, c, g, t, n) from position or letter counts."""
    sums = [F.sum(F.when(F.col("b") == x, F.col("cnt")).otherwise(F.lit(0).cast("long"))).alias(x.lower()) for x in "ACGTN"]
    return positions.groupBy(*by, "base").agg(*sums)


def per_base_content(positions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(base, g, a, t, c): percents of the four bases, N left out."""
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    share = lambda x: F.when(total == 0, F.lit(0.0)).otherwise(F.col(x) * F.lit(100.0) / total).alias(x)
    return base_counts(positions, by).select(*by, "base", *[share(x) for x in "gatc"])


def per_base_n(positions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(base, n_percent): share of N among A, C, G, T and N."""
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("n")
    return base_counts(positions, by).select(*by, "base", F.when(total == 0, F.lit(0.0)).otherwise(F.col("n") * F.lit(100.0) / total).alias("n_percent"))


def per_seq_gc(reads: DataFrame) -> DataFrame:
    """(gc, cnt): reads by rounded GC percent."""
    return reads.select(B.gc_percent(F.col("seq"), F.col("n")).alias("gc")).groupBy("gc").agg(F.count(F.lit(1)).alias("cnt"))


def per_seq_n(reads: DataFrame) -> DataFrame:
    """(n_percent, cnt): reads by rounded N percent."""
    return reads.select(B.n_percent(F.col("seq"), F.col("n")).alias("n_percent")).groupBy("n_percent").agg(F.count(F.lit(1)).alias("cnt"))


def n_flags(reads: DataFrame) -> DataFrame:
    """One row: reads of over 20 percent N, and of 11 to 20 percent."""
    p = F.col("p")
    return reads.select(B.n_percent(F.col("seq"), F.col("n")).alias("p")).agg(F.count(F.lit(1)).alias("reads"), F.count_if(p > 20).alias("gt20"), F.count_if((p > 10) & (p <= 20)).alias("gt10"))


def basic_of(table: DataFrame) -> DataFrame:
    """``basic_stats`` from tallies (length, strong)."""
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0).cast("long"))
    bases, length = F.col("a").cast("long") * F.col("cnt"), F.when(F.col("kind") == "length", F.col("a"))
    totals = table.where(F.col("kind").isin("length", "strong")).agg(
        of("length", F.col("cnt")).alias("total_sequences"), of("length", bases).alias("total_bases"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), of("strong", bases).alias("gc")
    )
    percent = F.expr("case when total_bases > 0 then (100 * gc + total_bases div 2) div total_bases else 0 end")
    return totals.select("total_sequences", "total_bases", "min_len", "max_len", percent.cast("int").alias("gc_percent"))


def gc_of(table: DataFrame) -> DataFrame:
    """``per_seq_gc`` from tallies."""
    return T.of_kind(table, "gc").select(F.col("a").alias("gc"), "cnt")


def n_of(table: DataFrame) -> DataFrame:
    """``per_seq_n`` from tallies."""
    return T.of_kind(table, "n").select(F.col("a").alias("n_percent"), "cnt")


def flags_of(table: DataFrame) -> DataFrame:
    """``n_flags`` from tallies."""
    count = lambda fits: F.coalesce(F.sum(F.when(fits, F.col("cnt"))), F.lit(0).cast("long"))
    p = F.col("n_percent")
    return n_of(table).agg(count(F.lit(True)).alias("reads"), count(p > 20).alias("gt20"), count((p > 10) & (p <= 20)).alias("gt10"))
