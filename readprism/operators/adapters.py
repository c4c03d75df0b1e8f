"""Adapter content: by start position for short reads, by read for long ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprism.functions import bases as B
from readprism.operators import tallies as T


def adapter_counts(reads: DataFrame) -> DataFrame:
    return T.tallies(reads, kinds=["adapter", "length"])


def adapter_by_position(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(position, a0..a4): percent of reads in which the adapter starts there; a row for each position. From tallies.

    The tallies are used once, so that one pass makes them. A read's length counts at
    position 1; positions without a start are filled in up to the next that has one.
    """
    hits = F.col("kind") == "adapter"
    count = lambda i: F.sum(F.when(hits & (F.col("b") == i), F.col("cnt")).otherwise(F.lit(0).cast("long"))).alias(f"c{i}")
    starts = table.where(F.col("kind").isin("adapter", "length")).groupBy(*by, F.when(hits, F.col("a")).otherwise(F.lit(1)).alias("start")).agg(
        *[count(i) for i in range(len(B.ADAPTERS))], F.sum(F.when(~hits, F.col("cnt"))).alias("total"), F.max(F.when(~hits, F.col("a"))).alias("longest")
    )
    here = Window.partitionBy(*by)
    whole = [F.max(c).over(here).alias(c) for c in ("total", "longest")]
    filled = starts.select(*by, "start", *[f"c{i}" for i in range(len(B.ADAPTERS))], *whole, F.lead("start").over(here.orderBy("start")).alias("next"))
    positions = filled.select("*", F.explode(F.sequence("start", F.coalesce("next", F.col("longest") + 1) - 1)).alias("position"))
    share = lambda i: (F.when(F.col("position") == F.col("start"), F.col(f"c{i}")).otherwise(F.lit(0)) * F.lit(100.0) / F.col("total")).alias(f"a{i}")
    return positions.select(*by, "position", *[share(i) for i in range(len(B.ADAPTERS))])


def adapter_any(reads: DataFrame) -> DataFrame:
    """One row (a0..a4): percent of reads that hold the adapter anywhere."""
    hits = [F.count_if(F.contains("seq", F.lit(a))).alias(f"c{i}") for i, a in enumerate(B.ADAPTERS)]
    counted = reads.agg(F.count(F.lit(1)).alias("total"), *hits)
    return counted.select(*[F.when(F.col("total") > 0, F.col(f"c{i}") * F.lit(100.0) / F.col("total")).otherwise(F.lit(0.0)).alias(f"a{i}") for i in range(len(B.ADAPTERS))])


def any_of(table: DataFrame) -> DataFrame:
    """``adapter_any`` from tallies (holds, length)."""
    hits = [F.coalesce(F.sum(F.when((F.col("kind") == "holds") & (F.col("a") == i), F.col("cnt"))), F.lit(0).cast("long")).alias(f"c{i}") for i in range(len(B.ADAPTERS))]
    counted = table.where(F.col("kind").isin("holds", "length")).agg(F.sum(F.when(F.col("kind") == "length", F.col("cnt"))).alias("total"), *hits)
    return counted.select(*[F.when(F.col("total") > 0, F.col(f"c{i}") * F.lit(100.0) / F.col("total")).otherwise(F.lit(0.0)).alias(f"a{i}") for i in range(len(B.ADAPTERS))])
