"""Sketches of sequences by sample, as state of bounded size that is stored and combined.

A state has one row a sample: its number of reads, a heavy-hitter sketch and a sketch
of distinct sequences, by Spark's own aggregates. States of parts, files or batches
combine to a state of all of them, without their reads.

What the heavy-hitter sketch says is bounded: of N reads, a count is at most
``error_share(size) * N`` above the true one and never below it, and every sequence of more
than twice that many reads is listed. The bound also holds for combined states.
``size`` is that of every state that is combined.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 10_000
LG_K = 14


def error_share(size: int = SIZE) -> float:
    """By what share of all reads a count may be too high: 3.5 over the slots of a map that is three quarters full with ``size`` sequences."""
    return 3.5 / 2 ** math.ceil(math.log2(math.ceil(size / 0.75)))


def accumulate(reads: DataFrame, *, size: int = SIZE, lg_k: int = LG_K) -> DataFrame:
    """The state (sample, n, top, hll) of reads (sample, seq); empty reads don't count."""
    ready = reads.where(F.length("seq") > 0).select("sample", F.upper("seq").alias("seq"))
    top = F.expr(f"approx_top_k_accumulate(seq, {int(size)})")
    return ready.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), top.alias("top"), F.hll_sketch_agg("seq", lg_k).alias("hll"))


def combine(*states: DataFrame) -> DataFrame:
    """The state of the reads of all ``states``, which are of one ``size`` and ``lg_k``."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy("sample").agg(F.sum("n").alias("n"), F.expr("approx_top_k_combine(top)").alias("top"), F.hll_union_agg("hll").alias("hll"))


def frequent(state: DataFrame, *, least_percent: float = 0.1, size: int = SIZE) -> DataFrame:
    """(sample, seq, cnt, off): all sequences of at least so many percent of a sample's reads, and perhaps others of nearly as many.

    The true count is from ``cnt - off`` to ``cnt``.
    """
    share, error = least_percent / 100, error_share(size)
    if share <= 2 * error:
        raise ValueError(f"a sketch of {size} sequences lists all of more than {200 * error:.4f} percent, not of {least_percent}")
    # Sequences of which the sketch may say as much are each at least so frequent.
    most = math.ceil(1 / (share - error))
    listed = state.select("sample", "n", F.explode(F.expr(f"approx_top_k_estimate(top, {most})")).alias("t"))
    rows = listed.select("sample", F.col("t.item").alias("seq"), F.col("t.count").alias("cnt"), F.ceil(F.col("n") * F.lit(error)).cast("long").alias("off"), "n")
    return rows.where(F.col("cnt") >= F.col("n") * F.lit(share)).drop("n")


def distinct(state: DataFrame) -> DataFrame:
    """(sample, sequences): about how many distinct sequences; the standard error is 1.04 / sqrt(2 ^ lg_k), 0.8 percent as it is."""
    return state.select("sample", F.hll_sketch_estimate("hll").alias("sequences"))
