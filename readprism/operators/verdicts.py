"""PASS, WARN or FAIL for each module, from all rows of its result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readprism.operators import quality
from readprism.operators.kmers import FAIL, WARN


def graded(fail: Column, warn: Column) -> Column:
    return F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS")


def above(value: Column, warn: float, fail: float) -> Column:
    """FAIL above ``fail``, WARN above ``warn``; a missing value passes."""
    return graded(value > fail, value > warn)


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole).cast("double") * 100.0)


def _row(module: str, df: DataFrame, status: Column) -> DataFrame:
    return df.select(F.lit(module).alias("module"), status.alias("status"))


def _always(df: DataFrame, modules: list[str]) -> list[DataFrame]:
    rows = df.sparkSession.createDataFrame([(m, "PASS") for m in modules], "module string, status string")
    return [rows]


def short_verdicts(tables: dict[str, DataFrame]) -> DataFrame:
    """(module, status) of a short-read run, from its module tables."""
    content = F.greatest(*[F.abs(F.col(x) - 25.0) for x in "gatc"])
    adapters = F.greatest(*[F.col(f"a{i}") for i in range(5)])
    copies = tables["duplication_levels"].agg(F.sum(F.when(F.col("level") > 1, F.col("reads"))).alias("part"), F.sum("reads").alias("whole"))
    rows = [
        *_always(tables["per_base_quality"], ["basic_stats", "per_seq_gc", "length_dist"]),
        _row("per_base_quality", tables["per_base_quality"].agg(F.min("median").alias("m")), graded(F.col("m") < 20, F.col("m") < 25)),
        _row("per_seq_quality", tables["quality_flags"].select(_percent("low", "reads").alias("v")), above(F.col("v"), 10.0, 20.0)),
        _row("per_base_content", tables["per_base_content"].agg(F.max(content).alias("v")), above(F.col("v"), 10.0, 20.0)),
        _row("per_base_n", tables["per_base_n"].agg(F.max("n_percent").alias("v")), above(F.col("v"), 5.0, 20.0)),
        _row("duplication_levels", copies.select(_percent("part", "whole").alias("v")), above(F.col("v"), 50.0, 80.0)),
        _row("overrepresented", tables["frequent"].agg(F.max("percent").alias("v")), graded(F.col("v") >= 0.1, F.col("v") >= 0.05)),
        _row("adapter_content", tables["adapter_by_position"].agg(F.max(adapters).alias("v")), above(F.col("v"), 5.0, 10.0)),
        _row("kmer_content", tables["kmer_enrichment"].agg(F.max("obs_exp").alias("v")), graded(F.col("v") >= FAIL, F.col("v") >= WARN)),
    ]
    return reduce(DataFrame.unionByName, rows)


def long_verdicts(tables: dict[str, DataFrame]) -> DataFrame:
    """(module, status) of a long-read run, from its module tables."""
    flags = tables["n_flags"].select(_percent("gt20", "reads").alias("a"), _percent("gt10", "reads").alias("b"))
    adapters = F.greatest(*[F.col(f"a{i}") for i in range(5)])
    hist = tables["per_seq_quality"]
    # A histogram of at most 94 rows.
    running = F.sum("cnt").over(Window.orderBy("mean_q").rowsBetween(Window.unboundedPreceding, 0))
    ranked = hist.withColumn("running", running).withColumn("total", F.sum("cnt").over(Window.partitionBy()))
    median = ranked.agg(quality.nearest_rank(0.5, "mean_q", "running", "total").alias("m"))
    rows = [
        *_always(hist, ["basic_stats", "per_seq_gc", "length_dist"]),
        _row("per_seq_quality", median, graded(F.col("m") < 7, F.col("m") < 10)),
        _row("per_seq_n", flags, graded(F.col("a") > 5.0, F.col("b") > 5.0)),
        _row("adapter_content", tables["adapter_any"].select(adapters.alias("v")), above(F.col("v"), 5.0, 10.0)),
    ]
    return reduce(DataFrame.unionByName, rows)
