"""Quality by position and by read, and the detection of the quality offset."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readprism.functions import bases as B
from readprism.operators import tallies as T

SNIFFED_READS = 50_000
QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "p10": 0.1, "p90": 0.9}


def nearest_rank(share: float, value: str, running: str, total: str) -> Column:
    """The least value whose running count reaches ``ceil(share * total)``, as an aggregate over histogram rows."""
    return F.min(F.when(F.col(running) >= F.greatest(F.ceil(F.lit(share) * F.col(total)), F.lit(1)), F.col(value)))


def per_base_quality(positions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(base, mean, median, q25, q75, p10, p90) from position counts.

    Quantiles come from the histogram of each position (at most 94 rows), not
    from the bases themselves.
    """
    hist = positions.groupBy(*by, "base", "q").agg(F.sum("cnt").alias("cnt"))
    here = Window.partitionBy(*by, "base")
    ranked = hist.withColumn("running", F.sum("cnt").over(here.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("cnt").over(here))
    mean = F.sum(F.col("q") * F.col("cnt")).cast("double") / F.sum("cnt").cast("double")
    return ranked.groupBy(*by, "base").agg(mean.alias("mean"), *[nearest_rank(s, "q", "running", "total").cast("int").alias(name) for name, s in QUANTILES.items()])


def mean_quality_counts(reads: DataFrame, offset: int) -> DataFrame:
    return T.tallies(reads, offset, ["quality"])


def per_seq_quality(table: DataFrame) -> DataFrame:
    """(mean_q, cnt): reads by rounded mean quality, from tallies."""
    return T.of_kind(table, "quality").select(F.col("a").alias("mean_q"), "cnt")


def quality_flags(table: DataFrame) -> DataFrame:
    """One row: reads, and those of a mean quality below 20, from tallies."""
    zero = F.lit(0).cast("long")
    low = F.sum(F.when(F.col("mean_q") < B.LOW_QUALITY, F.col("cnt")).otherwise(zero))
    return per_seq_quality(table).agg(F.coalesce(F.sum("cnt"), zero).alias("reads"), F.coalesce(low, zero).alias("low"))


def _span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest quality byte of one task's reads, if there is any."""
    lo, hi = 256, -1
    for batch in batches:
        data, _ = T.text_bytes(batch.column("qual"))
        if len(data):
            lo, hi = min(lo, int(data.min())), max(hi, int(data.max()))
    if hi >= 0:
        yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([hi], pa.int32())], ["lo", "hi"])


def phred_offset(reads: DataFrame) -> DataFrame:
    """One row: least and greatest quality byte, the offset they tell, and its encoding.

    With ``read_idx`` only the first 50,000 reads count, otherwise all do. Of a
    file, ``read_fastq(..., records=SNIFFED_READS)`` reads no more than those.
    """
    if "read_idx" in reads.columns:
        reads = reads.orderBy("read_idx").limit(SNIFFED_READS)
    span = reads.select("qual").mapInArrow(_span, "lo int, hi int").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    offset = F.when(F.col("lo") < 59, 33).when(F.col("lo") >= 64, 64).when(F.col("hi") <= 74, 33).otherwise(64)
    known = span.withColumn("offset", F.when(F.col("lo").isNotNull(), offset))
    return known.withColumn("encoding", F.when(F.col("offset") == 64, "Illumina 1.5").when(F.col("offset") == 33, "Sanger / Illumina 1.9"))
