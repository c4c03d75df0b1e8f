"""Many samples in one run: histograms keyed by sample, kept as state that merges.

A run over reads (sample, seq, qual) is one pass for all histograms and one count of
sequences, however many samples there are; a sample is a column like any other,
so a large one is spread over all tasks and small ones share them. The state is
two tables of sums, (sample, kind, a, b, c, cnt) and (sample, seq, cnt). Sums of
parts are sums of the whole: ``merge`` of the states of two sets of reads is the
state of both, and module tables come from the state without the reads.

A null sample is a sample of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readprism.functions import bases as B
from readprism.operators import adapters, composition, quality, sequences
from readprism.operators import tallies as T

BY = ("sample",)
KINDS = (*T.KINDS, "gc", "strong", "n")
#: Samples of which a task keeps counts at a time.
OPEN = 64
#: Kinds of which a module's table is made, for runs of that module alone.
MODULE_KINDS = {
    "basic_stats": ("length", "strong"), "per_base_quality": ("position",), "per_seq_quality": ("quality",), "per_base_content": ("base",), "per_seq_gc": ("gc",), "per_base_n": ("base",),
    "per_seq_n": ("n",), "length_dist": ("length",), "duplication_levels": (), "overrepresented": (), "adapter_by_position": ("adapter", "length"),
}
_TALLIES = "sample string, kind string, a int, b int, c int, cnt long"
_SEQUENCES = "sample string, seq string, cnt long"
_KEYS = ("kind", "a", "b", "c")


@dataclass(frozen=True)
class State:
    """Sums over some reads."""

    tallies: DataFrame
    sequences: DataFrame

    def save(self, path: str) -> None:
        """Write both tables below ``path``, which must be new."""
        self.tallies.write.parquet(f"{path}/tallies")
        self.sequences.write.parquet(f"{path}/sequences")


def load(spark: SparkSession, path: str) -> State:
    return State(spark.read.schema(_TALLIES).parquet(f"{path}/tallies"), spark.read.schema(_SEQUENCES).parquet(f"{path}/sequences"))


def _folded(batches: Iterator[pa.RecordBatch], offset: int, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, T.Folder] = {}

    def named(sample: str | None, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([sample] * len(r), pa.string()), *r.columns], ["sample", *r.schema.names])

    for batch in batches:
        column = batch.column("sample")
        for sample in pc.unique(column).to_pylist():
            if sample not in held and len(held) >= OPEN:
                for name in list(held):
                    yield from named(name, held.pop(name).rest())
            own = batch.filter(pc.is_null(column) if sample is None else pc.equal(column, sample))
            yield from named(sample, held.setdefault(sample, T.Folder(offset, kinds)).add(own))
    for name, folder in held.items():
        yield from named(name, folder.rest())


def accumulate(reads: DataFrame, offset: int = 33, kinds: tuple[str, ...] = KINDS) -> State:
    """The state of reads (sample, seq, qual); empty reads don't count."""
    ready = B.nonempty(reads).select(F.col("sample").cast("string").alias("sample"), F.upper("seq").alias("seq"), "qual")
    tallies = ready.select(*BY, *T.columns(kinds)).mapInArrow(lambda batches: _folded(batches, offset, kinds), _TALLIES).groupBy(*BY, *_KEYS).agg(F.sum("cnt").alias("cnt"))
    return State(tallies, ready.groupBy(*BY, "seq").agg(F.count(F.lit(1)).alias("cnt")))


def merge(*states: State) -> State:
    """The state of the reads of all ``states``."""
    tallies = reduce(DataFrame.unionByName, [s.tallies for s in states]).groupBy(*BY, *_KEYS).agg(F.sum("cnt").alias("cnt"))
    counts = reduce(DataFrame.unionByName, [s.sequences for s in states]).groupBy(*BY, "seq").agg(F.sum("cnt").alias("cnt"))
    return State(tallies, counts)


def basic_stats(state: State) -> DataFrame:
    """(sample, total_sequences, total_bases, min_len, max_len, gc_percent)."""
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    bases = F.col("a").cast("long") * F.col("cnt")
    length = F.when(F.col("kind") == "length", F.col("a"))
    sums = state.tallies.where(F.col("kind").isin("length", "strong")).groupBy(*BY).agg(
        of("length", F.col("cnt")).alias("total_sequences"), of("length", bases).alias("total_bases"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), of("strong", bases).alias("gc")
    )
    percent = F.expr("(100 * gc + total_bases div 2) div total_bases").cast("int")
    return sums.select(*BY, "total_sequences", "total_bases", "min_len", "max_len", percent.alias("gc_percent"))


def histogram(state: State, kind: str, name: str) -> DataFrame:
    """(sample, ``name``, cnt) of one kind."""
    return T.of_kind(state.tallies, kind).select(*BY, F.col("a").alias(name), "cnt")


def duplication_levels(state: State) -> DataFrame:
    """(sample, level, reads, relative): all seven levels of each sample."""
    level = F.least("cnt", F.lit(sequences.LEVELS)).cast("int")
    reads = [F.sum(F.when(level == i, F.col("cnt")).otherwise(F.lit(0).cast("long"))) for i in range(1, sequences.LEVELS + 1)]
    sums = state.sequences.groupBy(*BY).agg(F.sum("cnt").alias("total"), F.array(*reads).alias("reads"))
    rows = sums.select(*BY, "total", F.posexplode("reads").alias("level", "reads"))
    return rows.select(*BY, (F.col("level") + 1).alias("level"), "reads", (F.col("reads").cast("double") / F.col("total").cast("double")).alias("relative"))


def overrepresented(state: State, *, least_percent: float = sequences.REPORTED_PERCENT) -> DataFrame:
    """(sample, sequence, cnt, percent, source): of each sample at most a thousand rows for 0.1 percent."""
    totals = state.sequences.groupBy(*BY).agg(F.sum("cnt").alias("total")).withColumnRenamed("sample", "of")
    share = F.col("cnt") * F.lit(100.0) / F.col("total")
    shown = F.substr("seq", F.lit(1), F.lit(B.TRIM))
    found = state.sequences.join(totals, F.col("sample").eqNullSafe(F.col("of"))).where(share >= least_percent)
    return found.select(*BY, shown.alias("sequence"), "cnt", share.alias("percent"), B.likely_source(shown).alias("source"))


def module_tables(state: State) -> dict[str, DataFrame]:
    """Module tables of all samples, lazily, each with the column ``sample`` first."""
    positions = composition.positions_of(state.tallies, BY)
    return {
        "basic_stats": basic_stats(state), "per_base_quality": quality.per_base_quality(positions, BY), "per_seq_quality": histogram(state, "quality", "mean_q"),
        "per_base_content": composition.per_base_content(positions, BY), "per_seq_gc": histogram(state, "gc", "gc"), "per_base_n": composition.per_base_n(positions, BY),
        "per_seq_n": histogram(state, "n", "n_percent"), "length_dist": histogram(state, "length", "length"), "duplication_levels": duplication_levels(state), "overrepresented": overrepresented(state),
        "adapter_by_position": adapters.adapter_by_position(state.tallies, BY),
    }


def module_table(reads: DataFrame, module: str, offset: int = 33) -> DataFrame:
    """One of ``module_tables`` of reads (sample, seq, qual), from a pass that counts and reads only what that module needs."""
    state = accumulate(reads, offset, MODULE_KINDS[module])
    if MODULE_KINDS[module] == ("base",):
        of = {"per_base_content": composition.per_base_content, "per_base_n": composition.per_base_n}[module]
        return of(composition.letters_of(state.tallies, BY), BY)
    return module_tables(state)[module]
