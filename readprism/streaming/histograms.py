"""Running histograms and sequence counts over a stream of reads.

Each micro-batch is reduced to the sums of ``operators.samples`` (all kinds of
the one pass over reads, adapters and 7-mers included, and counts of sequences) and
written as a part named by its batch id. A part counts once it is marked as done; a
batch that is run again leaves its part as it is, or writes it anew if it isn't done, so
the sums over all parts count every read once.

Parts are folded: every ``FOLD`` batches into one part, every ``FOLD`` of those into
one again, and so on. After n batches there are at most ``FOLD`` parts for each digit
of n in base ``FOLD``, and a count is rewritten once for each digit. Parts that a fold
has replaced are deleted by the next batch, so who reads the sums meanwhile has until
then.

A state belongs to one query. Its checkpoint is kept inside the state, unless
another place is given; a state with batches that the query has not run yet, or
without those it has run, raises ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readprism.operators import samples

FOLD = 16
_SCHEMA = "sample string, kind string, a int, b int, c int, seq string, cnt long"
_SEQUENCE = "sequence"
_DONE = "_DONE"

Part = tuple[int, int]


def _as_table(state: samples.State) -> DataFrame:
    nothing = F.lit(None)
    tallies = state.tallies.select("sample", "kind", "a", "b", "c", nothing.cast("string").alias("seq"), "cnt")
    counts = state.sequences.select("sample", F.lit(_SEQUENCE).alias("kind"), *[nothing.cast("int").alias(c) for c in "abc"], "seq", "cnt")
    return tallies.unionByName(counts)


def _as_state(table: DataFrame) -> samples.State:
    sequence = F.col("kind") == _SEQUENCE
    return samples.State(table.where(~sequence).drop("seq"), table.where(sequence).select("sample", "seq", "cnt"))


def _path(state_path: str, part: Part) -> str:
    return f"{state_path}/parts/{part[0]}-{part[1]}"


def _at(spark: SparkSession, path: str):
    """(file system, path) of the session's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def parts(spark: SparkSession, state_path: str) -> list[Part]:
    """(first batch, last batch) of all parts that are done, replaced ones too."""
    store, pattern = _at(spark, f"{state_path}/parts/*-*/{_DONE}")
    names = [found.getPath().getParent().getName() for found in store.globStatus(pattern) or []]
    return sorted((int(a), int(b)) for a, b in (name.split("-") for name in names))


def current(done: list[Part]) -> list[Part]:
    """The parts that hold all batches once: of those that begin at a batch, the longest."""
    out: list[Part] = []
    longest = {first: last for first, last in sorted(done)}
    at = 0
    while at in longest:
        out.append((at, longest[at]))
        at = longest[at] + 1
    return out


def _write(state: samples.State, state_path: str, part: Part) -> None:
    table = _as_table(state)
    table.write.mode("overwrite").parquet(_path(state_path, part))
    store, mark = _at(table.sparkSession, f"{_path(state_path, part)}/{_DONE}")
    store.create(mark, True).close()


def _read(spark: SparkSession, state_path: str, wanted: list[Part]) -> samples.State:
    if not wanted:
        return _as_state(spark.createDataFrame([], _SCHEMA))
    return samples.merge(_as_state(spark.read.schema(_SCHEMA).parquet(*[_path(state_path, p) for p in wanted])))


def add_batch(reads: DataFrame, batch_id: int, state_path: str, offset: int = 33) -> None:
    """Add the reads of one micro-batch to the state, once however often it is called."""
    spark = reads.sparkSession
    done = parts(spark, state_path)
    held = current(done)
    last = held[-1][1] if held else -1
    if last not in (batch_id - 1, batch_id):
        raise ValueError(f"{state_path} holds the batches up to {last}, which are not those before batch {batch_id}: it is of another query")
    for part in set(done) - set(held):
        store, target = _at(spark, _path(state_path, part))
        store.delete(target, True)
    if last < batch_id:
        if "sample" not in reads.columns:
            reads = reads.withColumn("sample", F.lit(None).cast("string"))
        _write(samples.accumulate(reads, offset), state_path, (batch_id, batch_id))
        held.append((batch_id, batch_id))
    size = FOLD
    while (batch_id + 1) % size == 0:
        whole = (batch_id + 1 - size, batch_id)
        within = [p for p in held if p[0] >= whole[0]]
        if within != [whole] and within:
            _write(_read(spark, state_path, within), state_path, whole)
            held = [p for p in held if p[0] < whole[0]] + [whole]
        size *= FOLD


def start(stream: DataFrame, state_path: str, checkpoint: str | None = None, *, offset: int = 33, **trigger) -> StreamingQuery:
    """Start a query that keeps the state of all reads of ``stream`` ([sample,] seq, qual) under ``state_path``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, batch_id, state_path, offset)

    place = checkpoint or f"{state_path}/checkpoint"
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", place).trigger(**(trigger or {"availableNow": True})).start()


def merged(spark: SparkSession, state_path: str) -> samples.State:
    """The sums over all batches so far; ``samples.module_tables`` makes the modules' tables of them."""
    return _read(spark, state_path, current(parts(spark, state_path)))
