"""FASTQ files that arrive in a folder, as a stream of reads.

Spark's file source finds new files and remembers them in the query's checkpoint,
with its own limits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``); only paths and
lengths are read there. Files become byte ranges, which are dealt out over tasks and
cut by the batch reader, so one large file of a micro-batch is read by many tasks.

A file must appear whole, by a rename, and stay as it is. Files are those with
``.f`` in their names; a file of no bytes has no reads. Gzip that is not block gzip is
one task a file. ``read_idx`` is as in ``sources.fastq``, and ``file`` is the file's URI.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readprism.sources.fastq import COLUMNS, SPLIT_BYTES, FastqDataSource, FastqReader, Range, file_kind, open_file

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _records(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with open_file(row["path"]) as file:
                kind = file_kind(file)
            if kind == "gzip":
                if row["start"]:
                    continue  # the range at the file's start reads it all
                row["stop"] = None
            yield from FastqReader(row["path"], SPLIT_BYTES, columns).read(Range([(row["path"], kind)], row["start"], row["stop"]))


def stream_fastq(spark: SparkSession, folder: str, *, split_bytes: int = SPLIT_BYTES, columns: tuple[str, ...] = COLUMNS, tasks: int | None = None, **options) -> DataFrame:
    """A stream of the reads of all files in ``folder``, present and to come; ``options`` are the file source's.

    ``tasks``: over how many the ranges of a micro-batch are dealt out, or
    ``spark.sql.shuffle.partitions``.
    """
    schema: StructType = FastqDataSource({"columns": ",".join(columns)}).schema()
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.f*").options(**options).load(folder)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(int(split_bytes)).cast("long")))
    ranges = files.where("length > 0").select("path", "length", starts.alias("start")).select("path", "start", F.least(F.col("start") + int(split_bytes), "length").alias("stop"))
    dealt = ranges.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = list(columns)
    return dealt.mapInArrow(lambda batches: _records(batches, names), schema)
