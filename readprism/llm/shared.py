"""Session helpers shared by the training-data operators.

Intermediate tables are cut from their lineage by writing Parquet to the folder
that the session names in ``spark.checkpoint.dir``. Every executor and the
driver can read that folder, so a lost executor loses no intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Return the folder all executors share.

    ``spark.checkpoint.dir`` decides. Only a local session without that setting
    (tests, notebooks) falls back to a fresh temporary folder; on a cluster the
    setting is required, since a machine-local folder would not be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="readprism-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    """Return a new path below the shared folder."""
    return f"{shared_dir(spark)}/readprism/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from it."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(key: Column) -> Column:
    """An expression as good as ``key`` to join a table of sums by ``key`` with rows that have it.

    Sums are dealt out by ``key`` itself. Joined by that, both sides would be
    dealt out once for good; joined by this, each has an exchange of its own,
    and Spark may split the rows of a very common key over several tasks.
    """
    return key.bitwiseXOR(F.lit(1).cast("long"))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or with as many ``_`` after it as no column has (names differ in more than letter case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator, deleted by ``drop`` when what it returns no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """Like ``materialize``, and remember the table."""
        self.paths.append(scratch_path(self.spark, tag))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def measured(self, df: DataFrame, tag: str, *columns: Column) -> tuple[DataFrame, Row]:
        """Like ``write``; also (n, columns...), with n the number of rows, observed while they are written."""
        seen = Observation(f"{tag}-{uuid.uuid4().hex}")
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n"), *columns), tag)
        return out, Row(**seen.get)

    def drop(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them must be written first."""
    _delete(spark, f"{shared_dir(spark)}/readprism/{spark.sparkContext.applicationId}")
