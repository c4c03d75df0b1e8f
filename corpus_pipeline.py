"""A corpus pipeline of five training-data operators, from raw documents to a mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of ``documents``.

Defined results: documents with a null or empty text, or without words, are
rejected by the classifier, so later stages see none. Null ids and sources are
values of their own. Of rows that repeat in id and text one stays; of near
duplicates the one of the least id (null last), ties by a hash of the text.
Further columns, whatever their names, pass all stages; if documents have a
column ``epochs`` or ``taken``, the mix's own is named with ``_`` after it. Texts
of any length are read whole. Empty documents give an empty mix; without labels
all documents with words are good, and an empty benchmark removes none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readprism.llm import decontaminate, mixture, neardup, ordinal, surrogates
from readprism.llm.shared import Scratch, free_name, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, takes for good and not toxic."""
    return ordinal.select_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, a similarity of 0.8 or more."""
    return neardup.deduplicate(docs, neardup.NearDup(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data under the session's key; ``n_chars`` follows the new text."""
    key = surrogates.checked_key(docs, surrogates.session_key(spark))
    changed = surrogates.pseudonymize(docs, key=key).drop(free_name("entities", docs.columns))
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else changed


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weighted mix of sources takes, with ``epochs`` and ``taken`` words."""
    return mixture.mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: SQL can't express the classifier, the near-duplicate components or the surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's table goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = Scratch(spark)
        docs = written.write(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
