"""Read relations derived from the driver's tables: the same SQL in Spark and DuckDB.

DuckDB's long reads have qualities for 256,000 letters at most; Spark's have one for each letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _letters(key: str, alphabet: str) -> str:
    return f"translate(md5(cast({key} as varchar(20))),'0123456789abcdef','{alphabet}')"


_PLAIN, _WITH_N, _MIXED, _QUALITY = "ACGTACGTACGTACGT", "ACGTACGTACGTACGN", "ACGTACGTacgtACGN", "#(-27:<=?ABCDEFI"

#: Short reads from ``lineitem``: homopolymers, a common 5' word, adapters at known places, duplicates, mixed case and N.
SHORT = f"""
select rid, seq, substr(q, 1, length(seq)) as qual from (
  select concat('r', cast(l_orderkey as varchar(20)), '_', cast(l_linenumber as varchar(20))) as rid,
    case when l_partkey % 97 = 0 then repeat('A', 36)
         when l_partkey % 89 = 0 then repeat('t', 30)
         when l_linenumber = 1 then concat('GATTACA', {_letters('l_partkey % 300', _PLAIN)}, {_letters('l_partkey % 300 + 7', _PLAIN)})
         when l_linenumber = 2 then concat(substr({_letters('l_orderkey', _PLAIN)}, 1, 4 + cast(l_orderkey % 28 as int)), 'AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC', substr({_letters('l_suppkey', _PLAIN)}, 1, 8))
         when l_linenumber = 3 then concat('CTGTCTCTTATACACATCT', {_letters('l_suppkey % 10', _MIXED)})
         when l_linenumber = 4 then {_letters('l_partkey', _WITH_N)}
         else substr(concat({_letters('l_orderkey', _WITH_N)}, {_letters('l_partkey', _MIXED)}), 1, 14 + cast(l_quantity as int)) end as seq,
    concat({_letters('l_orderkey', _QUALITY)}, {_letters('l_partkey', _QUALITY)}, {_letters('l_suppkey', _QUALITY)}, repeat('#', 32)) as q
  from lineitem) t"""


#: The short reads with a sample each, their line's flag and status.
SAMPLED = SHORT.replace("select rid, seq,", "select sample, rid, seq,").replace("select concat('r'", "select concat(l_returnflag, l_linestatus) as sample, concat('r'")


def _long(flag: str, times: str) -> str:
    return f"""
select rid, seq, substr(q, 1, length(seq)) as qual from (
  select concat('d', cast(doc_id as varchar(20))) as rid, upper(regexp_replace(text, '[^ACGTNacgtn]', ''{flag})) as seq,
    repeat({_letters('doc_id', _QUALITY)}, {times}) as q
  from documents) t where length(seq) > 0"""


#: Long reads from ``documents``: the letters of each text that are bases.
LONG = _long("", "cast(ceil(length(seq) / 32) as int)")
LONG_DUCKDB = _long(", 'g'", "8000")


def short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, seq, qual); only the four columns of ``lineitem`` that it needs are scanned."""
    return spark.sql(SHORT.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def sampled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, rid, seq, qual)."""
    return spark.sql(SAMPLED.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LONG.replace("from documents", "from {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
