"""Mixing sources to target weights by Efraimidis-Spirakis weighted sampling.

Every source gets a word target: a share of ``budget`` times all words, in
proportion to its weight, but never above ``max_epochs`` times its own words;
what a full source can't take is shared again by weight. A target of ``e`` whole
epochs and a rest takes every document ``e`` times and then a fractional epoch:
documents in the order of their exponential keys ``-ln(u) / quality`` (u is a
keyed hash of the document), as far as the rest of the budget goes. The last
document of a source is cut at the word where its budget ends.

All of it is DataFrame expressions. The order within a source is found without
sorting a source in one task: keys fall into ``bins`` bins, sums by bin give the
bin in which the budget ends, and only that bin's rows are sorted, to find the
document where it ends. Every row is then decided by comparing its key with that
document's.

Defined results: a null text has size 0; documents of size 0 take 0 words; a
null source is a source of its own, ordered last; equal keys are ordered by id
(null first) and hash of the text; rows that repeat in both are separate
documents that are treated alike, so where the budget ends among them each gives
the same number of words. A
null quality counts as 1 and a quality of 0 or less as ``1e-6``. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readprism.llm.shared import free_name, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
BINS = 4096
LABEL_QUALITY = {0: 0.5, 1: 2.0}


def word_count(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*columns: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of the columns: the same in every run and engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in ascending order of source_size / weight fill up first. For the
    source at place k the level is what is left of the budget after all sources
    before it are full, by unit of weight of it and those after it; the first
    source with room below that level, and all after it, get level * weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) * float(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after))
    return level.withColumn("top", F.max("level").over(all_rows)).select("source", "source_size", F.least("cap", F.col("top") * F.col("weight")).alias("target"))


def keyed_sizes(docs: DataFrame, quality: Column, seed: int) -> list[Column]:
    """Columns text_hash, size and key of rows (doc_id, text) with a quality weight."""
    u = _uniform(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))), seed=seed)
    q = F.greatest(F.coalesce(quality.cast("double"), F.lit(1.0)), F.lit(1e-6))
    return [F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"), (-F.log(u) / q).alias("key")]


def sampling_plan(keyed: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, bins: int = BINS) -> DataFrame:
    """One row for each source: source_size, target, epochs, rest, and the document where the rest ends.

    ``cut`` is that document's (key, doc_id, text_hash) and ``part`` the words it
    still gives; rows that repeat in all three are cut alike. ``keyed`` has
    source, size, key, doc_id and text_hash.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    plan = source_targets(keyed, weights=weights, budget=budget, max_epochs=max_epochs).withColumn("epochs", epochs).withColumn("rest", rest)
    # exp(-key) is uniform for quality 1; the bin grows with the key and is finite for every key.
    binned = keyed.withColumn("bin", F.floor((1.0 - F.exp(-F.col("key"))) * bins))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = plan.select(F.col("source").alias("s"), "rest")
    ends = sums.withColumn("before", before).join(wanted, F.col("source").eqNullSafe(F.col("s"))).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") >= F.col("rest")))
    last = ends.select("s", F.col("bin").alias("b"), (F.col("rest") - F.col("before")).alias("room"))
    edge = binned.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    alike = edge.groupBy("source", "key", "doc_id", "text_hash", "room").agg(F.sum("size").alias("sizes"), F.count(F.lit(1)).alias("copies"))
    running = F.coalesce(F.sum("sizes").over(Window.partitionBy("source").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("room") - F.col("running")
    cut = alike.withColumn("running", running).where((room > 0) & (F.col("sizes") >= room)).select(F.col("source").alias("s"), F.struct("key", "doc_id", "text_hash").alias("cut"), F.floor(room / F.col("copies")).cast("long").alias("part"))
    return materialize(plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "sampling-plan")


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target, epochs and taken, by the plan of their source.

    The plan has a row for each source, so Spark broadcasts it; with very many
    sources it is a shuffled join.
    """
    own = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "epochs", "rest", "cut", "part")
    at = F.struct("key", "doc_id", "text_hash")
    part = F.when(F.col("rest") <= 0, 0).when(F.col("cut").isNull() | (at < F.col("cut")), F.col("size")).when(at == F.col("cut"), F.col("part")).otherwise(0)
    # A null id can't be compared within the struct: such rows come first among equal keys.
    part = F.when((F.col("rest") > 0) & F.col("cut").isNotNull() & (F.col("key") != F.col("cut.key")), F.when(F.col("key") < F.col("cut.key"), F.col("size")).otherwise(0)).otherwise(part)
    joined = rows.join(own, rows["source"].eqNullSafe(F.col("plan_source")))
    return joined.withColumn("taken", (F.col("epochs") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long")).drop("plan_source", "rest", "cut", "part")


def mix(docs: DataFrame, *, quality: Column | None = None, labels: DataFrame | None = None, seed: int = 7, **limits) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, epochs, taken) for every document.

    ``quality`` is an expression over ``docs``; ``labels`` (doc_id, quality) may
    give it instead. Texts are read once and never shuffled: sizes and keys are
    taken from them first, and that small table is joined, written to the shared
    folder and used from there. ``limits`` go to ``sampling_plan``.
    """
    if labels is None:
        narrow = docs.select("doc_id", "source", *keyed_sizes(docs, F.lit(1.0) if quality is None else quality, seed))
    else:
        weighed = label_quality(docs.select("doc_id", "source", *keyed_sizes(docs, F.lit(1.0), seed)), labels)
        narrow = weighed.withColumn("key", F.col("key") / F.greatest(F.coalesce("quality", F.lit(1.0)), F.lit(1e-6))).drop("quality")
    keyed = materialize(narrow, "mixture")
    return taken(keyed, sampling_plan(keyed, **limits)).drop("key")


def mixed_documents(docs: DataFrame, *, seed: int = 7, **limits) -> DataFrame:
    """The documents that the mix takes, with their columns, ``epochs`` and ``taken``; quality is ``text_quality``.

    If documents have a column ``epochs`` or ``taken``, it stays and the new one is
    named with ``_`` after it (``shared.free_name``). Two scans of the texts and no shuffle of them: the first makes the plan, the
    second applies it row by row.
    """
    columns = keyed_sizes(docs, text_quality(F.col("text")), seed)
    keyed = materialize(docs.select("doc_id", "source", *columns), "mixture")
    full = docs.select("doc_id", "source", "text", F.struct("*").alias("row"), *columns)
    chosen = taken(full, sampling_plan(keyed, **limits)).where(F.col("taken") > 0)
    return chosen.select("row.*", *[F.col(f"`{name}`").alias(free_name(name, docs.columns)) for name in ("epochs", "taken")])


def label_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add column ``quality``: by the highest label a document has, null without one."""
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("label_quality"))
    value = F.lit(None).cast("double")
    for label, weight in LABEL_QUALITY.items():
        value = F.when(F.col("label_quality") == label, F.lit(weight)).otherwise(value)
    return docs.join(best, F.col("doc_id") == F.col("label_id"), "left").withColumn("quality", value).drop("label_id", "label_quality")


def text_quality(text: Column) -> Column:
    """A quality weight in (0, 1] from the text alone: the share of its characters that are letters or spaces, squared."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return F.when(F.length(text) > 0, F.pow(1.0 - odd / F.length(text), F.lit(2.0))).otherwise(F.lit(None))


def oracle_sql() -> str:
    """The mix of ``documents`` in DuckDB SQL, with plain windows over whole sources."""
    return r"""
with q as (select doc_id, max(quality) as quality from labels group by doc_id),
d as (select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) as size,
        -ln((cast('0x' || substr(md5(concat_ws('|', '7', coalesce(cast(d.doc_id as varchar), 'null'), md5(coalesce(d.text, '')))), 1, 13) as bigint) + 0.5) / 4503599627370496.0)
          / (case when q.quality = 0 then 0.5 when q.quality = 1 then 2.0 else 1.0 end) as key
      from documents d left join q on d.doc_id = q.doc_id),
s0 as (select source, cast(sum(size) as double) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
s1 as (select *, case place % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end as weight, 2.0 * source_size as cap from s0),
s2 as (select *, (sum(source_size) over () * 1.5 - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from s1),
s3 as (select *, max(level) over () as top from s2),
s4 as (select source, source_size, least(cap, top * weight) as target from s3),
s5 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from s4),
s6 as (select *, cast(round(target - epochs * source_size) as bigint) as rest from s5),
k as (select d.*, s6.source_size, s6.target, s6.epochs, s6.rest,
        coalesce(sum(size) over (partition by d.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before
      from d join s6 on d.source is not distinct from s6.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
       cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken
from k"""
