"""Queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readprism.llm import archive, bpe_automaton, collocations, decontaminate, main_text, mixture, neardup, ordinal, prefix_trie, rp_forest, substring_dedup, surrogates, url_filter
from readprism.llm.shared import table

OP1_SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as payload_digest, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
m as (select *, max(page_id) over (partition by payload_digest) as top from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from m"""

OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
n as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as shingles from w),
s as (select doc_id, len(shingles) as size, unnest(shingles) as shingle from n),
p as (
  select a.doc_id as u, b.doc_id as v from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by 1, 2 having 100 * count(*) >= 85 * (any_value(a.size) + any_value(b.size) - count(*))),
e as (select u, v from p union all select v, u from p),
c as (select doc_id, doc_id as root from n union select e.v, c.root from c join e on e.u = c.doc_id where c.root < e.v)
select n.doc_id, cast(len(any_value(shingles)) as bigint) as n_shingles, min(root) as component_id, n.doc_id = min(root) as kept
from n join c on n.doc_id = c.doc_id group by n.doc_id"""

OP8_SQL = r"""
with n as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (
  select doc_id, unnest(range(1, len(w) - 11)) as spot, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as key from n),
f as (select key, min(doc_id) as least from k group by key),
r as (select k.doc_id, k.spot from k join f on k.key = f.key where f.least < k.doc_id),
g as (select distinct doc_id, spot + j as pos from r, range(0, 13) as t(j)),
u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from n)
select n.doc_id, count(u.pos) as n_words, count(g.pos) as n_removed, sha256(coalesce(string_agg(u.word, ' ' order by u.pos) filter (where g.pos is null), '')) as kept_sha256
from n left join u on n.doc_id = u.doc_id left join g on u.doc_id = g.doc_id and u.pos = g.pos group by n.doc_id"""

OP11_SQL = r"""
with o as (
  select conv_id, turn, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) as dg, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as w
  from conversations where conv_id is not null),
c as (select conv_id, list({dg: dg, w: w} order by turn nulls first, dg) as t from o group by conv_id),
b as (
  select conv_id, list_concat([4294967295::bigint], flatten(list_transform(range(1, length(conv_id::varchar) + 1),
         lambda i: list_transform(range(0, 8), lambda j: (ascii(substr(conv_id::varchar, i::int, 1)) >> j::int) & 1)))::bigint[]) as bits from c),
h as (select conv_id, xor(list_reduce(bits, lambda x, y: xor(x >> 1, ((xor(x, y) & 1) * 3988292384::bigint))), 4294967295::bigint) % 4 as h from b),
r as (
  select c.conv_id, list_concat(coalesce(a.t[1:h.h], []), c.t[h.h + 1:]) as t
  from c join h using (conv_id) left join c a on a.conv_id = c.conv_id - c.conv_id % 20),
d as (select conv_id, t, len(t) as n, unnest(range(0, len(t) + 1)) as depth from r),
p as (select conv_id, n, depth, md5(array_to_string(list_transform(t[1:depth], lambda x: x.dg), ',')) as pre, case when depth = 0 then 0 else t[depth].w end as w from d),
m as (
  select depth, pre, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256 from p group by depth, pre),
u as (
  select m.*, q.conv_id as parent_conv_id, q.pre as parent_pre
  from m left join p on p.conv_id = m.conv_id and p.depth = m.depth - 1 left join m q on q.depth = p.depth and q.pre = p.pre),
k as (select depth - 1 as depth, parent_pre as pre, count(*) as n_children from u where depth > 0 group by all),
v as (select u.*, coalesce(k.n_children, 0) as n_children from u left join k using (depth, pre)),
s as (
  select p.depth, p.pre, sum((v.n_convs - 1) * v.w) as saved_tokens, count(*) filter (where v.n_children = 0) as n_leaves
  from v join p on p.conv_id = v.conv_id and p.depth <= v.depth group by p.depth, p.pre)
select v.conv_id, cast(v.depth as bigint) as depth, v.parent_conv_id, v.n_convs, v.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, v.ends_sha256
from v join s using (depth, pre)"""

OP13_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
t as (select lang, sum(len(w)) as n from w group by lang),
g as (select lang, w, unnest(range(1, 6)) as m from w),
h as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase from g where len(w) >= m),
f as (select lang, m, phrase, count(*) as a from h group by all having count(*) >= 100),
c as (select lang, m, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m > 1),
s as (
  select c.lang, c.phrase, c.m, c.a, c.k, x.a as l, y.a as r, t.n, 1000 * c.a::hugeint * t.n::hugeint // (x.a::hugeint * y.a::hugeint) as score
  from c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ') join t on t.lang = c.lang),
b as (select *, row_number() over (partition by lang, phrase order by score, k) as low from s),
d as (select b.* from b where low = 1 and not exists (
  select 1 from f o where o.lang = b.lang and o.m > b.m and 100 * o.a >= 100 * b.a and contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from d)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from r where rank <= 2000"""

#: The folder of the public tokenizers' files; ``spark.readprism.tokenizers`` names another.
TOKENIZERS = "/opt/tokenizers"

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.readprism.tokenizers', TOKENIZERS)}/{name}"


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), "url", F.col("html").alias("payload"))
    return archive.archive_round_trip(pages).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.score(docs, model, "doc_id").withColumn("kept", F.col("tail") >= ordinal.THRESHOLD)


def op3_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearDup(shingle=3, percent=85, bands=16))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rp_forest.nearest(vectors, F.col("vec_id") % 20 == 0)


def op8_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = surrogates.pseudonymize(docs, key=surrogates.checked_key(docs, surrogates.session_key(spark)))
    return changed.select("doc_id", F.size("entities").alias("n_entities"), "entities", "text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = bpe_automaton.load(tokenizer_path(spark, "byte_bpe_50k.json"))
    encoded = bpe_automaton.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), automaton, decoded=True)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_arc_to_warc": op1_arc_to_warc,
        "op2_ordinal_quality": op2_ordinal_quality,
        "op3_odd_sketch_neardup": op3_odd_sketch_neardup,
        "op4_spaced_seeds": op4_spaced_seeds,
        "op5_main_text": op5_main_text,
        "op6_url_vocabulary": op6_url_vocabulary,
        "op7_rp_forest": op7_rp_forest,
        "op8_block_anchors": op8_block_anchors,
        "op9_weighted_mix": op9_weighted_mix,
        "op10_surrogates": op10_surrogates,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_bpe_automaton": op12_bpe_automaton,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_arc_to_warc": OP1_SQL,
        "op3_odd_sketch_neardup": OP3_SQL,
        "op8_block_anchors": OP8_SQL,
        "op6_url_vocabulary": url_filter.oracle_sql(),
        "op9_weighted_mix": mixture.oracle_sql(),
        "op11_prefix_trie": OP11_SQL,
        "op13_collocations": OP13_SQL,
    }
