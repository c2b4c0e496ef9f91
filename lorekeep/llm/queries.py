"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import filter_audit
from .bpe import bpe_encode
from .common import new_folder, remainder
from .divergence import source_divergence
from .embeddings import embedding_neardup
from .html import extract_html
from .jaccard import ngram_jaccard
from .language import identify_language
from .lines import line_dedup
from .matroska import media_digest
from .mixing import mix_sources
from .quality import quality_scores
from .rollup import TokenRollup, corpus_counts
from .warc import archive_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup(table(spark, sf_dir, "embeddings"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False, digests=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = TokenRollup(spark, new_folder(spark, "rollup"))
    return corpus_counts(table(spark, sf_dir, "documents"), rollup, public_tokenizers.path("byte_bpe_50k.json"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_embedding_neardup, op2_bpe_roundtrip, op3_line_dedup, op4_media_columns, op5_quality_classifier, op6_token_counts, op7_source_mix, op8_ngram_jaccard, op9_language_id, op10_warc, op11_filter_audit, op12_html_extraction, op13_source_divergence, pipeline)}

#: A-Z only, as the contracts have it.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLE_SQL = {
    "op1_embedding_neardup": """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as u, b.vec_id as v from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on l.u = r.v),
roots as (select u, min(v) as m from reach group by u),
degree as (select u, count(*) as n from links group by u)
select e.vec_id, coalesce(d.n, 0) as n_links, least(e.vec_id, coalesce(r.m, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(r.m, e.vec_id)) as kept
from embeddings e left join degree d on d.u = e.vec_id left join roots r on r.u = e.vec_id
""",
    "op3_line_dedup": f"""
with lines as (
  select doc_id, l.i as i, l.line as line, {LOWER.format(f"trim(l.line, {BLANKS})")} as key
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'i': i, 'line': x}})) as l from documents)),
firsts as (select key, min(doc_id) as first_doc from lines where length(key) >= 10 group by key having count(distinct doc_id) > 1),
marked as (select l.*, (f.key is not null and l.doc_id <> f.first_doc) as gone from lines l left join firsts f on f.key = l.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op8_ngram_jaccard": rf"""
with recursive words as (
  select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from words),
items as (select doc_id, len(g) as n, unnest(g) as t from grams),
pairs as (
  select a.doc_id as u, b.doc_id as v, any_value(a.n) as an, any_value(b.n) as bn, count(*) as m
  from items a join items b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from pairs where 100 * m >= 90 * (an + bn - m)),
both_ways as (select u, v from links union all select v, u from links),
reach(u, v) as (select u, v from both_ways union select r.u, b.v from reach r join both_ways b on b.u = r.v)
select g.doc_id, cast(len(g.g) as bigint) as n_shingles, least(g.doc_id, coalesce(min(r.v), g.doc_id)) as component_id
from grams g left join reach r on r.u = g.doc_id group by g.doc_id, len(g.g)
""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h, min(page_id) over (partition by html) as first_page from p),
bits as (select *, '0x' as pre from d),
digest as (
  select page_id, n, first_page, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((
      (cast('0x' || substr(h, 1 + cast(floor(i / 8) as bigint) * 10, 10) as bigint) // cast(pow(2, 35 - 5 * (i % 8)) as bigint)) % 32) as bigint), 1)), '') as payload_digest from bits)
select page_id, cast(n as bigint) as payload_bytes, payload_digest, case when page_id = first_page then 'response' else 'revisit' end as record_type,
  case when page_id <> first_page then first_page end as refers_to
from digest
""",
    "op11_filter_audit": r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
f as (
  select doc_id, part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b,
    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d, coalesce(min(doc_id) over (partition by text) < doc_id, false) as e from w),
l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
m as (select f.*, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic from f left join l using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from orders),
fails as (select part, good, toxic, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end)
    || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as s from m),
cells as (select part, s, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, s),
each as (
  select part, filter_order, step, substr(filter_order, step, 1) as x, n, good, toxic, s, contains(s, substr(filter_order, step, 1)) as own,
    s <> translate(s, substr(filter_order, 1, step - 1), '') as earlier from cells, steps),
found as (
  select part, filter_order, step, x, coalesce(sum(n) filter (where not own and not earlier), 0) as kept, coalesce(sum(n) filter (where own and not earlier), 0) as removed,
    coalesce(sum(n) filter (where own and earlier), 0) as redundant, coalesce(sum(n) filter (where s = x), 0) as unique_fails,
    coalesce(sum(good) filter (where own and not earlier), 0) as good_lost, coalesce(sum(toxic) filter (where own and not earlier), 0) as toxic_lost
  from each group by part, filter_order, step, x)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, x) as bigint) as shapley
from found
""",
    "op13_source_divergence": rf"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, {LOWER.format("coalesce(text, '')")} as text from documents),
occ as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from occ group by lang, term having count(distinct i) >= 10),
v as (select lang, count(*) as v from kept group by lang),
places as (select distinct lang, source from d),
c as (select o.lang, o.source, o.term, count(*) as n from occ o join kept k on k.lang = o.lang and k.term = o.term group by o.lang, o.source, o.term),
totals as (select lang, source, sum(n) as total from c group by lang, source),
counts as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, coalesce(t.total, 0) as total, v.v from places g join kept k on k.lang = g.lang join v on v.lang = g.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join totals t on t.lang = g.lang and t.source = g.source),
p as (select lang, source, term, n, 1 + (cast(1000000000 as hugeint) * (n + 2)) // (total + 2 * v) as p from counts),
q as (select lang, term, 1 + (cast(1000000000 as hugeint) * (sum(n) + 2)) // (sum(total) + 2 * any_value(v)) as q from counts group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
all_pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value from places a join places b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from all_pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10
""",
}
