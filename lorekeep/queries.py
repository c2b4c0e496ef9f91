"""Registered queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .functions.identity import artifact_id, artifact_uri
from .functions.secrets import PATTERNS, plain_secret
from .functions.vectors import signs
from .operators import distill as D
from .operators import events as E
from .operators import graph as G
from .operators import hierarchy as H
from .operators import lexical as L
from .operators import maintenance as M
from .operators import paging as P
from .operators import vector as V
from .operators.bursts import simple_bursts
from .operators.evaluate import nearest_rank
from .operators.fusion import answer_gate, freshness, fuse, raw_decay
from .operators.scope import Scope, identity_lookup, mentioned
from .streaming.apply import rates, sessions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-06-30 00:00:00"


def query(sql: str | None = None):
    """Register a query, and its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- text and lexical search ----------------------------------------------------------------------

INDEX_TOKENS = r"regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[\p{{L}}\p{{N}}\p{{Co}}_\-:/#]+')"
QUERY_TOKENS = r"list_filter(list_transform(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9][A-Za-z0-9_.:/#@+-]*'), lambda t: trim(lower(t), '._:/#@+-')), lambda t: t <> '')"
FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"

# a term of the index for each single-term unit of a query
UNITS = f"""
qt as (select item_id as query_id, {QUERY_TOKENS.format('text')} as ts from benchmark),
qd as (select query_id, unnest({FIRST.format('ts')}[1:24]) as unit from qt),
units as (select query_id, {INDEX_TOKENS.format('unit')}[1] as term from qd where len({INDEX_TOKENS.format('unit')}) = 1)"""
ALL_UNITS = UNITS.replace("[1:24]", "")
POSTINGS = f"""
tok as (select doc_id as id, {INDEX_TOKENS.format('text')} as ts from documents),
postings as (select id, unnest(ts) as term from tok),
tf as (select term, id, cast(count(*) as double) as tf from postings group by term, id),
df as (select term, count(*) as n from tf group by term),
st as (select count(*) as docs, avg(len(ts)) as avglen from tok),
lens as (select id, len(ts) as len from tok)"""
SCORED = """
scored as (
  select u.query_id, f.id, sum((case when ln((docs - n + 0.5) / (n + 0.5)) > 0 then ln((docs - n + 0.5) / (n + 0.5)) else 1e-6 end)
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))) as s
  from (select distinct query_id, term from units) u join tf f on f.term = u.term join df d on d.term = u.term join lens l on l.id = f.id, st group by u.query_id, f.id)"""


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def scored(spark: SparkSession, sf: str, most: int | None = T.MOST_TERMS) -> DataFrame:
    index = L.build_index(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", {"text": 1.0}, write=True)
    return L.bm25(index, passages(spark, sf), most=most).withColumn("score", F.round("bm25", 6))


def best(df: DataFrame, k: int) -> DataFrame:
    return L.top(df, [F.desc("score"), F.asc("id")], k)


@query(f"select doc_id, len({INDEX_TOKENS.format('text')}) as n_index, len({QUERY_TOKENS.format('text')}) as n_query from documents")
def tokenize_counts(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.size(T.index_tokens(F.col("text"))).cast("long").alias("n_index"), F.size(T.query_tokens(F.col("text"))).cast("long").alias("n_query"))


@query(f"with {POSTINGS} select term, count(*) as n, cast(sum(tf) as bigint) as occurrences from tf group by term")
def doc_freq(spark, sf):
    p = L.build_index(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", {"text": 1.0}).postings
    return p.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").cast("long").alias("occurrences"))


@query(f"with {UNITS}, {POSTINGS}, {SCORED} select query_id, id, round(s, 6) as score, row_number() over (partition by query_id order by round(s, 6) desc, id) as rank from scored qualify rank <= 5")
def bm25_topk(spark, sf):
    return best(scored(spark, sf), 5).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {UNITS}, {POSTINGS}, {SCORED} select query_id, source, id, round(s, 6) as score from scored s join documents d on d.doc_id = s.id qualify row_number() over (partition by query_id, source order by round(s, 6) desc, id) = 1")
def bm25_best_per_group(spark, sf):
    s = scored(spark, sf).join(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return L.best_per_group(s, "source", [F.desc("score"), F.asc("id")]).select("query_id", "source", "id", "score")


@query(f"with {ALL_UNITS}, {POSTINGS}, {SCORED} select query_id, id, round(greatest(0, round(s, 6)) / (1 + greatest(0, round(s, 6))), 6) as relevance from scored qualify row_number() over (partition by query_id order by round(s, 6) desc, id) <= 10")
def lexical_norm(spark, sf):
    return best(scored(spark, sf, most=None), 10).select("query_id", "id", F.round(L.normalised(F.col("score")), 6).alias("relevance"))


@query(f"""with c as (select conv_id * 1000 + turn as id, role as title, text from conversations),
tok as (select id, {INDEX_TOKENS.format('title')} as tt, {INDEX_TOKENS.format('text')} as ts from c),
f as (select id, term, sum(w) as tf from (select id, unnest(tt) as term, 4.0 as w from tok union all select id, unnest(ts), 1.0 from tok) group by id, term),
df as (select term, count(*) as n from f group by term), st as (select count(*) as docs, avg(len(tt) + len(ts)) as avglen from tok),
q as (select distinct role as query, row_number() over (order by role) as query_id from (select distinct role from conversations))
select query_id, f.id, round((case when ln((docs - n + 0.5) / (n + 0.5)) > 0 then ln((docs - n + 0.5) / (n + 0.5)) else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(tt) + len(ts)) / avglen)), 6) as score
from q join f on f.term = q.query join df on df.term = f.term join tok on tok.id = f.id, st""")
def bm25_weighted_fields(spark, sf):
    c = t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("title"), "text")
    q = c.select(F.col("title").alias("query")).distinct().withColumn("query_id", F.row_number().over(W.orderBy("query")).cast("long"))
    index = L.build_index(c, "id", {"title": 4.0, "text": 1.0})
    return L.bm25(index, q).select("query_id", "id", F.round("bm25", 6).alias("score"))


@query("select item_id, d.doc_id from benchmark b join documents d on contains(lower(d.text), lower(b.text))")
def exact_phrase(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    b = t(spark, sf, "benchmark").select(F.col("item_id").alias("phrase_id"), F.lower("text").alias("phrase"))
    return L.containing(d, b).select(F.col("phrase_id").alias("item_id"), F.col("id").alias("doc_id"))


@query("""select conv_id, turn, trim(regexp_extract_all(x, '"([^"\\r\\n]+)"', 1)[1]) as phrase, len(regexp_extract_all(x, '"([^"\\r\\n]+)"', 1)) as n
from (select conv_id, turn, 'find "' || role || ' ' || conv_id || '" or "' || turn || '" now' as x from conversations)""")
def quoted_phrase(spark, sf):
    x = F.concat(F.lit('find "'), "role", F.lit(" "), "conv_id", F.lit('" or "'), "turn", F.lit('" now'))
    p = T.quoted_phrases(x)
    return t(spark, sf, "conversations").select("conv_id", "turn", p[0].alias("phrase"), F.size(p).cast("long").alias("n"))


@query(f"""with d as (select doc_id, unnest(list_distinct({QUERY_TOKENS.format("string_split(text, chr(10))[1]")})) as w from documents),
b as (select item_id, unnest(list_distinct({QUERY_TOKENS.format('text')})) as w from benchmark)
select item_id, doc_id, count(*) as overlap, cast(round(least(0.06, count(*) * 0.015), 6) as double) as bonus from b join d using (w) group by item_id, doc_id having count(*) >= 2""")
def title_overlap(spark, sf):
    words = lambda df, key, c: df.select(key, F.explode(F.array_distinct(T.query_tokens(c))).alias("w"))
    d = words(t(spark, sf, "documents"), "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)))
    n = words(t(spark, sf, "benchmark"), "item_id", F.col("text")).join(d, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))
    return n.where("overlap >= 2").withColumn("bonus", F.round(F.least(F.lit(0.06), F.col("overlap") * 0.015), 6))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"""with q as (select item_id, list_filter(list_distinct({QUERY_TOKENS.format('text')}), lambda w: not list_contains({STOP}, w)) as c from benchmark),
qw as (select item_id, len(c) as m, unnest(c) as w from q),
d as (select doc_id, unnest(list_distinct({QUERY_TOKENS.format('text')})) as w from documents)
select item_id, doc_id, round(count(*) / any_value(m), 6) as coverage from qw join d using (w) group by item_id, doc_id
qualify row_number() over (partition by item_id order by round(count(*) / any_value(m), 6) desc, doc_id) <= 3""")
def query_coverage(spark, sf):
    q = t(spark, sf, "benchmark").select("item_id", T.content_tokens(F.col("text")).alias("c")).select("item_id", F.size("c").alias("m"), F.explode("c").alias("w"))
    d = t(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(T.query_tokens(F.col("text")))).alias("w"))
    c = q.join(d, "w").groupBy("item_id", "doc_id").agg(F.round(F.count("*") / F.first("m"), 6).alias("coverage"))
    w = W.partitionBy("item_id").orderBy(F.desc("coverage"), "doc_id")
    return c.withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")


# -- scope and identity ---------------------------------------------------------------------------


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes: path source/lang/id.md, title `Note <id>`, project = language."""
    d = t(spark, sf, "documents")
    return d.select(F.concat(F.lit("doc:"), "doc_id").alias("memory_id"), F.col("source").alias("source_id"), F.col("lang").alias("root_scope"), F.lit("active").alias("status"), F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("path"), F.concat(F.lit("Note "), "doc_id").alias("title"), F.col("source").alias("scope_id"), F.array("source").alias("repos"), F.array("lang").alias("projects"), F.array().cast("array<string>").alias("identifiers"))


@query("select 'doc:' || doc_id as memory_id, source || '/' || lang || '/' || doc_id || '.md' as path from documents where lang = 'en' and (lower(source) = 'src3' or contains(lower(source || '/' || lang || '/' || doc_id || '.md'), '/src3/'))")
def scope_filter(spark, sf):
    return notes(spark, sf).where(Scope(root_scope="en", repository="SRC3").predicate()).select("memory_id", "path")


@query("select 'doc:' || doc_id as memory_id from documents where starts_with(lower(source || '/' || lang || '/' || doc_id || '.md'), 'src1/f')")
def path_prefix_ci(spark, sf):
    return notes(spark, sf).where(Scope(path_prefix="SRC1/F").predicate()).select("memory_id")


@query("""with d as (select 'doc:' || doc_id as memory_id, source || '/' || lang || '/' || doc_id || '.md' as path, 'Note ' || doc_id as title from documents),
q as (select doc_id as query_id, case quality when 1 then 'note ' || doc_id else 'doc:' || doc_id end as q from labels)
select query_id, memory_id, path from q join d on memory_id = q or lower(path) = lower(q) or lower(title) = lower(q)
qualify row_number() over (partition by query_id order by case when memory_id = q then 0 when lower(path) = lower(q) then 1 else 2 end, length(path), memory_id) = 1""")
def identity_lookup_(spark, sf):
    q = t(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, F.concat(F.lit("note "), "doc_id")).otherwise(F.concat(F.lit("doc:"), "doc_id")).alias("query"))
    return identity_lookup(q, notes(spark, sf))


@query("""with q as (select r_regionkey as query_id, lower('path between ' || string_agg(n_name, ' and ' order by n_nationkey)) as q from region join nation on n_regionkey = r_regionkey group by r_regionkey),
names as (select 'nation:' || n_nationkey as memory_id, n_name as title, unnest(list_distinct([lower('nation:' || n_nationkey), lower('nations/' || n_name || '.md'), lower(n_name)])) as name from nation),
hits as (select query_id, memory_id, title, min(instr(q, name)) as "at", max(length(name)) as matched from q join names on length(name) >= 4 and contains(q, name) group by 1, 2, 3)
select query_id, memory_id, "at", matched, row_number() over (partition by query_id order by "at", matched desc, title, memory_id) as position from hits""")
def mentioned_docs(spark, sf):
    n = t(spark, sf, "nation")
    q = n.groupBy(F.col("n_regionkey").alias("query_id")).agg(F.concat(F.lit("path between "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), " and ")).alias("query"))
    docs = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("memory_id"), F.concat(F.lit("nations/"), "n_name", F.lit(".md")).alias("path"), F.col("n_name").alias("title"))
    return mentioned(q, docs).select("query_id", "memory_id", F.col("at").cast("long").alias("at"), F.col("matched").cast("long").alias("matched"), F.col("position").cast("long").alias("position"))


BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', 1 + cast((cast('0x' || substr(h, 1 + cast(floor(i / 8) as bigint) * 10, 10) as bigint) // cast(pow(2, 35 - 5 * (i % 8)) as bigint)) % 32 as bigint), 1)), '')"


@query(f"""select c_custkey, 'artifact://customer/art_' || {BASE32} as uri
from (select c_custkey, sha256('tpch' || chr(0) || lower(c_mktsegment) || chr(0) || 'customer' || chr(0) || c_custkey) as h from customer)""")
def artifact_uris(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", artifact_uri(F.lit("customer"), artifact_id(F.lit("tpch"), F.lower("c_mktsegment"), F.lit("customer"), F.col("c_custkey").cast("string"))).alias("uri"))


@query(r"""select o_orderkey, list_transform(regexp_extract_all(x, '(?i)\b((?:[A-Z][A-Z0-9]{1,12}-\d+|PR\s*#?\d+))\b', 1), lambda s: trim(s))[1] as first_id, len(regexp_extract_all(x, '(?i)\b((?:[A-Z][A-Z0-9]{1,12}-\d+|PR\s*#?\d+))\b', 1)) as n
from (select o_orderkey, 'fixed ORD-' || o_orderkey || ' in PR #' || o_custkey || ' (' || lower(o_orderstatus) || ')' as x from orders)""")
def identifiers_found(spark, sf):
    x = F.concat(F.lit("fixed ORD-"), "o_orderkey", F.lit(" in PR #"), "o_custkey", F.lit(" ("), F.lower("o_orderstatus"), F.lit(")"))
    i = T.identifiers(x)
    return t(spark, sf, "orders").select("o_orderkey", i[0].alias("first_id"), F.size(i).cast("long").alias("n"))


# -- vectors --------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, index): every row whose id is divisible by 20 is a query."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v"), e


VEC = "e as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), q as (select id as query_id, v as qv from e where id % 20 = 0)"
COS = "c as (select query_id, id, list_dot_product(qv, v) as s from q, e)"


@query(f"with {VEC}, {COS} select query_id, id, round(s, 6) as cosine, row_number() over (partition by query_id order by s desc, id) as rank from c where s > 0 qualify rank <= 10")
def cosine_topk(spark, sf):
    q, e = vectors(spark, sf)
    return V.exact_search(q, e, 10).select("query_id", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"with {VEC}, {COS} select query_id, id from c where s >= 0.5")
def cosine_threshold(spark, sf):
    q, e = vectors(spark, sf)
    return V.threshold_search(q, e, 0.5).select("query_id", "id")


SIGNS = "[" + ", ".join("[" + ", ".join(str(int(x)) for x in row) + "]" for row in signs(64)) + "]"
BUCKETS = f"""sg as (select unnest(range(0, 64)) as r, unnest({SIGNS}) as row), pr as (select id, cast(floor(r / 8) as int) as band, r % 8 as bit, list_dot_product(v, list_transform(row, lambda x: cast(x as double))) >= 0 as up from e, sg),
bk as (select id, band, cast(sum(case when up then cast(pow(2, bit) as int) else 0 end) as int) as bucket from pr group by id, band)"""
MASKS = "m as (select 0 as mask union all select cast(pow(2, i) as int) from range(0, 8) a(i) union all select cast(pow(2, i) + pow(2, j) as int) from range(0, 8) a(i), range(0, 8) b(j) where i < j)"


@query(f"with {VEC}, {BUCKETS} select id, band, bucket from bk")
def lsh_buckets(spark, sf):
    return V.bucket_table(vectors(spark, sf)[1], 64)


@query(f"with {VEC}, {BUCKETS}, {MASKS} select query_id, count(distinct k.id) as candidates from (select query_id, b.band, xor(b.bucket, mask) as bucket from q join bk b on b.id = query_id, m) p join bk k on k.band = p.band and k.bucket = p.bucket group by query_id")
def lsh_multiprobe(spark, sf):
    q, e = vectors(spark, sf)
    return V.candidate_counts(q, e, 64)


VOTES = f"v as (select query_id, k.id, count(*) as votes from (select query_id, b.band, xor(b.bucket, mask) as bucket from q join bk b on b.id = query_id, m) p join bk k on k.band = p.band and k.bucket = p.bucket group by query_id, k.id), top as (select *, row_number() over (partition by query_id order by votes desc, id) as rank from v qualify rank <= {V.candidate_cap(10)})"


@query(f"with {VEC}, {BUCKETS}, {MASKS}, {VOTES} select query_id, id, votes, rank from top")
def ann_candidates(spark, sf):
    q, e = vectors(spark, sf)
    return V.vote(q, e, 64, V.candidate_cap(10)).select("query_id", "id", "votes", F.col("rank").cast("long").alias("rank"))


@query(f"""with {VEC}, {COS}, {BUCKETS}, {MASKS}, {VOTES}, ex as (select query_id, id from c where s > 0 qualify row_number() over (partition by query_id order by s desc, id) <= 10),
ap as (select c.query_id, c.id from c join top on top.query_id = c.query_id and top.id = c.id where s > 0 qualify row_number() over (partition by c.query_id order by s desc, c.id) <= 10)
select ex.query_id, round(count(ap.id) / count(*), 6) as recall from ex left join ap on ap.query_id = ex.query_id and ap.id = ex.id group by ex.query_id""")
def ann_recall(spark, sf):
    q, e = vectors(spark, sf)
    exact = V.exact_search(q, e, 10).select("query_id", "id")
    found = V.vote(q, e, 64, V.candidate_cap(10)).select("query_id", "id").join(e, "id").join(q.withColumnRenamed("v", "qv"), "query_id").select("query_id", "id", V.dot(F.col("qv"), F.col("v")).alias("cosine"))
    near = L.top(found.where("cosine > 0"), [F.desc("cosine"), F.asc("id")], 10).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query(f"""with {VEC}, {COS}, {BUCKETS}, {MASKS}, vo as (select distinct query_id, k.id from (select query_id, b.band, xor(b.bucket, mask) as bucket from q join bk b on b.id = query_id, m) p join bk k on k.band = p.band and k.bucket = p.bucket),
total as (select count(*) as n from e), few as (select q.query_id from q left join vo on vo.query_id = q.query_id group by q.query_id having count(vo.id) < (select least(n, 20) from total)),
ca as (select c.* from c left join vo on vo.query_id = c.query_id and vo.id = c.id left join few on few.query_id = c.query_id where s > 0 and (vo.id is not null or few.query_id is not null or (select n from total) <= {V.EXACT_BELOW}))
select query_id, id, round(s, 6) as cosine, row_number() over (partition by query_id order by s desc, id) as rank from ca qualify rank <= 10""")
def ann_topk(spark, sf):
    q, e = vectors(spark, sf)
    return V.approximate_search(q, e, V.bucket_table(e, 64), 64, 10).select("query_id", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


# -- fusion ---------------------------------------------------------------------------------------

LEXSEM = """lx as (select lang as query_id, doc_id as id, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents),
sm as (select lang as query_id, doc_id as id, row_number() over (partition by lang order by md5(text), doc_id) as rank from documents),
fu as (select query_id, id, sum(1.0 / (60 + rank)) as rrf, min(rank) as best_rank, count(*) as producers from (select * from lx where rank <= 40 union all select * from sm where rank <= 40) group by query_id, id)"""


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    one = lambda order: L.top(d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars", F.md5(F.col("text").cast("binary")).alias("h")), order, 40).withColumn("score", F.col("n_chars") / 1000)
    return fuse({"lexical": one([F.desc("n_chars"), F.asc("id")]), "semantic": one([F.asc("h"), F.asc("id")])})


@query(f"with {LEXSEM} select query_id, id, round(rrf, 9) as rrf, best_rank from fu")
def rrf_fusion(spark, sf):
    return rankings(spark, sf).select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.col("best_rank").cast("long").alias("best_rank"))


@query(f"with {LEXSEM} select query_id, count(*) as n, count(*) filter (where producers = 2) as agreed from fu group by query_id")
def rrf_agreement(spark, sf):
    return rankings(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.size("ranks") == 2).alias("agreed"))


AGE = f"greatest(0, (epoch_us(timestamp '{NOW}') - epoch_us(o_orderdate)) / 86400e6)"


@query(f"select o_orderkey, round(0.03 * pow(0.5, {AGE} / 180), 9) as freshness from orders")
def freshness_decay(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.round(freshness(F.col("o_orderdate").cast("timestamp"), F.lit(NOW).cast("timestamp")), 9).alias("freshness"))


@query(f"select o_orderkey, entity, round(case when exact then 0.03 else 0.03 * pow(0.5, {AGE} / case when entity in ('meeting', 'transcript') then 90 else 30 end) end, 9) as decay from (select o_orderkey, o_orderdate, case o_orderstatus when 'F' then 'meeting' when 'O' then 'message' else 'transcript' end as entity, o_orderpriority = '1-URGENT' as exact from orders)")
def raw_decay_by_kind(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"), F.when(F.col("o_orderstatus") == "F", "meeting").when(F.col("o_orderstatus") == "O", "message").otherwise("transcript").alias("entity"), (F.col("o_orderpriority") == "1-URGENT").alias("exact"))
    return o.select("o_orderkey", "entity", F.round(raw_decay(F.col("entity"), F.col("d"), F.lit(NOW).cast("timestamp"), F.col("exact")), 9).alias("decay"))


GATE = """r as (select c_nationkey as query_id, c_custkey as id, greatest(0, c_acctbal) / 10000 as sem, (c_custkey % 10) / 10.0 as coverage, c_custkey % 4 as intent, c_acctbal / 100000 as score, c_mktsegment, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer),
n as (select query_id, max(case when rank > 1 then sem end) as nxt from r group by query_id),
g as (select r.*, case when sem > 0 then (sem - coalesce(nxt, 0)) / sem else 0 end as margin from r join n using (query_id) where rank = 1)"""


def gated(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer")
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    sem = F.greatest(F.lit(0.0), F.col("c_acctbal")) / 10000
    ranked = c.select(F.col("c_nationkey").alias("query_id"), F.row_number().over(w).alias("rank"), F.create_map(F.lit("semantic"), sem).alias("signals"), F.when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("lexical"), F.lit(1), F.lit("semantic"), F.lit(1))).otherwise(F.create_map(F.lit("semantic"), F.lit(1))).alias("ranks"), (F.col("c_custkey") % 10 / 10.0).alias("coverage"), (F.col("c_custkey") % 4).alias("intent_overlap"), (F.col("c_acctbal") / 100000).alias("score"), F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("exact phrase"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return answer_gate(ranked)


@query(f"with {GATE} select query_id, (c_mktsegment = 'MACHINERY' or (intent >= 2 and sem >= 0.4) or (margin >= 0.35 and coverage >= 0.2) or (c_mktsegment = 'BUILDING' and score >= 0.045 and coverage >= 0.34)) as answered from g")
def answer_gate_(spark, sf):
    return gated(spark, sf).select("query_id", "answered")


@query(f"with {GATE} select query_id, round(margin, 9) as margin from g")
def semantic_margin(spark, sf):
    return gated(spark, sf).select("query_id", F.round("margin", 9).alias("margin"))


# -- messages: context, paging, bursts ------------------------------------------------------------

AT = "timestamp '2024-01-01' + to_days(cast(conv_id as int)) + to_minutes(cast(turn * 5 + (turn // 3) * 12 as bigint))"
MSG = f"m as (select 'c' || lpad(cast(conv_id as varchar), 6, '0') || '-' || lpad(cast(turn as varchar), 4, '0') as artifact_id, conv_id, turn, role, text, {AT} as occurred_at from conversations)"
KEYSQL = "strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f')"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as messages with times; turns are 5 minutes apart, every third 17."""
    c = t(spark, sf, "conversations")
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(conv_id as int), 0, cast(turn * 5 + (turn div 3) * 12 as int))")
    return c.select(F.concat(F.lit("c"), F.lpad("conv_id", 6, "0"), F.lit("-"), F.lpad("turn", 4, "0")).alias("artifact_id"), "conv_id", "turn", "role", "text", at.alias("occurred_at"))


@query(f"""with {MSG}, pick as (select conv_id, turn from m qualify row_number() over (partition by conv_id order by length(text) desc, turn) = 1)
select p.conv_id, p.turn, left(string_agg(m.text, chr(10) || chr(10) order by m.turn), 5000) as context from pick p join m on m.conv_id = p.conv_id and abs(m.turn - p.turn) <= 1 group by p.conv_id, p.turn""")
def context_window(spark, sf):
    m = messages(spark, sf)
    w = W.partitionBy("conv_id").orderBy("turn")
    near = F.array_compact(F.array(F.when(F.lag("turn").over(w) == F.col("turn") - 1, F.lag("text").over(w)), F.col("text"), F.when(F.lead("turn").over(w) == F.col("turn") + 1, F.lead("text").over(w))))
    longest = W.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    return m.withColumn("context", F.substring(F.array_join(near, "\n\n"), 1, 5000)).withColumn("k", F.row_number().over(longest)).where("k = 1").select("conv_id", "turn", "context")


PAGE_KEY = ("2024-02-10T00:05:00.000000", "c000040-0001")


@query(f"with {MSG} select artifact_id, {KEYSQL} as occurred_key from m where ({KEYSQL}, artifact_id) > {PAGE_KEY} order by 2, 1 limit 20")
def keyset_after(spark, sf):
    return P.after(messages(spark, sf), PAGE_KEY, 20).select("artifact_id", "occurred_key")


@query(f"with {MSG} select artifact_id, {KEYSQL} as occurred_key from m where ({KEYSQL}, artifact_id) < {PAGE_KEY} order by 2 desc, 1 desc limit 20")
def keyset_before(spark, sf):
    return P.before(messages(spark, sf), PAGE_KEY, 20).select("artifact_id", "occurred_key")


@query(f"""with {MSG}, k as (select artifact_id, {KEYSQL} as occurred_key from m)
select *, false as focus from (select * from k where (occurred_key, artifact_id) < {PAGE_KEY} order by 2 desc, 1 desc limit 10) union all select *, true from k where (occurred_key, artifact_id) = {PAGE_KEY}
union all select *, false from (select * from k where (occurred_key, artifact_id) > {PAGE_KEY} order by 2, 1 limit 9)""")
def keyset_around(spark, sf):
    return P.around(messages(spark, sf), PAGE_KEY, 20).select("artifact_id", "occurred_key", "focus")


BURSTS = rf"""{MSG}, o as (select *, row_number() over (partition by conv_id order by occurred_at, artifact_id) as rn, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) as n from m),
fold(conv_id, rn, tm, burst, cnt, chars) as (select conv_id, rn, occurred_at, 1, 1, n from o where rn = 1
  union all select o.conv_id, o.rn, o.occurred_at, case when brk then burst + 1 else burst end, case when brk then 1 else cnt + 1 end, case when brk then n else chars + 1 + n end
  from (select o.*, f.burst, f.cnt, f.chars, (o.occurred_at - f.tm > interval 15 minutes or f.cnt >= 8 or f.chars + 1 + o.n > 2000) as brk from fold f join o on o.conv_id = f.conv_id and o.rn = f.rn + 1) o),
b as (select conv_id, burst, min(rn) as r0, max(rn) as r1, count(*) as n, max(chars) as chars from fold group by conv_id, burst),
bb as (select b.conv_id, f.turn as first, l.turn as last, b.n, b.chars from b join o f on f.conv_id = b.conv_id and f.rn = r0 join o l on l.conv_id = b.conv_id and l.rn = r1)"""


def bursts(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select(F.col("conv_id").alias("parent"), F.lit("one").alias("author"), F.col("occurred_at").alias("at"), F.col("turn").alias("id"), T.collapse(F.col("text")).alias("line"))
    return simple_bursts(m).withColumnRenamed("parent", "conv_id")


@query(f"with recursive {BURSTS} select conv_id, first, last, cast(n as int) as n from bb")
def burst_basic(spark, sf):
    return bursts(spark, sf).select("conv_id", "first", "last", "n")


@query(f"with recursive {BURSTS} select conv_id, first, least(2000, chars) as chars, chars >= 200 as embed from bb")
def burst_embed_flag(spark, sf):
    return bursts(spark, sf).select("conv_id", "first", F.least(F.lit(2000), "chars").cast("long").alias("chars"), (F.col("chars") >= 200).alias("embed"))


@query(f"with recursive {BURSTS} select conv_id, count(*) as bursts, max(n) as most_records, count(*) filter (where n = 8) as full_bursts from bb group by conv_id")
def burst_limits(spark, sf):
    return bursts(spark, sf).groupBy("conv_id").agg(F.count("*").alias("bursts"), F.max("n").cast("long").alias("most_records"), F.count_if(F.col("n") == 8).alias("full_bursts"))


# -- events ---------------------------------------------------------------------------------------


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def event_dedupe(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id").withColumn("k", F.concat_ws("/", "user_id", "event_type"))
    return E.dedupe(e, "k", "event_id").select("user_id", "event_type", "event_id")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_wins(spark, sf):
    return E.latest(t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


DISP = """e as (select event_id, user_id, event_type, cast(floor(value) as bigint) as seq, props from events),
h as (select *, max(seq) over (partition by user_id, event_type order by event_id rows between unbounded preceding and 1 preceding) as high, first_value(props) over (partition by user_id, event_type, seq order by event_id) as fp from e),
d as (select event_id, event_type, case when high is null or seq > high then 'accepted' when seq < high then 'stale' when props = fp then 'unchanged' else 'conflict' end as disposition from h)"""


def disposed(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", F.floor("value").cast("long").alias("seq"), "props")
    return E.dispositions(e, ["user_id", "event_type"], "event_id", "seq", "props")


@query(f"with {DISP} select event_id, disposition from d")
def stale_conflict(spark, sf):
    return disposed(spark, sf).select("event_id", "disposition")


@query(f"with {DISP} select event_type as batch_id, count(*) filter (where disposition = 'accepted') as accepted, count(*) filter (where disposition = 'unchanged') as unchanged, count(*) filter (where disposition = 'stale') as stale, count(*) filter (where disposition = 'conflict') as conflict from d group by event_type")
def disposition_receipt(spark, sf):
    log = disposed(spark, sf).select(F.col("event_type").alias("batch_id"), "disposition", F.lit(False).alias("derived"), F.col("event_id").alias("artifact_id"))
    return E.receipts(log).select("batch_id", "accepted", "unchanged", "stale", "conflict")


@query("""select c_custkey, count(o_orderkey) filter (where o_orderstatus <> 'F') as live, count(o_orderkey) filter (where o_orderstatus = 'F') as tombstones, c_acctbal < -900 as hidden
from customer left join orders on o_custkey = c_custkey group by c_custkey, c_acctbal""")
def event_apply(spark, sf):
    """The exact fold: customers as conversations, orders as messages, an instance a nation.

    A second batch deletes finished orders and, by cascade, all orders of deeply indebted customers.
    """
    c = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("source_instance"), (F.col("c_acctbal") < -900).alias("gone"))
    o = t(spark, sf, "orders").join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    null, text = F.lit(None), lambda x: F.col(x).cast("string")

    def rows(df, batch, operation, entity, key, parent, payload):
        return df.select(
            F.lit(batch).cast("long").alias("batch_seq"), F.concat(F.lit(f"b{batch}/"), "source_instance").alias("batch_id"), F.lit("tpch").alias("source"), "source_instance", F.expr(f"timestamp'2024-01-01' + interval {batch} day").alias("observed_at"),
            F.when(F.lit(entity) == "conversation", F.col(key)).otherwise(F.col(key) + 2**30).cast("int").alias("ordinal"), F.lit("event").alias("record"), F.lit(operation).alias("operation"), F.lit(entity).alias("entity"), text(key).alias("external_id"),
            F.lit("conversation" if parent else None).cast("string").alias("parent_entity"), (text(parent) if parent else null.cast("string")).alias("parent_external_id"), F.lit(batch).cast("long").alias("source_sequence"), null.cast("timestamp").alias("source_updated_at"),
            null.cast("string").alias("source_version"), payload.alias("payload"), null.cast("timestamp").alias("covered_from"), null.cast("timestamp").alias("covered_to"),
        )

    finished = F.to_json(F.struct(F.col("o_orderstatus").alias("text")))
    events = rows(c, 1, "upsert", "conversation", "c_custkey", None, F.lit("{}")).union(rows(o, 1, "upsert", "message", "o_orderkey", "o_custkey", finished))
    events = events.union(rows(o.where("o_orderstatus = 'F'"), 2, "delete", "message", "o_orderkey", "o_custkey", null.cast("string"))).union(rows(c.where("gone"), 3, "delete", "conversation", "c_custkey", None, null.cast("string")))
    state, _ = E.apply_events(events)
    m = state.where("entity = 'message'").select("parent_artifact_id", (F.get_json_object("payload", "$.text") == "F").alias("f"))
    by = m.groupBy("parent_artifact_id").agg(F.count_if(~F.col("f")).alias("live"), F.count_if("f").alias("tombstones"))
    k = state.where("entity = 'conversation'").select("artifact_id", F.col("external_id").cast("long").alias("c_custkey"), F.col("deleted_at").isNotNull().alias("hidden"))
    out = k.join(by, F.expr("artifact_id = parent_artifact_id"), "left")
    return out.select("c_custkey", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("tombstones", F.lit(0)).alias("tombstones"), "hidden")


@query("""select o_orderkey from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1997-01-01' and o_orderstatus <> 'F'""")
def coverage_tombstone(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    children = o.select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"), F.lit("2000-01-01").cast("timestamp").alias("last_observed_at"))
    claims = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("parent"), F.lit("2024-01-01").cast("timestamp").alias("observed_at"), F.lit("1995-01-01").cast("timestamp").alias("covered_from"), F.lit("1997-01-01").cast("timestamp").alias("covered_to"))
    present = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("child"))
    return E.covered(children, present, claims).select(F.col("child").alias("o_orderkey"))


@query("select user_id, min(ts) as started, max(ts) as ended, count(*) as n from (select *, sum(case when gap or gap is null then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 15 minutes as gap from events)) group by user_id, s")
def event_sessions(spark, sf):
    s = sessions(t(spark, sf, "events"), "ts", "user_id")
    return s.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query("select time_bucket(interval 1 hour, ts) as start, count(*) as n from events group by 1")
def event_rates(spark, sf):
    return rates(t(spark, sf, "events"), "ts").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


# -- hierarchy ------------------------------------------------------------------------------------

TREE = """tree as (select 'r' || r_regionkey as node, null as parent, false as dead from region
union all select 'n' || n_nationkey, 'r' || n_regionkey, false from nation union all select 'c' || c_custkey, 'n' || c_nationkey, c_acctbal < 0 from customer union all select 'o' || o_orderkey, 'c' || o_custkey, o_orderstatus = 'P' from orders)"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, customers and orders as one hierarchy; overdrawn customers and pending orders are dead."""
    node = lambda p, c: F.concat(F.lit(p), c)
    r = t(spark, sf, "region").select(node("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("dead"))
    n = t(spark, sf, "nation").select(node("n", "n_nationkey"), node("r", "n_regionkey"), F.lit(False))
    c = t(spark, sf, "customer").select(node("c", "c_custkey"), node("n", "c_nationkey"), F.col("c_acctbal") < 0)
    o = t(spark, sf, "orders").select(node("o", "o_orderkey"), node("c", "o_custkey"), F.col("o_orderstatus") == "P")
    return r.union(n).union(c).union(o)


@query(f"with recursive {TREE}, d(node, depth) as (select node, 1 from tree where parent = 'r1' and not dead union all select t.node, d.depth + 1 from tree t join d on t.parent = d.node where not t.dead) select node, cast(depth as int) as depth from d")
def cascade_delete(spark, sf):
    roots = spark.createDataFrame([("r1",)], "root string")
    return H.cascade(tree(spark, sf), roots).select("node", "depth")


@query(f"with recursive {TREE}, bad(node) as (select node from tree where dead union all select t.node from tree t join bad on t.parent = bad.node) select substr(node, 1, 1) as kind, count(*) as n from tree where node not in (select node from bad) group by 1")
def active_ancestors(spark, sf):
    return H.active(tree(spark, sf)).groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query(f"with recursive {TREE}, c(node, ancestor, distance) as (select node, parent, 1 from tree where parent is not null union all select c.node, t.parent, distance + 1 from c join tree t on t.node = c.ancestor where t.parent is not null) select ancestor, distance, count(*) as n from c group by ancestor, distance")
def descendant_context(spark, sf):
    return H.closure(tree(spark, sf)).groupBy("ancestor", "distance").agg(F.count("*").alias("n"))


@query("""with ctx as (select c_nationkey as root, 'c' || c_custkey as artifact_id from customer union select c_nationkey, 'o' || o_orderkey from orders join customer on c_custkey = o_custkey union select s_nationkey, 's' || s_suppkey from supplier)
select root, count(*) as n from ctx group by root""")
def related_context_union(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), c)
    c = t(spark, sf, "customer").select(key("c", "c_custkey").alias("artifact_id"), key("n", "c_nationkey").alias("parent_artifact_id"), F.lit("message").alias("entity"))
    o = t(spark, sf, "orders").select(key("o", "o_orderkey"), key("c", "o_custkey"), F.lit("attachment"))
    s = t(spark, sf, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit("attachment"))
    roots = t(spark, sf, "nation").select(key("n", "n_nationkey").alias("root"))
    return H.conversation_context(c.union(o).union(s), roots).groupBy(F.expr("cast(substring(root, 2) as int)").alias("root")).agg(F.count("*").alias("n"))


@query(f"with recursive {TREE}, c(node, ancestor, distance) as (select node, node, 0 from tree union all select c.node, t.parent, distance + 1 from c join tree t on t.node = c.ancestor where t.parent is not null) select node, ancestor as root from c qualify row_number() over (partition by node order by distance desc) = 1")
def hierarchy_roots(spark, sf):
    return H.roots(tree(spark, sf))


# -- graph ----------------------------------------------------------------------------------------

EDGES = "ed as (select 'r' || n_regionkey as a, 'n' || n_nationkey as b from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier), bi as (select a, b from ed union select b, a from ed)"


def world(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and suppliers; suppliers in credit are held with high confidence, others low."""
    node = lambda p, c: F.concat(F.lit(p), c)
    n, s, r = t(spark, sf, "nation"), t(spark, sf, "supplier"), t(spark, sf, "region")
    nodes = r.select(node("r", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lower(F.concat(F.lit("regions/"), "r_name")).alias("source_file"))
    nodes = nodes.union(n.select(node("n", "n_nationkey"), "n_name", F.lower(F.concat(F.lit("nations/"), "n_name")))).union(s.select(node("s", "s_suppkey"), "s_name", F.lower(F.concat(F.lit("suppliers/"), "s_name"))))
    edges = n.select(node("r", "n_regionkey").alias("source"), node("n", "n_nationkey").alias("target"), F.lit("holds").alias("relation"), F.lit("declared").alias("confidence"))
    return nodes, edges.union(s.select(node("n", "s_nationkey"), node("s", "s_suppkey"), F.lit("supplies"), F.when(F.col("s_acctbal") >= 0, "high").otherwise("low")))


@query(f"""with recursive {EDGES}, w(start, node, distance) as (select 'r' || r_regionkey, 'r' || r_regionkey, 0 from region union all select w.start, bi.b, w.distance + 1 from w join bi on bi.a = w.node where w.distance < 2),
m as (select start, node, min(distance) as distance from w group by start, node)
select start, node, cast(distance as int) as distance from m where distance > 0 qualify row_number() over (partition by start order by distance, node) <= 6""")
def graph_neighbors(spark, sf):
    starts = t(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))
    return G.neighbours(starts, world(spark, sf)[1], 2, 6).select("start", "node", "distance")


@query(f"""with recursive {EDGES}, w(s, cur, path) as (select 'r' || r_regionkey, 'r' || r_regionkey, ['r' || r_regionkey] from region union all select w.s, bi.b, list_append(w.path, bi.b) from w join bi on bi.a = w.cur where len(w.path) <= 6 and not list_contains(w.path, bi.b))
select s as source, cur as target, array_to_string(path, '>') as path, cast(len(path) - 1 as int) as hops from w where cur like 's%' qualify row_number() over (partition by s, cur order by len(path), path) = 1""")
def graph_shortest_path(spark, sf):
    nodes, edges = world(spark, sf)
    pairs = nodes.where("id like 'r%'").select(F.col("id").alias("source")).join(nodes.where("id like 's%'").select(F.col("id").alias("target")), how="cross")
    return G.shortest_paths(pairs, edges).select("source", "target", F.array_join("path", ">").alias("path"), "hops")


@query("""with nodes as (select 'r' || r_regionkey as id, r_name as label, lower('regions/' || r_name) as f from region union all select 'n' || n_nationkey, n_name, lower('nations/' || n_name) from nation union all select 's' || s_suppkey, s_name, lower('suppliers/' || s_name) from supplier),
ed as (select 'r' || n_regionkey as a, 'n' || n_nationkey as b, 1.0 as w from nation union all select 'n' || s_nationkey, 's' || s_suppkey, case when s_acctbal >= 0 then 0.9 else 0.35 end from supplier),
bi as (select a, b, w from ed union all select b, a, w from ed),
l0 as (select r_regionkey as q, 'r' || r_regionkey as id, cast(4.0 * len(string_split(r_name, ' ')) as double) as s from region),
l1 as (select q, b as id, max(s * w * 0.45) as s from l0 join bi on a = id group by q, b), l2 as (select q, b as id, max(s * w * 0.45) as s from l1 join bi on a = id group by q, b),
al as (select q, id, max(s) as s from (select * from l0 union all select * from l1 union all select * from l2) group by q, id)
select q as query_id, f as path, round(max(s), 9) as score from al join nodes using (id) group by q, f qualify row_number() over (partition by q order by max(s) desc, f) <= 10""")
def graph_weighted_rank(spark, sf):
    nodes, edges = world(spark, sf)
    q = t(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("query"))
    none = spark.createDataFrame([], "query_id int, path string, place int, n int")
    return G.rank(q, none, nodes.withColumn("label", F.when(F.col("id").startswith("r"), F.col("label")).otherwise("")), edges, 10).select("query_id", "path", F.round("score", 9).alias("score"))


HREF = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""


def hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("at", "href"))


@query(f"select page_id, cast(i - 1 as int) as at, href from (select page_id, unnest({HREF}) as href, unnest(range(1, len({HREF}) + 1)) as i from pages)")
def link_extract(spark, sf):
    return hrefs(spark, sf).select("page_id", "at", "href")


@query(f"""with l as (select distinct page_id, unnest({HREF}) as href from pages), k as (select distinct lang as id, lower(lang) as key from documents union select distinct source, lower(source) from documents union select 'role:' || role, lower(role) from (select distinct role from conversations) union select distinct 'topic', lower(unnest(['the', 'and'])) ),
x as (select page_id, href, lower(regexp_replace(regexp_replace(href, '^.*/', ''), '(.)\\.[^.]*$', '\\1')) as key from l)
select page_id, href, min(id) as target, case when count(id) = 0 then 'unresolved' else 'resolved' end as state from x left join k using (key) group by page_id, href""")
def link_resolve(spark, sf):
    links = hrefs(spark, sf).select(F.col("page_id").alias("source_id"), F.col("href").alias("link"), F.lit("body-link").alias("kind")).distinct()
    d, c = t(spark, sf, "documents"), t(spark, sf, "conversations")
    named = lambda v: v.select(F.col("v").alias("memory_id"), F.lower("v").alias("key"))
    keys = named(d.select(F.col("lang").alias("v")).distinct()).union(named(d.select(F.col("source").alias("v")).distinct())).union(c.select(F.concat(F.lit("role:"), "role"), F.lower("role")).distinct()).union(spark.createDataFrame([("topic", "the"), ("topic", "and")], "memory_id string, key string"))
    return G.resolve_links(links, keys).select(F.col("source_id").alias("page_id"), F.col("link").alias("href"), "target", "state")


@query(f"select least(page_host, href) as source, greatest(page_host, href) as target, count(*) as n from (select regexp_extract(url, '://([^/:]+)', 1) as page_host, unnest({HREF}) as href from pages) group by 1, 2")
def edge_dedupe(spark, sf):
    host = F.regexp_extract("url", "://([^/:]+)", 1)
    e = t(spark, sf, "pages").select(host.alias("h"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return e.groupBy(F.least("h", "href").alias("source"), F.greatest("h", "href").alias("target")).agg(F.count("*").alias("n"))


@query("select (select count(*) from region) + (select count(*) from nation) + (select count(*) from supplier) as nodes, cast(0 as bigint) as duplicate_nodes, (select count(*) from nation) + (select count(*) from supplier) as edges, cast(0 as bigint) as self_loops, cast(0 as bigint) as dangling_edges")
def graph_validate(spark, sf):
    return G.graph_health(*world(spark, sf))


# -- maintenance ----------------------------------------------------------------------------------

SECRET = [p.replace("'", "''") for p in PATTERNS]


@query("select doc_id from documents where " + " or ".join(f"regexp_matches(text, '{p}')" for p in SECRET))
def secret_detect(spark, sf):
    return t(spark, sf, "documents").where(plain_secret(F.col("text"))).select("doc_id")


LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
MATCHING = "list_filter({0}, lambda x: regexp_matches(x, '{1}'))"
SPOKEN = D.SPOKEN.replace("'", "''")


@query(f"""with l as (select conv_id, turn, {LINES} as ls from (select conv_id, turn, replace(text, '. ', chr(10)) as text from conversations)),
m as (select *, len({MATCHING.format('ls', D.TIMED)}) as timed, len({MATCHING.format('ls', SPOKEN)}) as spoken, {MATCHING.format('ls', D.QUOTED)} as quoted from l)
select conv_id, turn, timed >= 12 or (spoken >= 4 and spoken >= 0.3 * len(ls)) or len(quoted) > 12 or length(array_to_string(quoted, '')) > 2400 as transcript from m""")
def transcript_detect(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select("conv_id", "turn", D.is_transcript(F.replace("text", F.lit(". "), F.lit("\n"))).alias("transcript"))


@query("select sha256(text) as hash, min(doc_id) as first_doc, count(*) as copies from documents group by 1")
def content_hash_dedupe(spark, sf):
    return t(spark, sf, "documents").groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""with p as (select 'd' || doc_id as path, sha256(text) as h from documents where doc_id in (select doc_id from labels) union all select 'b' || item_id, sha256(text) from benchmark),
c as (select 'd' || doc_id as path, sha256(replace(text, chr(10), ' ')) as h from documents)
select coalesce(p.path, c.path) as path, case when p.path is null then 'added' when c.path is null then 'removed' when p.h = c.h then 'unchanged' else 'changed' end as state from p full join c on c.path = p.path""")
def incremental_diff(spark, sf):
    d, b = t(spark, sf, "documents"), t(spark, sf, "benchmark")
    row = lambda df, k, i, text, m: df.select(F.concat(F.lit(k), i).alias("path"), F.lit(m).alias("mtime"), T.content_hash(text).alias("hash"))
    old = row(d.join(t(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), "d", "doc_id", F.col("text"), 1).union(row(b, "b", "item_id", F.col("text"), 1))
    return M.diff(old, row(d, "d", "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")), 2))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf):
    return M.duplicates(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey as artifact_id, o_orderdate as occurred_at from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 200")
def pending_queue(spark, sf):
    o = t(spark, sf, "orders")
    queue = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("artifact_id"), F.lit("pending").alias("status"))
    rows = o.select(F.col("o_orderkey").alias("artifact_id"), F.col("o_orderdate").alias("occurred_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("timestamp").alias("redacted_at"))
    return M.pending(queue, rows, 200).select("artifact_id", "occurred_at")


@query("select conv_id, sha256(string_agg(role || chr(31) || text, chr(30) order by lpad(cast(turn as varchar), 6, '0'))) as digest, count(*) as records from conversations group by conv_id")
def source_digest(spark, sf):
    c = t(spark, sf, "conversations").withColumn("o", F.lpad("turn", 6, "0"))
    return M.source_digest(c, "conv_id", ["role", "text"], ["o"])


@query("select c_custkey as id, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1")
def verify_counts(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    got = M.verify(c.select(F.col("c_custkey").alias("id"), F.lit(0).alias("n")), o.select(F.col("o_custkey").alias("id")), ["id"])
    return got.select("id", F.col("found").alias("n"))


# -- evaluation -----------------------------------------------------------------------------------


@query(f"""with {UNITS}, {POSTINGS}, {SCORED}, r as (select query_id, id, row_number() over (partition by query_id order by round(s, 6) desc, id) as rank from scored qualify rank <= 5),
x as (select item_id as query_id, d.doc_id as id from benchmark b join documents d on contains(d.text, b.text)),
h as (select c.query_id, min(r.rank) as hit from (select distinct query_id from x) c left join (select r.* from r join x on x.query_id = r.query_id and x.id = r.id) r on r.query_id = c.query_id group by c.query_id)
select count(*) as cases, round(avg(case when hit = 1 then 1 else 0 end), 6) as recall_at_1, round(avg(case when hit is not null then 1 else 0 end), 6) as recall_at_5, round(avg(coalesce(1.0 / hit, 0)), 6) as mrr from h""")
def eval_recall_mrr(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text")
    want = L.containing(d.withColumnRenamed("doc_id", "id"), t(spark, sf, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))).select(F.col("phrase_id").alias("query_id"), "id")
    got = best(scored(spark, sf), 5).select("query_id", "id", "rank").join(want, ["query_id", "id"])
    hit = want.select("query_id").distinct().join(got, "query_id", "left").groupBy("query_id").agg(F.min("rank").alias("hit"))
    share = lambda c: F.round(F.avg(F.when(c, 1).otherwise(0)), 6)
    return hit.agg(F.count("*").alias("cases"), share(F.col("hit") == 1).alias("recall_at_1"), share(F.col("hit").isNotNull()).alias("recall_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))), 6).alias("mrr"))


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, round(avg(value), 6) as mean from events group by event_type")
def eval_percentiles(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(nearest_rank("value", 0.5).alias("p50"), nearest_rank("value", 0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"with {UNITS}, {POSTINGS}, {SCORED}, r as (select query_id, id from scored qualify row_number() over (partition by query_id order by round(s, 6) desc, id) <= 5) select query_id, round(count(distinct source) / count(*), 6) as diversity from r join documents d on d.doc_id = r.id group by query_id")
def doc_diversity(spark, sf):
    top_ = best(scored(spark, sf), 5).select("query_id", "id").join(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return top_.groupBy("query_id").agg(F.round(F.count_distinct("source") / F.count("*"), 6).alias("diversity"))


from . import queries_evidence, queries_index, queries_changes  # noqa: E402, F401, I001  they register their queries here
