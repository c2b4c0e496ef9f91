"""Registered queries for scopes, rerank, raw evidence, contexts, bursts of several authors, event folding and maintenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import distill as D
from .operators import evaluate as V
from .operators import events as E
from .operators import graph as G
from .operators import hierarchy as H
from .operators import maintenance as M
from .operators import paging as P
from .operators.bursts import group_bursts, refresh_bursts
from .operators.fusion import merge_raw, rerank
from .operators.scope import ArtifactScope, live, planned_ticket
from .operators.vector import sparse_cosine
from .plans.artifacts import index_records, search_records
from .queries import FIRST, INDEX_TOKENS, MSG, NOW, QUERY_TOKENS, STOP, messages, query, t

# -- scopes ---------------------------------------------------------------------------------------

REC = "rec as (select o_orderkey as artifact_id, 'tpch' as source, lower(o_orderpriority) as source_instance, case o_orderstatus when 'F' then 'meeting' when 'O' then 'message' else 'transcript' end as entity, o_custkey as parent_artifact_id, case when o_orderkey % 7 = 0 then null else o_orderdate end as occurred_at, o_orderkey % 11 = 0 as deleted, o_orderkey % 13 = 0 as redacted from orders)"


def record_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records; every seventh has no time, every eleventh is deleted, every thirteenth redacted."""
    o, day = t(spark, sf, "orders"), F.lit("2024-01-01").cast("timestamp")
    entity = F.when(F.col("o_orderstatus") == "F", "meeting").when(F.col("o_orderstatus") == "O", "message").otherwise("transcript")
    return o.select(
        F.col("o_orderkey").alias("artifact_id"), F.lit("tpch").alias("source"), F.lower("o_orderpriority").alias("source_instance"), entity.alias("entity"), F.col("o_custkey").alias("parent_artifact_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("occurred_at"), F.when(F.col("o_orderkey") % 11 == 0, day).alias("deleted_at"), F.when(F.col("o_orderkey") % 13 == 0, day).alias("redacted_at"),
    )


@query(f"with {REC} select artifact_id from rec where source = 'tpch' and entity in ('message', 'meeting') and not deleted and not redacted and occurred_at >= timestamp '1994-01-01' and occurred_at <= timestamp '1996-06-30'")
def artifact_scope(spark, sf):
    scope = ArtifactScope(source="tpch", entities=("message", "meeting"), date_from=datetime(1994, 1, 1), date_to=datetime(1996, 6, 30))
    return record_rows(spark, sf).where(scope.records()).select("artifact_id")


@query(f"with {REC} select entity, count(*) as records, count(*) filter (where not deleted and not redacted) as live from rec group by entity")
def liveness(spark, sf):
    return record_rows(spark, sf).groupBy("entity").agg(F.count("*").alias("records"), F.count_if(live()).alias("live"))


@query("select l_orderkey from lineitem group by l_orderkey having min(l_shipdate) >= timestamp '1995-01-01' and max(l_shipdate) <= timestamp '1996-01-01'")
def burst_scope(spark, sf):
    runs = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("timestamp").alias("started_at"), F.max("l_shipdate").cast("timestamp").alias("ended_at"))
    return runs.where(ArtifactScope(date_from=datetime(1995, 1, 1), date_to=datetime(1996, 1, 1)).bursts()).select("l_orderkey")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then null else 'ORD-' || o_orderkey end as ticket from orders")
def ticket_planner(spark, sf):
    x = F.when(F.col("o_orderkey") % 3 == 0, F.lit("what is open")).otherwise(F.concat(F.lit("status of ORD-"), "o_orderkey", F.lit(" and ZZ-1")))
    return t(spark, sf, "orders").select("o_orderkey", planned_ticket(x).alias("ticket"))


@query(f"with {REC}, w as (select 3 * c_custkey as artifact_id from customer) select w.artifact_id, rec.entity, rec.artifact_id is not null as found from w left join rec using (artifact_id)")
def point_lookup(spark, sf):
    return P.by_id(record_rows(spark, sf), t(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("artifact_id"))).select("artifact_id", "entity", "found")


# -- text -----------------------------------------------------------------------------------------


@query("select doc_id, trim(regexp_replace(left(text, 400), '\\s+', ' ', 'g')) as line, trim(regexp_replace(lower(strip_accents(left(text, 80))), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents")
def collapse_and_slug(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", T.collapse(F.substring("text", 1, 400)).alias("line"), T.slug(F.substring("text", 1, 80)).alias("slug"))


@query("select s_suppkey, s_name as first_link, case when s_suppkey % 2 = 0 then 2 else 1 end as n from supplier")
def wikilinks_found(spark, sf):
    x = F.concat(F.lit("see [["), "s_name", F.lit("|the supplier]] and [not a link]"), F.when(F.col("s_suppkey") % 2 == 0, " or [[other/note]]").otherwise(""))
    links = T.wikilinks(x)
    return t(spark, sf, "supplier").select("s_suppkey", links[0].alias("first_link"), F.size(links).alias("n"))


@query("""with x as (select doc_id, text, instr(lower(text), 'e') as place, length(text) as n from documents)
select doc_id, case when n <= 300 then text when place = 0 then substr(text, 1, 300) else substr(text, cast(greatest(1, least(place - floor((300 - 1) / 2), n - 300 + 1)) as bigint), 300) end as w from x""")
def text_windows(spark, sf):
    return t(spark, sf, "documents").select("doc_id", P.text_window(F.col("text"), F.lit("E"), 300).alias("w"))


@query("select c_custkey, 'notes/' || strftime(timestamp '2024-03-09', '%Y-%m-%d') || '-' || left(lower(c_mktsegment) || '-customer-' || c_custkey, 60) || '-' || lpad(cast(c_custkey as varchar), 10, '0') || '.md' as path from customer")
def note_paths(spark, sf):
    title = F.concat("c_mktsegment", F.lit("  Customer "), "c_custkey", F.lit("!"))
    return t(spark, sf, "customer").select("c_custkey", D.note_path(F.lit("notes"), title, F.lit("2024-03-09").cast("date"), F.concat(F.lit("art_"), F.lpad("c_custkey", 10, "0"), F.lit("zzz"))).alias("path"))


SYS = "s as (select event_id, case event_type when 'click' then 'upsert' when 'view' then 'upsert' else 'delete' end as op, case event_id % 4 when 0 then null when 1 then 'System' when 2 then 'user' else 'system' end as b, case event_id % 3 when 0 then 'SYSTEM' when 1 then null else 'user' end as a from events)"


@query(f"with {SYS} select op, count(*) as n, count(*) filter (where case when op = 'upsert' then coalesce(lower(a) = 'system', false) and (b is null or lower(b) = 'system') else coalesce(lower(b) = 'system', false) end) as system_only from s group by op")
def system_only_rule(spark, sf):
    e = t(spark, sf, "events")
    i = F.col("event_id")
    before = F.when(i % 4 == 1, "System").when(i % 4 == 2, "user").when(i % 4 == 3, "system")
    after = F.when(i % 3 == 0, "SYSTEM").when(i % 3 == 2, "user")
    op = F.when(F.col("event_type").isin("click", "view"), "upsert").otherwise("delete")
    return e.select(op.alias("op"), D.system_only(before, after, op).alias("x")).groupBy("op").agg(F.count("*").alias("n"), F.count_if("x").alias("system_only"))


# -- rerank and raw evidence ----------------------------------------------------------------------

CASES = """q as (select n_nationkey as query_id, 'which supplier of ' || lower(n_name) || ' is open' as query from nation),
h as (select n_nationkey as query_id, s_suppkey as id, 'sup:' || s_suppkey as memory_id, 'suppliers/' || s_suppkey || '.md' as path, case when s_suppkey % 2 = 0 then n_name || ' supplier' else 'vendor' end as title, case when s_suppkey % 5 = 0 then 'which supplier of ' || lower(n_name) || ' is open?' else 'notes on a vendor of ' || n_name end as text,
  1.0 / (60 + 1 + s_suppkey % 9) + case when s_suppkey % 3 = 0 then 1.0 / 62 else 0 end as rrf, s_suppkey % 3 = 0 as agree, case when s_suppkey % 3 = 0 then (s_suppkey % 10) / 10.0 else 0 end as sem, timestamp '2024-06-30' - to_days(cast(s_suppkey % 400 as int)) as updated, s_suppkey % 4 = 0 as overdue
  from supplier join nation on s_nationkey = n_nationkey)"""


@query(f"""with {CASES}, x as (select h.*, q.query, lower(memory_id || ' ' || path || ' ' || title || ' h ' || text) as s, {QUERY_TOKENS.format('q.query')} as qt, {QUERY_TOKENS.format('title')} as tt from h join q using (query_id)),
y as (select *, list_filter(list_distinct(qt), lambda w: not list_contains({STOP}, w)) as c, {QUERY_TOKENS.format('s')} as st from x),
z as (select *, len(list_intersect(list_distinct(qt), tt)) as overlap, len(list_intersect(c, st)) / len(c) as coverage, contains(s, lower(query)) as phrase from y),
r as (select query_id, id, rrf + case when phrase then 0.08 else 0 end + least(0.06, overlap * 0.015) + case when agree then 0.025 else 0 end + least(0.05, sem * 0.08) + least(0.06, coverage * 0.09) + 0.03 * pow(0.5, (id % 400) / 180.0) - case when overdue then 0.03 else 0 end as score, coverage from z)
select query_id, id, round(score, 6) as score, round(coverage, 6) as coverage from r""")
def rerank_bonuses(spark, sf):
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    k, name, now = F.col("s_suppkey"), F.lower("n_name"), F.lit("2024-06-30").cast("timestamp")
    ask, both = F.concat(F.lit("which supplier of "), name, F.lit(" is open")), k % 3 == 0
    ranks = F.when(both, F.create_map(F.lit("lexical"), F.lit(1), F.lit("semantic"), F.lit(2))).otherwise(F.create_map(F.lit("lexical"), F.lit(1)))
    fused = s.select(
        F.col("n_nationkey").alias("query_id"), k.alias("id"), ask.alias("query"), now.alias("now"), F.concat(F.lit("sup:"), k).alias("memory_id"), F.concat(F.lit("suppliers/"), k, F.lit(".md")).alias("path"),
        F.when(k % 2 == 0, F.concat("n_name", F.lit(" supplier"))).otherwise("vendor").alias("title"), F.lit("h").alias("heading"), F.when(k % 5 == 0, F.concat(ask, F.lit("?"))).otherwise(F.concat(F.lit("notes on a vendor of "), "n_name")).alias("text"),
        (1.0 / (61 + k % 9) + F.when(both, 1.0 / 62).otherwise(0.0)).alias("rrf"), F.lit(1).alias("best_rank"), ranks.alias("ranks"), F.when(both, F.create_map(F.lit("semantic"), k % 10 / 10.0)).otherwise(F.create_map(F.lit("lexical"), F.lit(0.0))).alias("signals"),
        F.date_format(F.expr("timestamp'2024-06-30' - make_dt_interval(cast(s_suppkey % 400 as int))"), "yyyy-MM-dd HH:mm:ss").alias("updated"), F.when(k % 4 == 0, "2024-01-01").otherwise("2030-01-01").alias("review_after"),
    )
    return rerank(fused, 2**31 - 1).select("query_id", "id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query(f"""with o as (select o_custkey % 50 as query_id, o_orderkey as k, case o_orderstatus when 'F' then 'meeting' when 'O' then 'message' else 'transcript' end as entity, o_orderdate as day, row_number() over (partition by o_custkey % 50 order by o_totalprice desc, o_orderkey) as rank, o_totalprice / 600000 as s from orders),
v as (select *, 1.0 / (60 + rank) + least(0.04, s * 0.04) + case when k % 10 = 0 then 0.2 + 0.03 else 0.03 * pow(0.5, greatest(0, (epoch_us(timestamp '{NOW}') - epoch_us(day)) / 86400e6) / case when entity in ('meeting', 'transcript') then 90 else 30 end) end as score from o),
d as (select query_id, 'note' || query_id || '-' || i as id, 'distilled' as evidence, 0.1 / i + 1.0 / (60 + i) as score from (select distinct query_id from o), range(1, 4) r(i)),
a as (select query_id, id, evidence, score, 'n' as title from d union all select query_id, 'u' || lpad(cast(k as varchar), 9, '0'), 'raw', score, 't' from v),
z as (select *, row_number() over (partition by query_id order by round(score, 12) desc, evidence = 'distilled' desc, id) as rank from a qualify rank <= 10)
select query_id, id, evidence, round(score, 6) as score from z""")
def raw_merge(spark, sf):
    o = t(spark, sf, "orders")
    w = W.partitionBy(F.col("o_custkey") % 50).orderBy(F.desc("o_totalprice"), "o_orderkey")
    uri = F.concat(F.lit("u"), F.lpad("o_orderkey", 9, "0"))
    entity = F.when(F.col("o_orderstatus") == "F", "meeting").when(F.col("o_orderstatus") == "O", "message").otherwise("transcript")
    ask = F.lit('"exact words"')
    raw = o.select(
        (F.col("o_custkey") % 50).alias("query_id"), ask.alias("query"), F.lit(NOW).cast("timestamp").alias("now"), F.lit("artifact-fts").alias("producer"), uri.alias("uri"), uri.alias("artifact_id"), F.col("o_orderkey").cast("string").alias("external_id"), entity.alias("entity"), F.lit("t").alias("title"),
        F.when(F.col("o_orderkey") % 10 == 0, "these Exact Words").otherwise("others").alias("text"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"), (F.col("o_totalprice") / 600000).alias("score"), F.row_number().over(w).alias("rank"),
    )
    asked = raw.select("query_id").distinct()
    notes = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).select("query_id", F.concat(F.lit("note"), "query_id", F.lit("-"), "rank").alias("id"), F.lit("n").alias("title"), (0.1 / F.col("rank")).alias("score"), "rank")
    out = merge_raw(notes, asked.withColumn("answered", F.lit(True)), raw, 10)
    return out.select("query_id", "id", "evidence", F.round("score", 6).alias("score"))


@query(f"""with {MSG}, tok as (select artifact_id as id, conv_id, {INDEX_TOKENS.format('role')} as a, {INDEX_TOKENS.format('text')} as x, {INDEX_TOKENS.format('artifact_id')} as e from m),
f as (select id, term, sum(w) as tf from (select id, unnest(a) as term, 1.0 as w from tok union all select id, unnest(x), 5.0 from tok union all select id, unnest(e), 1.0 from tok) group by id, term),
df as (select term, count(*) as n from f group by term), st as (select count(*) as docs, avg(len(a) + len(x) + len(e)) as avglen from tok),
u as (select distinct item_id as query_id, {INDEX_TOKENS.format('w')}[1] as term from (select item_id, unnest({FIRST.format(QUERY_TOKENS.format('text'))}[1:3]) as w from benchmark) where len({INDEX_TOKENS.format('w')}) = 1),
s as (select u.query_id, f.id, sum((case when ln((docs - n + 0.5) / (n + 0.5)) > 0 then ln((docs - n + 0.5) / (n + 0.5)) else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(a) + len(x) + len(e)) / avglen))) as b
  from u join f using (term) join df using (term) join tok on tok.id = f.id, st where conv_id % 2 = 0 group by u.query_id, f.id)
select query_id, id as artifact_id, round(b / (1 + b), 6) as score from s qualify row_number() over (partition by query_id order by round(b / (1 + b), 9) desc, id) <= 5""")
def record_search(spark, sf):
    m = messages(spark, sf)
    none = F.lit(None).cast("timestamp")
    rows = m.select("artifact_id", F.lit("").alias("title"), F.col("role").alias("author_name"), "text", F.col("artifact_id").alias("external_id"), F.lit("chat").alias("source"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("source_instance"), F.lit("message").alias("entity"), "occurred_at", none.alias("deleted_at"), none.alias("redacted_at"))
    # the first three distinct words, as SQL's lists are not ordered by it
    words = F.array_distinct(T.query_tokens(F.col("text")))
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 3), " ").alias("query"))
    found = search_records(index_records(rows), rows, q, ArtifactScope(source_instance="even"), 5)
    return found.select("query_id", "artifact_id", F.round("score", 6).alias("score"))


@query("""with e as (select vec_id as id, embedding as v from embeddings), q as (select id as query_id, v as qv from e where id % 20 = 0)
select query_id, id, round(list_dot_product(list_transform(qv[1:16], lambda x: cast(x as double)), list_transform(v[1:16], lambda x: cast(x as double))), 6) as cosine from q, e""")
def sparse_products(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.expr("transform(slice(embedding, 1, 16), (x, i) -> struct(i as i, cast(x as double) as v))").alias("v"))
    return sparse_cosine(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e).select("query_id", "id", F.round("cosine", 6).alias("cosine"))


# -- graph, contexts ------------------------------------------------------------------------------


def nation_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as notes: each declares the nation of the next key as related, names itself and its region's first nation in its body."""
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    first = t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("rk")).agg(F.min_by("n_name", "n_nationkey").alias("first"))
    n = n.join(first, F.expr("rk = n_regionkey"))
    node = F.concat(F.lit("nation:"), "n_nationkey")
    return n.select(
        node.alias("memory_id"), F.col("n_name").alias("title"), F.concat(F.lit("core/"), "n_nationkey", F.lit(".md")).alias("path"), F.lit("region").alias("scope_kind"), F.col("r_name").alias("scope_id"), F.array().cast("array<string>").alias("identifiers"),
        F.array(F.concat(F.lit("nation:"), F.col("n_nationkey") + 1)).alias("related"), F.concat(F.lit("[["), "n_name", F.lit("]] and [["), "first", F.lit("]]")).alias("body"),
    )


@query("""select 'nation:' || n_nationkey as id, n_name as label, 'core/' || n_nationkey || '.md' as source_file from nation
union all select 'scope:region:' || lower(r_name), r_name, null from region""")
def graph_nodes(spark, sf):
    return G.build_graph(nation_notes(spark, sf))[0]


@query("""with p as (select n_nationkey as a, n_nationkey + 1 as b, 'declared-related' as kind from nation where n_nationkey + 1 in (select n_nationkey from nation)
  union all select n_nationkey, first, 'body-link' from nation join (select n_regionkey as rk, min(n_nationkey) as first from nation group by 1) on rk = n_regionkey where n_nationkey <> first),
s as (select distinct least('nation:' || a, 'nation:' || b) as source, greatest('nation:' || a, 'nation:' || b) as target, kind from p)
select source, target, kind as relation, case kind when 'body-link' then 'high' else 'declared' end as confidence from s where kind = 'declared-related' or not exists (select 1 from s d where d.kind = 'declared-related' and d.source = s.source and d.target = s.target)
union all select 'nation:' || n_nationkey, 'scope:region:' || lower(r_name), 'belongs-to', 'declared' from nation join region on n_regionkey = r_regionkey""")
def graph_edges(spark, sf):
    return G.build_graph(nation_notes(spark, sf))[1]


@query("""select 'a:' || n_nationkey as id from nation union all select 'b:' || s_suppkey from supplier union all select 'b:n' || n_nationkey from nation""")
def graph_merge(spark, sf):
    node = lambda c: c.cast("string").alias("id")
    n, s = t(spark, sf, "nation"), t(spark, sf, "supplier")
    b = s.select(node(F.col("s_suppkey"))).union(n.select(F.concat(F.lit("n"), "n_nationkey")))
    edges = s.select(F.col("s_suppkey").cast("string").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    return G.merge_graphs({"a": (n.select(node(F.col("n_nationkey"))), edges.limit(0)), "b": (b, edges)})[0].select("id")


CTX = """art as (select 'n' || n_nationkey as id, null as parent, case when n_nationkey % 2 = 0 then 'meeting' else 'conversation' end as entity from nation
union all select 'c' || c_custkey, 'n' || c_nationkey, case when c_nationkey % 2 = 0 then 'recording' else 'message' end from customer
union all select 'o' || o_orderkey, 'c' || o_custkey, case when c_nationkey % 2 = 0 then 'transcript' else 'attachment' end from orders join customer on c_custkey = o_custkey
union all select 's' || s_suppkey, null, 'attachment' from supplier),
lk as (select 'n' || s_nationkey as source, 'contains' as relation, 's' || s_suppkey as target from supplier where s_nationkey % 2 = 0 union all select 'n' || n_nationkey, 'related-chat', 'n' || (n_nationkey + 1) from nation where n_nationkey % 2 = 0 and n_nationkey < 24)"""


def world_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nations as meetings (even) and conversations (odd) with what hangs on them, and their links."""
    node = lambda p, c: F.concat(F.lit(p), c)
    n, c, o, s = (t(spark, sf, x) for x in ("nation", "customer", "orders", "supplier"))
    even = lambda k, a, b: F.when(F.col(k) % 2 == 0, a).otherwise(b)
    art = n.select(node("n", "n_nationkey").alias("artifact_id"), F.lit(None).cast("string").alias("parent_artifact_id"), even("n_nationkey", "meeting", "conversation").alias("entity"))
    art = art.union(c.select(node("c", "c_custkey"), node("n", "c_nationkey"), even("c_nationkey", "recording", "message")))
    art = art.union(o.join(c, F.expr("c_custkey = o_custkey")).select(node("o", "o_orderkey"), node("c", "o_custkey"), even("c_nationkey", "transcript", "attachment"))).union(s.select(node("s", "s_suppkey"), F.lit(None), F.lit("attachment")))
    links = s.where("s_nationkey % 2 = 0").select(node("n", "s_nationkey").alias("source"), F.lit("contains").alias("relation"), node("s", "s_suppkey").alias("target"))
    return art, links.union(n.where("n_nationkey % 2 = 0 and n_nationkey < 24").select(node("n", "n_nationkey"), F.lit("related-chat"), node("n", F.col("n_nationkey") + 1)))


MEET = """mt as (select a.id as root, b.id from art a join art b on b.parent = a.id where a.entity = 'meeting' union select a.id, c.id from art a join art b on b.parent = a.id join art c on c.parent = b.id where a.entity = 'meeting'
union select source, target from lk where relation = 'contains' union select lk.source, b.id from lk join art b on b.parent = lk.target where relation = 'related-chat' union select lk.source, c.id from lk join art b on b.parent = lk.target join art c on c.parent = b.id where relation = 'related-chat'),
cv as (select a.id as root, b.id from art a join art b on b.parent = a.id where a.entity = 'conversation' union select a.id, c.id from art a join art b on b.parent = a.id join art c on c.parent = b.id where a.entity = 'conversation')"""


@query(f"with {CTX}, {MEET} select root, id as artifact_id from mt")
def meeting_contexts(spark, sf):
    art, links = world_records(spark, sf)
    return H.meeting_context(art, links, art.where("entity = 'meeting'").select(F.col("artifact_id").alias("root")))


@query(f"with {CTX}, {MEET} select root, count(*) as n from (select * from mt union all select * from cv) group by root")
def context_by_entity(spark, sf):
    art, links = world_records(spark, sf)
    return H.context(art, links, art.where("artifact_id like 'n%'").select(F.col("artifact_id").alias("root"))).groupBy("root").agg(F.count("*").alias("n"))


# -- bursts of several authors --------------------------------------------------------------------


@query(rf"""with recursive {MSG}, o as (select *, row_number() over (partition by conv_id order by occurred_at, artifact_id) as rn, length(role || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g'))) as n from m),
fold(conv_id, rn, tm, who, burst, cnt, chars) as (select conv_id, rn, occurred_at, role, 1, 1, n from o where rn = 1
  union all select conv_id, rn, occurred_at, role, case when brk then burst + 1 else burst end, case when brk then 1 else cnt + 1 end, case when brk then n else chars + 1 + n end
  from (select o.*, f.burst, f.cnt, f.chars, (o.role <> f.who or o.occurred_at - f.tm > interval 15 minutes or f.cnt >= 8 or f.chars + 1 + o.n > 2000) as brk from fold f join o on o.conv_id = f.conv_id and o.rn = f.rn + 1) o)
select conv_id, min(rn) as first, any_value(who) as author, count(*) as n, least(2000, max(chars)) as chars from fold group by conv_id, burst""")
def bursts_by_author(spark, sf):
    m = messages(spark, sf)
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("occurred_at", "artifact_id"))
    none = F.array().cast("array<string>")
    rows = m.select(
        "artifact_id", place.cast("string").alias("artifact_uri"), F.col("conv_id").cast("string").alias("parent_artifact_id"), F.lit("").alias("parent_title"), F.lit("chat").alias("source"), F.lit("d").alias("source_instance"), F.lit("message").alias("entity"), F.lit("").alias("author_id"),
        F.col("role").alias("author_name"), none.alias("participant_names"), none.alias("reactions"), "occurred_at", "text", F.lit("").alias("classification"), F.lit(False).alias("attachment_link"), F.lit(False).alias("deleted"), F.lit(False).alias("redacted"),
    )
    b = group_bursts(rows)
    return b.select(F.col("parent_artifact_id").cast("long").alias("conv_id"), F.col("first_artifact_uri").cast("long").alias("first"), F.col("author_name").alias("author"), F.col("record_count").cast("long").alias("n"), F.length("text").cast("long").alias("chars"))


@query("""with p as (select doc_id, md5(text) as h from documents where doc_id % 10 <> 3), c as (select doc_id, case when doc_id % 7 = 0 then 'x' else md5(text) end as h from documents where doc_id % 10 <> 4)
select state, count(*) as n from (select case when p.doc_id is null then 'added' when c.doc_id is null then 'removed' when p.h = c.h then 'reused' else 'changed' end as state from p full join c on p.doc_id = c.doc_id) group by state""")
def burst_reuse(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("burst_id"), "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    now = d.where("doc_id % 10 <> 4").withColumn("digest", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("digest")))
    return refresh_bursts(d.where("doc_id % 10 <> 3"), now).groupBy("state").agg(F.count("*").alias("n"))


# -- events: redaction, revival, change feed ------------------------------------------------------


@query("""select o_orderkey, o_orderpriority = '1-URGENT' as redacted, o_orderpriority <> '1-URGENT' and (c_acctbal >= -900 or o_orderstatus in ('O', 'P')) as live,
case when o_orderstatus = 'P' and o_orderpriority <> '1-URGENT' then 5 else 1 end as version from orders join customer on c_custkey = o_custkey where c_nationkey < 5""")
def event_fold(spark, sf):
    """Deletion with its cascade, revival by a later sighting of the same event, redaction, and changes after either.

    Five nations' customers as conversations and their orders as messages. Batch 2 deletes indebted
    customers, batch 3 sights open orders again, batch 4 redacts urgent ones, batch 5 changes pending ones.
    """
    c = t(spark, sf, "customer").where("c_nationkey < 5").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("source_instance"), (F.col("c_acctbal") < -900).alias("gone"))
    o = t(spark, sf, "orders").join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")

    def rows(df, batch, sequence, operation, key, parent, payload):
        cols = {
            "batch_seq": F.lit(batch).cast("long"), "batch_id": F.concat(F.lit(f"b{batch}/"), "source_instance"), "source": F.lit("tpch"), "source_instance": F.col("source_instance"), "observed_at": F.expr(f"timestamp'2024-01-01' + interval {batch} day"), "ordinal": F.col(key).cast("int") + (2**30 if parent else 0),
            "record": F.lit("event"), "operation": F.lit(operation), "entity": F.lit("message" if parent else "conversation"), "external_id": F.col(key).cast("string"), "parent_entity": F.lit("conversation" if parent else None), "parent_external_id": F.col(parent).cast("string") if parent else F.lit(None),
            "source_sequence": F.lit(sequence), "payload": payload,
        }
        kinds = dict(x.split(" ") for x in E.EVENT.split(", "))
        return df.select([cols.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])

    text = lambda n: F.to_json(F.struct(F.concat(F.lit(f"v{n} "), "o_orderkey").alias("text")))
    events = [rows(c, 1, 1, "upsert", "c_custkey", None, F.lit("{}")), rows(o, 1, 1, "upsert", "o_orderkey", "o_custkey", text(1)), rows(c.where("gone"), 2, 2, "delete", "c_custkey", None, F.lit(None)), rows(o.where("o_orderstatus = 'O'"), 3, 1, "upsert", "o_orderkey", "o_custkey", text(1))]
    events += [rows(o.where("o_orderpriority = '1-URGENT'"), 4, 4, "redact", "o_orderkey", "o_custkey", F.lit("{}")), rows(o.where("o_orderstatus = 'P'"), 5, 5, "upsert", "o_orderkey", "o_custkey", text(5))]
    whole = events[0]
    for e in events[1:]:
        whole = whole.unionByName(e)
    state, _ = E.apply_events(whole)
    gone = F.col("redacted_at").isNotNull()
    version = F.when(F.get_json_object("payload", "$.text").startswith("v5"), 5).otherwise(1)
    return state.where("entity = 'message'").select(F.col("external_id").cast("long").alias("o_orderkey"), gone.alias("redacted"), (~gone & F.col("deleted_at").isNull()).alias("live"), version.alias("version"))


@query("select distinct coalesce(o_custkey, o_orderkey) as parent from orders join (select distinct l_orderkey from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey")
def change_feed(spark, sf):
    flag = F.when(F.col("l_returnflag") == "R", "accepted").when(F.col("l_returnflag") == "A", "stale").otherwise("unchanged")
    log = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), flag.alias("disposition"))
    state = t(spark, sf, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("parent_artifact_id"))
    return E.dirty_parents(log, state).select(F.col("parent_artifact_id").alias("parent"))


# -- maintenance ----------------------------------------------------------------------------------


@query("select o_custkey, max(o_orderdate) as latest, coalesce(max(case when o_orderstatus = 'F' then o_orderkey end), 0) as version from orders group by o_custkey")
def high_water_marks(spark, sf):
    o = t(spark, sf, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return M.high_water(o, ["o_custkey"], "o_orderdate", "v")


@query("select c_custkey, case when o.n is null then c_acctbal else o.n end as value from customer left join (select o_custkey, cast(count(*) as double) as n from orders group by 1 having count(*) > 10) o on o_custkey = c_custkey union all select -1, 5.0")
def upsert_rows(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("value"))
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("value")).where("value > 10")
    return M.upsert(c, o.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(5.0))), ["c_custkey"])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def removed_rows(spark, sf):
    return M.remove(t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select doc_id from documents where lang is not null and doc_id not in (select doc_id from labels) union all select doc_id from documents where false")
def orphan_rows(spark, sf):
    return M.orphans(t(spark, sf, "documents").where("lang is not null").select("doc_id"), t(spark, sf, "labels"), "doc_id", "doc_id")


@query("""select md5(text) as h, 'd' || lpad(cast(doc_id as varchar), 9, '0') as path, row_number() over (partition by md5(text) order by doc_id % 2 = 1 and doc_id = last desc, doc_id) > 1 as rejected
from documents join (select md5(text) as k, max(doc_id) as last from documents group by 1) on k = md5(text)""")
def known_keys_win(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.concat(F.lit("d"), F.lpad("doc_id", 9, "0")).alias("path"))
    known = d.groupBy("h").agg(F.max("doc_id").alias("doc_id"), F.max("path").alias("path")).where("doc_id % 2 = 1").select("h", "path")
    return M.keep_known(d.drop("doc_id"), known, "h").select("h", "path", "rejected")


# -- evaluation -----------------------------------------------------------------------------------


@query("""with j as (select c_custkey, c_custkey % 9 = 0 as no_answer, c_custkey % 4 <> 0 as answered, case when c_custkey % 5 < 3 then c_custkey % 5 + 1 end as first_hit, c_custkey % 17 = 0 as leak from customer),
p as (select *, (case when no_answer then not answered else answered and first_hit is not null end) and not leak as passed from j)
select count(*) as cases, count(*) filter (where passed) as passed, round(avg(case when not no_answer then case when first_hit <= 1 then 1 else 0 end end), 6) as recall_at_1, round(avg(case when not no_answer then case when first_hit <= 2 then 1 else 0 end end), 6) as recall_at_k,
round(avg(case when not no_answer then coalesce(1.0 / first_hit, 0) end), 6) as mrr, round(avg(case when no_answer then case when answered then 0 else 1 end end), 6) as no_answer_accuracy, round(avg(case when leak then 1 else 0 end), 6) as leakage from p""")
def judged_cases(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("query_id"), F.col("c_custkey").alias("k"))
    cases = c.select("query_id", F.array(F.lit("hit")).alias("expected"), F.array(F.lit("bad")).alias("forbidden"), F.lit(None).cast("string").alias("expected_path"), (F.col("k") % 9 == 0).alias("no_answer"))
    ids = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda r: F.struct(r.alias("rank"), F.when(r == F.col("k") % 5 + 1, "hit").when((r == 3) & (F.col("k") % 17 == 0) & (F.col("k") % 5 != 2), "bad").otherwise(F.concat(F.lit("x"), r.cast("string"))).alias("id")))
    leak = F.when((F.col("k") % 17 == 0) & (F.col("k") % 5 == 2), F.array(F.struct(F.lit(4).alias("rank"), F.lit("bad").alias("id")))).otherwise(F.array().cast("array<struct<rank:int,id:string>>"))
    results = c.select("query_id", F.explode(F.concat(ids, leak)).alias("r")).select("query_id", "r.id", F.lit("p").alias("path"), "r.rank")
    answers = c.select("query_id", (F.col("k") % 4 != 0).alias("answered"))
    s = V.summary(V.judge(cases, results, answers), 2)
    return s.select("cases", "passed", *[F.round(x, 6).alias(x) for x in ("recall_at_1", "recall_at_k", "mrr", "no_answer_accuracy", "leakage")])
