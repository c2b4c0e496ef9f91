"""Relationship graph: build, link resolution, weighted ranking, neighbours, shortest paths, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import query_tokens, wikilinks
from .lexical import top

# Edge weights by confidence, decay a hop, seed weights.
WEIGHTS = {"declared": 1.0, "high": 0.9, "medium": 0.65, "low": 0.35}
OTHER, DECAY, LABEL, PLACE, MOST_DEPTH = 0.5, 0.45, 4.0, 0.25, 4


def edge_weight(confidence: Column) -> Column:
    c = F.lower(confidence)
    out = F.lit(OTHER)
    for name, w in WEIGHTS.items():
        out = F.when(c == name, w).otherwise(out)
    return out


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def path_key(path: Column, source: str = "core", known: tuple[str, ...] = ()) -> Column:
    """A path with forward slashes, no leading ./ and a source in front."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    has = F.lit(False)
    for s in (source, *known):
        has = has | F.startswith(p, F.lit(f"{s}/"))
    return F.when(has, p).otherwise(F.concat(F.lit(f"{source}/"), p))


def identity_keys(docs: DataFrame) -> DataFrame:
    """(memory_id, key): id, title, path, path without its source, stem, identifiers, in lower case."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    relative = F.regexp_replace(path, "^[^/]*/", "")
    keys = F.concat(F.array("memory_id", "title", path, relative, stem(relative)), F.coalesce("identifiers", F.array().cast("array<string>")))
    return docs.select("memory_id", F.explode(F.array_distinct(F.transform(keys, F.lower))).alias("key")).where("key <> ''")


def link_keys(link: Column) -> Column:
    """Keys of a link in order: target, its stem, its label."""
    inner = F.regexp_replace(F.trim(link), r"^\[\[(.*)\]\]$", "$1")
    target = F.replace(F.trim(F.split_part(inner, F.lit("|"), F.lit(1))), F.lit("\\"), F.lit("/"))
    label = F.trim(F.split_part(inner, F.lit("|"), F.lit(2)))
    return F.filter(F.array_distinct(F.array(F.lower(target), F.lower(stem(target)), F.lower(label))), lambda k: k != "")


def resolve_links(links: DataFrame, keys: DataFrame) -> DataFrame:
    """links (source_id, link, kind) with target and state.

    The first key that one document has decides; otherwise all matches together: none is
    unresolved, one resolved, more ambiguous.
    """
    asked = links.withColumn("__l", F.xxhash64("source_id", "link", "kind"))
    tried = asked.select("__l", F.posexplode(link_keys(F.col("link"))).alias("p", "key")).join(keys, "key", "left")
    # the least and the largest match tell none, one and several apart, so that no list of matches is gathered
    by_key = tried.groupBy("__l", "p").agg(F.min("memory_id").alias("one"), F.max("memory_id").alias("other"))
    found = by_key.groupBy("__l").agg(F.min_by("one", F.when(F.col("one") == F.col("other"), F.col("p"))).alias("first"), F.max("other").alias("any"))
    target = F.col("first")
    state = F.when(target.isNotNull(), "resolved").when(F.col("any").isNull(), "unresolved").otherwise("ambiguous")
    return asked.join(found, "__l", "left").select("source_id", "link", "kind", target.alias("target"), state.alias("state"))


def build_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, resolved links) of notes: memory_id, path, title, body, related, identifiers, scope_kind, scope_id.

    Nodes are documents and scopes. A declared pair is one undirected edge; a link in a body adds
    one only where the pair isn't declared; a document is never linked to itself.
    """
    nodes = docs.select(F.col("memory_id").alias("id"), F.col("title").alias("label"), F.col("path").alias("source_file"))
    scoped = docs.where("scope_id <> ''").withColumn("scope", F.concat(F.lit("scope:"), F.lower("scope_kind"), F.lit(":"), F.lower("scope_id")))
    nodes = nodes.union(scoped.groupBy("scope").agg(F.min("scope_id").alias("label")).select("scope", "label", F.lit(None).cast("string")))
    belongs = scoped.select(F.col("memory_id").alias("source"), F.col("scope").alias("target"), F.lit("belongs-to").alias("relation"), F.lit("declared").alias("confidence"))
    asked = docs.select(F.col("memory_id").alias("source_id"), F.explode("related").alias("link"), F.lit("declared-related").alias("kind"))
    asked = asked.union(docs.select("memory_id", F.explode(F.array_distinct(wikilinks(F.col("body")))), F.lit("body-link")))
    resolved = resolve_links(asked, identity_keys(docs))
    pairs = resolved.where("state = 'resolved' and target <> source_id").select(F.least("source_id", "target").alias("source"), F.greatest("source_id", "target").alias("target"), "kind").distinct()
    declared = pairs.where("kind = 'declared-related'")
    body = pairs.where("kind = 'body-link'").join(declared.select("source", "target"), ["source", "target"], "left_anti")
    related = declared.union(body.select(declared.columns)).select("source", "target", F.col("kind").alias("relation"), F.when(F.col("kind") == "declared-related", "declared").otherwise("high").alias("confidence"))
    return nodes, belongs.union(related), resolved


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *rest))


def allowed_edges(nodes: DataFrame, edges: DataFrame, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes without a file, or with an allowed one (column path), and the edges among them."""
    if allowed is None:
        return nodes, edges
    free = nodes.where("source_file is null").unionByName(nodes.join(allowed.select(F.lower("path").alias("__p")).distinct(), F.lower("source_file") == F.col("__p"), "left_semi"))
    ids = free.select(F.col("id").alias("source"))
    return free, edges.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi").select(edges.columns)


def rank(queries: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int, depth: int = 2, visible: DataFrame | None = None) -> DataFrame:
    """Paths by the strongest walk from a seed: query_id, path, score, rank.

    visible (id, scopes): with it, queries have a column scope, and a query's walk starts at and
    passes only nodes whose scopes hold its own; scopes null means any.

    queries: query_id, query; candidates: query_id, path, place (1 is first), n. A seed has words of
    the query in its label or is a candidate's file; each hop multiplies by the edge's weight and a
    decay. The best score of a node at a hop is all that matters further on, so hops are joins with a
    maximum, and no queue is needed.
    """
    words = F.size(F.array_intersect(F.array_distinct(query_tokens(F.col("query"))), query_tokens(F.col("label"))))
    q = queries.select("query_id", "query", F.explode(F.array_distinct(query_tokens(F.col("query")))).alias("w"))
    n = nodes.select("id", "label", F.explode(F.array_distinct(query_tokens(F.col("label")))).alias("w"))
    by_label = q.join(n, "w").select("query_id", "query", "id", "label").distinct().select("query_id", "id", (words * LABEL).alias("s"))
    by_path = candidates.join(nodes.where("source_file is not null").select("id", F.lower("source_file").alias("f")), F.expr("lower(path) = f")).select("query_id", "id", ((F.col("n") - F.col("place") + 1) * PLACE).alias("s"))
    seeds = by_label.union(by_path).groupBy("query_id", "id").agg(F.sum("s").alias("score")).where("score > 0")
    scope_of = None if visible is None else queries.select("query_id", "scope")
    seen = lambda rows: rows if visible is None else rows.join(visible, "id").join(scope_of, "query_id").where("scopes is null or array_contains(scopes, scope)").select("query_id", "id", "score")
    level = top(seen(seeds), [F.desc("score"), F.desc("id")], 3 * limit).select("query_id", "id", "score")
    hops = both_ways(edges.select("source", "target", edge_weight(F.col("confidence")).alias("w"))).groupBy("source", "target").agg(F.max("w").alias("w"))
    reached = level
    for _ in range(max(0, min(depth, MOST_DEPTH))):
        level = level.join(hops, F.expr("id = source")).groupBy("query_id", "target").agg(F.max(F.col("score") * F.col("w") * DECAY).alias("score")).select("query_id", F.col("target").alias("id"), "score")
        level = seen(level)
        reached = reached.union(level)
    files = reached.join(nodes.where("source_file is not null").select("id", F.col("source_file").alias("path")), "id").groupBy("query_id", "path").agg(F.max("score").alias("score"))
    return top(files, [F.desc("score"), F.asc(F.lower("path")), F.asc("path")], limit)


def distances(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance) within depth hops, deduplicated at each hop."""
    hops = both_ways(edges.select("source", "target")).distinct()
    level = seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"))
    for k in range(1, depth + 1):
        level = level.join(hops, F.expr("node = source")).select("start", F.col("target").alias("node"), F.lit(k).alias("distance")).distinct()
        seen = seen.union(level)
    return seen.groupBy("start", "node").agg(F.min("distance").alias("distance"))


def neighbours(starts: DataFrame, edges: DataFrame, depth: int, limit: int) -> DataFrame:
    """The nearest nodes of each start: start, node, distance, rank; never more than limit."""
    w = W.partitionBy("start").orderBy("distance", "node")
    return distances(starts, edges, max(1, min(depth, MOST_DEPTH))).where("distance > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def shortest_paths(pairs: DataFrame, edges: DataFrame, longest: int = 6) -> DataFrame:
    """A shortest chain for each pair (source, target), the least one by node ids: source, target, path, hops.

    Steps forward keep one chain a node and hop, so that their number is bounded by the nodes.
    """
    hops = both_ways(edges.select("source", "target")).distinct().withColumnsRenamed({"source": "a", "target": "b"})
    level = pairs.select("source", F.col("source").alias("at"), F.array("source").alias("path")).distinct()
    seen = level
    for _ in range(longest):
        level = level.join(hops, F.expr("at = a")).where("not array_contains(path, b)").groupBy("source", "b").agg(F.min(F.concat("path", F.array("b"))).alias("path")).select("source", F.col("b").alias("at"), "path")
        seen = seen.unionByName(level)
    first = seen.groupBy("source", "at").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("x"))
    return pairs.join(first.select("source", F.col("at").alias("target"), "x.path"), ["source", "target"]).select("source", "target", "path", (F.size("path") - 1).alias("hops"))


def merge_graphs(graphs: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Graphs of several providers with prefixed ids; a repeated node or a dangling edge is an error when read."""
    nodes = edges = None
    for name, (n, e) in graphs.items():
        n = n.withColumn("id", F.concat(F.lit(f"{name}:"), "id"))
        e = e.withColumn("source", F.concat(F.lit(f"{name}:"), "source")).withColumn("target", F.concat(F.lit(f"{name}:"), "target"))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    nodes = nodes.join(twice, "id", "left").withColumn("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated node "), "id")))).select(nodes.columns)
    for end in ("source", "target"):
        there = nodes.select(F.col("id").alias("there")).distinct()
        checked = F.when(F.col("there").isNotNull(), F.col(end)).otherwise(F.raise_error(F.concat(F.lit("dangling edge at "), end)))
        edges = edges.join(there, F.col(end) == F.col("there"), "left").withColumn(end, checked).select(edges.columns)
    return nodes, edges


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, duplicate_nodes, dangling_edges, self_loops."""
    ids = nodes.select("id").distinct()
    loose = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select(edges.columns).unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(edges.columns)).distinct()
    n = nodes.agg(F.count("*").alias("nodes"), (F.count("*") - F.count_distinct("id")).alias("duplicate_nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("source") == F.col("target")).alias("self_loops"))
    return n.join(e, how="cross").join(loose.agg(F.count("*").alias("dangling_edges")), how="cross")


def acceptable(health: DataFrame, previous_nodes: int, least_share: float = 0.5) -> DataFrame:
    """Whether a new graph may replace one of previous_nodes nodes: sound, and not shrunk too far."""
    return health.select(((F.col("duplicate_nodes") == 0) & (F.col("dangling_edges") == 0) & (F.col("self_loops") == 0) & (F.col("nodes") >= least_share * previous_nodes)).alias("acceptable"))
