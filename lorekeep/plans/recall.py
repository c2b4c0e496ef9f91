"""Recall for a batch of queries: scope, lexical, semantic and graph retrieval, fusion, rerank, gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import embed
from ..operators.fusion import answer_gate, fuse, rerank
from ..operators.graph import build_graph, neighbours, rank, shortest_paths
from ..operators.lexical import LexicalIndex, best_per_group, bm25, build_index, normalised, top
from ..operators.scope import Scope, mentioned
from ..operators.vector import sparse_cosine
from ..staging import settle

# Column weights, requested and candidate limits, context size.
WEIGHTS = {"title": 4.0, "heading": 2.0, "text": 1.0, "identifier_text": 7.0}
MOST, SEEDS, CONTEXT = 25, 20, 5000
RELATION_WORDS = ("relationship", "related", "connected", "connection", "path", "between", "depends", "link")


@dataclass
class Notes:
    """What a generation holds for notes: documents, chunks, their postings and vectors, and the graph."""

    docs: DataFrame
    chunks: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    links: DataFrame = field(default=None)

    @classmethod
    def build(cls, docs: DataFrame, chunks: DataFrame) -> Notes:
        named = chunks.join(docs.select("memory_id", F.array_join("identifiers", " ").alias("identifier_text")), "memory_id")
        lexical = build_index(named, "chunk_id", WEIGHTS, positions=True)
        vectors = chunks.select(F.col("chunk_id").alias("id"), embed(F.col("contextual"), stored=True).alias("v"))
        nodes, edges, links = build_graph(docs)
        return cls(docs, chunks, lexical, vectors, nodes, edges, links)

    def settled(self) -> Notes:
        """The same, with every table written out once."""
        tables = {k: settle(v) for k, v in self.tables().items()}
        return Notes.load(tables.__getitem__)

    def tables(self) -> dict[str, DataFrame]:
        return {"docs": self.docs, "chunks": self.chunks, "postings": self.lexical.postings, "lengths": self.lexical.lengths, "terms": self.lexical.terms, "stats": self.lexical.stats, "vectors": self.vectors, "nodes": self.nodes, "edges": self.edges}

    @classmethod
    def load(cls, read) -> Notes:
        """From a function that gives a table by name."""
        return cls(read("docs"), read("chunks"), LexicalIndex(read("postings"), read("lengths"), read("terms"), read("stats")), read("vectors"), read("nodes"), read("edges"))


def search(notes: Notes, queries: DataFrame, scopes: dict[str, Scope] | None = None, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(results, answers) of a batch. queries: query_id, query, now.

    scopes: the scope of a query by its id; others have the default one. Statistics come from the
    whole index, while scope is applied before any ranking.
    """
    limit = max(1, min(limit, MOST))
    many = max(8 * limit, 40)
    # distinct scopes are few; a document lists those that it lies in, so its rows aren't multiplied by queries
    own_scope = scopes or {}
    distinct = {str(s): s for s in [Scope(), *own_scope.values()]}
    of = F.lit(str(Scope()))
    for k, s in own_scope.items():
        of = F.when(F.col("query_id") == k, str(s)).otherwise(of)
    queries = settle(queries.withColumn("scope", of))
    inside = F.array_compact(F.array(*[F.when(s.predicate(), F.lit(k)) for k, s in distinct.items()]))
    held = settle(notes.docs.select("memory_id", "path", inside.alias("scopes")))
    own = notes.chunks.select(F.col("chunk_id").alias("id"), "memory_id", "ordinal").join(held.select("memory_id", "scopes"), "memory_id")
    within = lambda rows: rows.join(own, "id").join(queries.select("query_id", "scope"), "query_id").where("array_contains(scopes, scope)").drop("scopes", "scope")

    lex = within(bm25(notes.lexical, queries)).withColumn("score", normalised(F.col("bm25")))
    lex = best_per_group(lex, "memory_id", [F.desc("score"), F.asc("ordinal"), F.asc("id")])
    lex = settle(top(lex, [F.desc("score"), F.asc("memory_id")], many).select("query_id", "memory_id", "id", "score", "rank"))

    q = queries.select("query_id", embed(F.col("query")).alias("v"))
    sem = within(sparse_cosine(q, notes.vectors).withColumnRenamed("cosine", "score").where("score > 0"))
    sem = best_per_group(sem, "memory_id", [F.desc("score"), F.asc("ordinal"), F.asc("id")])
    sem = settle(top(sem, [F.desc("score"), F.asc("memory_id")], many).select("query_id", "memory_id", "id", "score", "rank"))

    paths = notes.docs.select("memory_id", "path")
    seeds = lex.where(F.col("rank") <= SEEDS).select("query_id", "memory_id", "rank").union(sem.where(F.col("rank") <= SEEDS).select("query_id", "memory_id", "rank"))
    seeds = top(seeds.groupBy("query_id", "memory_id").agg(F.sum(1.0 / (60 + F.col("rank"))).alias("s")), [F.desc("s"), F.asc("memory_id")], SEEDS, "place")
    seeds = seeds.withColumn("n", F.max("place").over(W.partitionBy("query_id"))).join(paths, "memory_id").select("query_id", "path", "place", "n")
    seeds = settle(seeds)
    # lists of at most `many` rows a query are settled, so that each producer is planned and run once
    files = held.select(F.lower("path").alias("f"), "scopes")
    visible = notes.nodes.select("id", F.lower("source_file").alias("f")).join(files, "f", "left").select("id", F.when(F.col("f").isNull(), F.lit(None)).otherwise(F.coalesce("scopes", F.array().cast("array<string>"))).alias("scopes"))
    walk = rank(queries, seeds, notes.nodes, notes.edges, many, visible=visible).join(held.select("memory_id", "path"), "path").select("query_id", "memory_id", "rank", "score")

    as_vote = lambda df: df.select("query_id", F.col("memory_id").alias("id"), "rank", "score")
    fused = fuse({"lexical": as_vote(lex), "semantic": as_vote(sem), "graph": as_vote(walk)})
    best = lex.select("query_id", "memory_id", F.col("id").alias("c"), F.lit(0).alias("o")).union(sem.select("query_id", "memory_id", "id", F.lit(1))).groupBy("query_id", "memory_id").agg(F.min_by("c", "o").alias("chunk_id"))
    whole = fused.join(queries.drop("scope"), "query_id").join(notes.docs.select(F.col("memory_id").alias("id"), "memory_id", "path", "title", "updated", "review_after"), "id").join(best, ["query_id", "memory_id"], "left")
    first = notes.chunks.where("ordinal = 0").select("memory_id", F.col("chunk_id").alias("c0"))
    whole = whole.join(first, "memory_id", "left").withColumn("chunk_id", F.coalesce("chunk_id", "c0")).join(notes.chunks.select("chunk_id", "heading", "text", "ordinal"), "chunk_id", "left")
    ranked = settle(rerank(whole, limit))
    return context(ranked, notes.chunks), answer_gate(ranked)


def context(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked with the text of the chunks next to the chosen one, cut at 5,000 characters."""
    near = ranked.select("query_id", "memory_id", "ordinal").join(chunks.select("memory_id", F.col("ordinal").alias("o"), F.trim(F.concat(F.when(F.col("heading") != "", F.concat(F.lit("## "), "heading", F.lit("\n"))).otherwise(F.lit("")), "text")).alias("t")), "memory_id").where("abs(o - ordinal) <= 1")
    near = near.groupBy("query_id", "memory_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n\n"), 1, CONTEXT).alias("context"))
    return ranked.join(near, ["query_id", "memory_id"], "left")


def route(query: str, docs: DataFrame) -> tuple[str, list[str]]:
    """How one query is answered: ('artifact', uri), ('exact', name), ('path', ids) or ('search', [])."""
    text = query.strip()
    low = text.lower()
    for prefix in ("get ", "open ", "show "):
        if low.startswith(prefix):
            text, low = text[len(prefix) :].strip(), low[len(prefix) :].strip()
            if not low.startswith("artifact://"):
                return "exact", [text]
    if low.startswith("artifact://"):
        return "artifact", [text]
    if any(w in low.split() for w in RELATION_WORDS):
        one = docs.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
        ids = [r.memory_id for r in mentioned(one, docs).orderBy("position").limit(2).collect()]
        if len(ids) == 2:
            return "path", ids
    return "search", []


def related(notes: Notes, memory_ids: DataFrame, depth: int = 2, limit: int = 6) -> DataFrame:
    return neighbours(memory_ids.select(F.col("memory_id").alias("start")), notes.edges, depth, limit)


def connect(notes: Notes, pairs: DataFrame) -> DataFrame:
    return shortest_paths(pairs, notes.edges)


def warnings(health: dict, counter: int, indexed: int) -> list[str]:
    """What a reader should know when a layer is missing or stale; lexical recall goes on."""
    out = [] if health.get("status") == "ok" else [f"the index is {health.get('status')}"]
    return out + (["the burst index is behind the records"] if counter != indexed else [])
