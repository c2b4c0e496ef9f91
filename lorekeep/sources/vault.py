"""Markdown vaults, graph JSON and event batches as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_markdown, content_hash, identifiers, parse_note


def scan(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Raw notes of several sources: source_id, path (with the source in front), raw, mtime, size.

    Hidden, restricted and trashed folders are left out, in any part of the path. Source ids and
    roots must be unique.
    """
    if len(set(roots.values())) != len(roots):
        raise ValueError("two sources share a root")

    def one(source: str, root: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
        relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^/*" + _quoted(root.split(":", 1)[-1].strip("/")) + "/", "")
        df = files.select(F.lit(source).alias("source_id"), F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("relative"), F.col("content").cast("string").alias("raw"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
        parts = F.split("relative", "/")
        out = F.exists(parts, lambda p: p.startswith(".") | F.lower(p).isin("restricted", ".trash"))
        return df.where(~out).select("source_id", F.concat(F.lit(f"{source}/"), "relative").alias("path"), "raw", "mtime", "size")

    return reduce(DataFrame.unionByName, [one(s, r) for s, r in roots.items()]) if roots else spark.createDataFrame([], "source_id string, path string, raw string, mtime timestamp, size long")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.+*?()[]{}^$|" else c for c in text)


def parse(raw: DataFrame) -> DataFrame:
    """Documents: all note fields, identifiers and the content's hash."""
    n = raw.withColumn("n", parse_note("raw", "path"))
    own = F.filter(F.split("n.scope_id", r"\s+"), lambda x: x != "")
    return n.select("n.*", "source_id", "path", F.array_distinct(F.concat(identifiers(F.col("raw")), own)).alias("identifiers"), content_hash(F.col("raw")).alias("hash"), "mtime")


def chunk(docs: DataFrame) -> DataFrame:
    """Chunks: chunk_id, memory_id, ordinal, heading, text, title, path, contextual text."""
    c = docs.select("memory_id", "source_id", "path", "title", F.posexplode(chunk_markdown("body")).alias("ordinal", "c"))
    some = lambda x: F.when(x != "", x)
    return c.select(F.concat_ws(":", "memory_id", "ordinal").alias("chunk_id"), "memory_id", "source_id", "path", "title", "ordinal", "c.heading", "c.text", F.concat_ws("\n", some(F.col("title")), some(F.col("c.heading")), some(F.col("c.text"))).alias("contextual"))


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file; edges may be called links; dangling ones are dropped."""
    raw = spark.read.schema("nodes array<struct<id:string,label:string,source_file:string>>, links array<struct<source:string,target:string,relation:string,confidence:string>>, edges array<struct<source:string,target:string,relation:string,confidence:string>>").json(path, multiLine=True)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    edges = raw.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*")
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "relation", "confidence")
