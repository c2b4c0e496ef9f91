"""Raw records and bursts: full-text search, vector search, relations, reading in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import artifact_id, artifact_uri
from ..functions.vectors import SPARSE, embed
from ..operators.bursts import FIELDS, group_bursts
from ..operators.hierarchy import hidden
from ..operators.lexical import LexicalIndex, bm25, build_index, normalised, top
from ..operators.scope import ArtifactScope, live
from ..operators.vector import sparse_cosine
from ..staging import written

# Column weights of the records' index, result limit.
WEIGHTS = {"title": 2.0, "author_name": 1.0, "text": 5.0, "external_id": 1.0}
MOST = 100
PAYLOAD = "title string, text string, classification string, occurred_at timestamp, author struct<id:string,name:string>, participants array<struct<id:string,name:string>>, aliases array<struct<kind:string,value:string>>, links array<struct<relation:string,target:struct<entity:string,external_id:string>>>, object struct<expected_sha256:string,media_type:string,original_name:string>, reactions array<string>"


def records(state: DataFrame) -> DataFrame:
    """Current rows with the fields of their payloads; a record of another form has nulls."""
    p = F.from_json("payload", PAYLOAD)
    text = lambda c: F.coalesce(c, F.lit(""))
    return state.withColumn("p", p).select(
        "artifact_id", artifact_uri(F.col("entity"), F.col("artifact_id")).alias("uri"), "source", "source_instance", "entity", "external_id", "parent_artifact_id", "deleted_at", "redacted_at", "last_event_id", "source_version",
        text(F.col("p.title")).alias("title"), text(F.col("p.text")).alias("text"), text(F.col("p.author.id")).alias("author_id"), text(F.col("p.author.name")).alias("author_name"), text(F.col("p.classification")).alias("classification"),
        F.col("p.occurred_at").alias("occurred_at"), F.col("p.participants.name").alias("participant_names"), F.coalesce("p.reactions", F.array().cast("array<string>")).alias("reactions"), F.col("p.object.expected_sha256").alias("object_sha256"),
        F.col("p.aliases").alias("aliases"), F.col("p.links").alias("links"),
    )


def aliases(rows: DataFrame) -> DataFrame:
    """(artifact_id, kind, value) of live records: what the newest accepted payload says."""
    return rows.where(live()).select("artifact_id", F.explode("aliases").alias("a")).select("artifact_id", "a.kind", "a.value").distinct()


def links(rows: DataFrame) -> DataFrame:
    """(source, relation, target) of live records; a target that doesn't exist is left to broken_links()."""
    t = rows.where(live()).select("artifact_id", "source", "source_instance", F.explode("links").alias("l"))
    t = t.withColumn("target", artifact_id(F.col("source"), F.col("source_instance"), F.col("l.target.entity"), F.col("l.target.external_id")))
    return t.select(F.col("artifact_id").alias("source"), "l.relation", "target").distinct()


def broken_links(rows: DataFrame) -> DataFrame:
    return links(rows).join(rows.select(F.col("artifact_id").alias("target")), "target", "left_anti")


def burst_records(rows: DataFrame) -> DataFrame:
    """Messages in the form of group_bursts(): with their parents' titles and whether a file hangs on them."""
    parents = rows.select(F.col("artifact_id").alias("parent_artifact_id"), F.col("title").alias("parent_title"))
    files = rows.where("entity = 'attachment'").where(live()).select(F.col("parent_artifact_id").alias("artifact_id")).distinct().withColumn("has_file", F.lit(True))
    m = rows.where("entity = 'message' and occurred_at is not null").join(parents, "parent_artifact_id", "left").join(files, "artifact_id", "left")
    return m.select("artifact_id", F.col("uri").alias("artifact_uri"), "parent_artifact_id", "parent_title", "source", "source_instance", "entity", "author_id", "author_name", "participant_names", "reactions", "occurred_at", "text", "classification", (F.coalesce("has_file", F.lit(False)) | F.col("object_sha256").isNotNull()).alias("attachment_link"), F.col("deleted_at").isNotNull().alias("deleted"), F.col("redacted_at").isNotNull().alias("redacted"))


def burst_digest() -> Column:
    """SHA-256 of what makes a burst's row: its bounds, text and whether it is embedded."""
    parts = ("burst_id", "parent_artifact_id", "author_id", "first_artifact_uri", "last_artifact_uri", "started_at", "ended_at", "record_count", "text", "embed")
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]), 256)


def refresh_layer(previous: tuple[DataFrame, DataFrame] | None, messages: DataFrame, dirty: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bursts, vectors, states) from the last generation's (bursts with digest, vectors) and what changed since.

    messages: as burst_records() gives. dirty: the parents (parent_artifact_id) that change_feed()
    names; None regroups all. Bursts of other parents are taken over unread. Of the regrouped ones
    those whose digest is known keep their vector, and only the rest are embedded. states: burst_id
    and state: kept (parent untouched), reused, embedded (new or changed, with a vector), plain (new
    or changed, too slight for a vector) or removed.
    """
    spark = messages.sparkSession
    if previous is None:
        previous, dirty = (spark.createDataFrame([], f"{FIELDS}, digest string"), spark.createDataFrame([], f"id string, v {SPARSE}")), None
    old, vectors = previous
    touched = messages if dirty is None else messages.join(dirty.select("parent_artifact_id"), "parent_artifact_id", "left_semi")
    new = written(group_bursts(touched).withColumn("digest", burst_digest()))
    if dirty is None:
        kept, stale = old.where("false"), old
    else:
        kept, stale = (old.join(dirty.select("parent_artifact_id"), "parent_artifact_id", how).select(old.columns) for how in ("left_anti", "left_semi"))
    known = stale.select("burst_id", "digest").withColumn("known", F.lit(True))
    marked = written(new.join(known, ["burst_id", "digest"], "left").select(*new.columns, F.coalesce("known", F.lit(False)).alias("known")))
    fresh = marked.where("not known and embed").select(F.col("burst_id").alias("id"), embed(F.col("text"), stored=True).alias("v"))
    still = kept.select("burst_id").union(marked.where("known").select("burst_id"))
    held = vectors.join(still.select(F.col("burst_id").alias("id")), "id", "left_semi").select("id", "v")
    state = F.when(F.col("known"), "reused").when(F.col("embed"), "embedded").otherwise("plain")
    states = kept.select("burst_id", F.lit("kept").alias("state")).union(marked.select("burst_id", state.alias("state")))
    states = states.union(stale.join(new, "burst_id", "left_anti").select("burst_id", F.lit("removed").alias("state")))
    return kept.unionByName(new.select(old.columns)), held.unionByName(fresh), states


def index_records(rows: DataFrame) -> LexicalIndex:
    """The full-text index, of live records only."""
    return build_index(rows.where(live()), "artifact_id", WEIGHTS, positions=True)


def search_records(index: LexicalIndex, rows: DataFrame, queries: DataFrame, scope: ArtifactScope | None = None, limit: int = 5) -> DataFrame:
    """query_id, artifact_id, uri, ..., score, rank: scope first, then weighted BM25, ties by id.

    Scores tie that agree to nine decimals, so the order of a sum's parts doesn't rank rows. A live record below a deleted or redacted one isn't found, where rows have parent_artifact_id.
    """
    inside = rows.where((scope or ArtifactScope()).records())
    if "parent_artifact_id" in rows.columns:
        dead = F.col("deleted_at").isNotNull() | F.col("redacted_at").isNotNull()
        under = hidden(rows.select(F.col("artifact_id").alias("node"), F.col("parent_artifact_id").alias("parent"), dead.alias("dead")))
        inside = inside.join(under.withColumnRenamed("node", "artifact_id"), "artifact_id", "left_anti")
    found = bm25(index, queries).withColumnRenamed("id", "artifact_id").join(inside, "artifact_id").withColumn("score", normalised(F.col("bm25")))
    return top(found, [F.round("score", 9).desc(), F.asc("artifact_id")], min(limit, MOST))


def search_bursts(bursts: DataFrame, vectors: DataFrame, queries: DataFrame, scope: ArtifactScope | None = None, limit: int = 5) -> DataFrame:
    """Bursts by cosine of hashed vectors, above 0; ties by id from the end."""
    q = queries.select("query_id", embed(F.col("query")).alias("v"))
    inside = bursts.where((scope or ArtifactScope()).bursts())
    found = sparse_cosine(q, vectors).withColumnRenamed("id", "burst_id").join(inside, "burst_id").withColumnRenamed("cosine", "score")
    return top(found, [F.desc("score"), F.desc("burst_id")], limit).where("score > 0")
