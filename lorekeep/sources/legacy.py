"""Import of an older relational export: conversations, messages, attachments, meetings and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: `[00:12:30] Name: text`, the start of a cue.
CUE = r"^\s*\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?\s+([^:\n]{1,80}):\s*(.*)$"
EVENT = ["operation", "entity", "external_id", "parent_entity", "parent_external_id", "source_version", "source_updated_at", "payload"]


def external_id(*parts: Column) -> Column:
    """A stable id from natural keys."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def cues(notes: DataFrame) -> DataFrame:
    """Cues under a `## Transcript` heading: note_id, cue, at, speaker, text; lines without a time continue one."""
    body = F.regexp_extract("text", r"(?is)##\s*Transcript\s*\n(.*?)(?=\n##\s|\z)", 1)
    lines = notes.select("note_id", F.posexplode(F.split(body, "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    starts = F.rlike("line", F.lit(CUE))
    numbered = lines.withColumn("cue", F.sum(starts.cast("int")).over(W.partitionBy("note_id").orderBy("line_no"))).where("cue > 0")
    part = F.when(starts, F.regexp_extract("line", CUE, 3)).otherwise(F.trim("line"))
    rows = numbered.select("note_id", "cue", "line_no", F.when(starts, F.regexp_extract("line", CUE, 1)).alias("at"), F.when(starts, F.trim(F.regexp_extract("line", CUE, 2))).alias("speaker"), part.alias("part"))
    return rows.groupBy("note_id", "cue").agg(F.max("at").alias("at"), F.max("speaker").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "\n").alias("text"))


def to_events(conversations: DataFrame, messages: DataFrame, attachments: DataFrame, meetings: DataFrame) -> DataFrame:
    """Upserts in an order in which parents come first: level, and the columns of EVENT."""
    null = F.lit(None).cast("string")
    c = conversations.select(F.lit(0).alias("level"), F.lit("upsert").alias("operation"), F.lit("conversation").alias("entity"), F.col("id").cast("string").alias("external_id"), null.alias("parent_entity"), null.alias("parent_external_id"), null.alias("source_version"), F.col("updated_at").alias("source_updated_at"), F.to_json(F.struct(F.col("name").alias("title"), "kind", "thread_type")).alias("payload"))
    files = attachments.groupBy("conversation_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("attachment_index", "name"))).alias("files"))
    m = messages.join(files, ["conversation_id", "message_id"], "left").select(F.lit(1).alias("level"), F.lit("upsert").alias("operation"), F.lit("message").alias("entity"), F.concat_ws("/", "conversation_id", "message_id").alias("external_id"), F.lit("conversation").alias("parent_entity"), F.col("conversation_id").cast("string").alias("parent_external_id"), F.col("version").cast("string").alias("source_version"), F.col("updated_at").alias("source_updated_at"), F.to_json(F.struct(F.col("content_markdown").alias("text"), F.struct(F.col("author").alias("name")).alias("author"), F.col("timestamp").alias("occurred_at"), "files")).alias("payload"))
    a = attachments.select(F.lit(2).alias("level"), F.lit("upsert").alias("operation"), F.lit("attachment").alias("entity"), F.concat_ws("/", "conversation_id", "message_id", "attachment_index").alias("external_id"), F.lit("message").alias("parent_entity"), F.concat_ws("/", "conversation_id", "message_id").alias("parent_external_id"), null.alias("source_version"), F.col("updated_at").alias("source_updated_at"), F.to_json(F.struct(F.col("name").alias("title"), "content_type")).alias("payload"))
    g = meetings.select(F.lit(0).alias("level"), F.lit("upsert").alias("operation"), F.lit("meeting").alias("entity"), F.concat_ws("@", "conversation_id", F.url_encode(F.coalesce(F.col("start_time").cast("string"), F.lit("")))).alias("external_id"), null.alias("parent_entity"), null.alias("parent_external_id"), null.alias("source_version"), F.col("updated_at").alias("source_updated_at"), F.to_json(F.struct(F.col("subject").alias("title"), F.col("start_time").alias("occurred_at"), "organizer_id")).alias("payload"))
    return c.unionByName(g).unionByName(m).unionByName(a)


def plan_problems(events: DataFrame) -> DataFrame:
    """(entity, external_id, problem): duplicate ids, and parents that aren't part of the import."""
    twice = events.groupBy("entity", "external_id").agg(F.count("*").alias("n")).where("n > 1").select("entity", "external_id", F.lit("duplicate").alias("problem"))
    parents = events.select(F.col("entity").alias("parent_entity"), F.col("external_id").alias("parent_external_id"))
    loose = events.where("parent_entity is not null").join(parents, ["parent_entity", "parent_external_id"], "left_anti").select("entity", "external_id", F.lit("no parent").alias("problem"))
    return twice.union(loose)


def fingerprint(table: DataFrame) -> DataFrame:
    """One row: rows and an order-free digest, to see that a source didn't change meanwhile."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in table.columns])
    return table.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("digest"))


def match_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(row_id, note_id): by id, or else by a title that is unique on both sides."""
    by_id = rows.join(notes.select("note_id", F.col("row_id").alias("r")), F.col("row_id") == F.col("r")).select("row_id", "note_id")
    left = rows.join(by_id, "row_id", "left_anti").withColumn("n", F.count("*").over(W.partitionBy("title"))).where("n = 1").select("row_id", "title")
    free = notes.join(by_id, "note_id", "left_anti").withColumn("n", F.count("*").over(W.partitionBy("title"))).where("n = 1").select("note_id", "title")
    return by_id.unionByName(left.join(free, "title").select("row_id", "note_id"))
