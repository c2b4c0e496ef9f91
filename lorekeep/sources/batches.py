"""Event batches in JSON lines: a manifest, then its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.secrets import has_secret

# Patterns of the record schemas (a producer, then the kind), entities and operations.
MANIFEST, RECORD = r"[a-z-]+/artifact-batch@1", r"[a-z-]+/artifact-event@1"
ENTITIES = ("conversation", "message", "meeting", "recording", "transcript", "transcript-cue", "attachment")
OPERATIONS = ("upsert", "delete", "redact")
REF = "struct<entity:string,external_id:string>"
LINE = f"schema string, record string, batch_id string, source string, source_instance string, observed_at timestamp, event_count int, coverage array<struct<parent:{REF},entity:string,covered_from:timestamp,covered_to:timestamp,complete:boolean>>, entity string, operation string, external_id string, parent {REF}, source_version string, source_sequence long, source_updated_at timestamp"


def read_batches(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """Whole files: file, sha256 of the exact bytes, content. A file beyond most_bytes is an error."""
    files = spark.read.format("binaryFile").load(path)
    size = F.when(F.col("length") > most_bytes, F.raise_error(F.concat(F.lit("batch too large: "), "path")).cast("binary")).otherwise(F.col("content"))
    return files.select(F.col("path").alias("file"), F.sha2(size, 256).alias("sha256"), size.alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """file, sha256, at, line and the parsed fields of each line that isn't empty."""
    l = files.select("file", "sha256", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("at", "line")).where("trim(line) <> ''")  # noqa: E741
    parsed = F.from_json("line", LINE, {"mode": "PERMISSIVE"})
    return l.withColumn("x", parsed).withColumn("payload", F.get_json_object("line", "$.payload")).select("file", "sha256", "at", "line", "payload", "x.*")


def problems(rows: DataFrame) -> DataFrame:
    """(file, problem) of batches that must be refused; none for sound ones."""
    first = rows.where("at = 0").select("file", F.col("schema").alias("s"), F.col("record").alias("r"), "event_count", "batch_id", "source", "source_instance")
    label = lambda c: F.coalesce(F.rlike(c, F.lit("^[a-z][a-z0-9-]*$")), F.lit(False))
    bad_head = first.where(~F.rlike(F.coalesce("s", F.lit("")), F.lit(f"^{MANIFEST}$")) | (F.coalesce("r", F.lit("")) != "batch") | F.col("batch_id").isNull() | ~label(F.col("source")) | ~label(F.col("source_instance"))).select("file", F.lit("manifest").alias("problem"))
    events = rows.where("at > 0")
    counts = events.groupBy("file").agg(F.count("*").alias("n"))
    bad_count = first.join(counts, "file", "left").where("coalesce(n, 0) <> coalesce(event_count, -1)").select("file", F.lit("event count").alias("problem"))
    sound = F.rlike(F.col("schema"), F.lit(f"^{RECORD}$")) & (F.col("record") == "event") & F.col("entity").isin(*ENTITIES) & F.col("operation").isin(*OPERATIONS) & F.length("external_id").between(1, 2048) & (F.coalesce("source_sequence", F.lit(0)) >= 0)
    payload = F.when(F.col("operation") == "delete", F.col("payload").isNull()).otherwise(F.col("payload").isNotNull())
    bad_event = events.where(~F.coalesce(sound & payload, F.lit(False))).select("file", F.lit("event").alias("problem"))
    secret = rows.where(has_secret("line")).select("file", F.lit("secret").alias("problem"))
    return bad_head.union(bad_count).union(bad_event).union(secret).distinct()


def events(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """Rows for apply_events(): events in order, and complete coverage claims after them."""
    head = rows.where("at = 0").select("file", "batch_id", "source", "source_instance", "observed_at", "coverage", F.unix_micros("observed_at").alias("batch_seq"))
    if order is not None:
        head = head.withColumn("batch_seq", order)
    own = rows.where("at > 0").select("file", F.col("at").alias("ordinal"), "record", "operation", "entity", "external_id", F.col("parent.entity").alias("parent_entity"), F.col("parent.external_id").alias("parent_external_id"), "source_sequence", "source_updated_at", "source_version", "payload", F.lit(None).cast("timestamp").alias("covered_from"), F.lit(None).cast("timestamp").alias("covered_to"))
    e = head.drop("coverage").join(own, "file")
    null = lambda t: F.lit(None).cast(t)
    c = head.select("*", F.posexplode("coverage").alias("p", "c")).where("c.complete")
    c = c.select("file", "batch_id", "source", "source_instance", "observed_at", "batch_seq", (F.lit(2**30) + F.col("p")).cast("int").alias("ordinal"), F.lit("coverage").alias("record"), null("string").alias("operation"), F.col("c.entity").alias("entity"), null("string").alias("external_id"), F.col("c.parent.entity").alias("parent_entity"), F.col("c.parent.external_id").alias("parent_external_id"), null("long").alias("source_sequence"), null("timestamp").alias("source_updated_at"), null("string").alias("source_version"), null("string").alias("payload"), F.col("c.covered_from").alias("covered_from"), F.col("c.covered_to").alias("covered_to"))
    return e.unionByName(c).drop("file")
