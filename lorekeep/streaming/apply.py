"""Streams of event batches: exactly-once application, deduplication, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import EVENT, LOG, STATE, apply_events, new_batches
from ..sources.store import Store
from ..staging import settle


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Files of events in the schema of apply_events(), as they arrive."""
    return spark.readStream.schema(EVENT).json(path)


MANIFEST = "manifest"


def apply_stream(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch to the store's state and log, and publish both together.

    The ledger has a row for each event by (batch_id, record, ordinal) with a hash of its content:
    what it holds is left out, so a micro-batch that is run again changes nothing; the same place with
    other content is an error. A row with record 'manifest' says in `ordinal` how many other rows
    its batch has: these wait in table `waiting` until all are there, so that a coverage claim
    meets its whole batch. Without a manifest rows are applied as they come. A batch that breaks
    the hierarchy is rejected by a log row and doesn't stop the stream.
    """
    content = F.xxhash64(*[F.col(c.split(" ")[0]) for c in EVENT.split(", ")]).cast("string")

    def one(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        gen = store.current()
        old = {n: store.table(gen, n) if gen else None for n in ("state", "log", "ledger", "waiting")}
        rows = batch.withColumn("sha256", content).withColumn("place", F.concat_ws("/", "batch_id", "record", "ordinal")).dropDuplicates(["place", "sha256"])
        keyed = rows.select(F.col("place").alias("batch_id"), "sha256")
        twice = keyed.groupBy("batch_id").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("other"))
        twice = twice.withColumn("sha256", F.when(F.col("sha256") == F.col("other"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("two contents for "), "batch_id")))).drop("other")
        fresh = settle(twice if old["ledger"] is None else new_batches(twice, old["ledger"]))
        todo = rows.join(fresh.select(F.col("batch_id").alias("place")), "place", "left_semi").select(batch.columns)
        if old["waiting"] is not None:
            todo = todo.unionByName(old["waiting"])
        todo = settle(todo)
        said = todo.where(F.col("record") == MANIFEST).groupBy("batch_id").agg(F.max("ordinal").alias("most"))
        short = said.join(todo.where(F.col("record") != MANIFEST).groupBy("batch_id").agg(F.count("*").alias("n")), "batch_id", "left").where("coalesce(n, 0) < most").select("batch_id")
        ready = todo.join(short, "batch_id", "left_anti").where(F.col("record") != MANIFEST).select(batch.columns)
        waiting = todo.join(short, "batch_id", "left_semi").select(batch.columns)
        if not fresh.isEmpty():
            state, log = (old["state"], old["log"]) if ready.isEmpty() else map(settle, apply_events(ready, old["state"], old["log"], strict=False))
            tables = {"state": state, "log": log, "waiting": waiting, "ledger": fresh if old["ledger"] is None else old["ledger"].unionByName(fresh)}
            store.publish({n: df if df is not None else batch.sparkSession.createDataFrame([], schema) for (n, df), schema in zip(tables.items(), (STATE, LOG, EVENT, "batch_id string, sha256 string"))})
        batch.unpersist()

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_events(events: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """The first sighting of each key within the watermark; a time without zone is read as UTC."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time: str, key: str, gap: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """key, started, ended, n of runs of activity; works on a stream and on a table alike."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    s = e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n"))
    return s.select(key, "started", "ended", "n")


def rates(events: DataFrame, time: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by tumbling window."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    return e.groupBy(F.window(time, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
