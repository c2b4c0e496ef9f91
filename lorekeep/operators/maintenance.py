"""Index maintenance: incremental diff, duplicate keys, upsert, work queue, digests, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """State of every key: added, changed, unchanged or removed. Both have key, mtime, hash.

    An equal time settles it; otherwise the content's hash does.
    """
    p = previous.select(F.col(key), F.col("mtime").alias("m0"), F.col("hash").alias("h0"), F.lit(True).alias("was"))
    c = current.select(F.col(key), F.col("mtime").alias("m1"), F.col("hash").alias("h1"), F.lit(True).alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when((F.col("m0") == F.col("m1")) | (F.col("h0") == F.col("h1")), "unchanged").otherwise("changed")
    return p.join(c, key, "full").select(key, state.alias("state"))


def untouched(previous: DataFrame, current: DataFrame, key: str = "path") -> bool:
    """Whether all keys and times agree, so that the old snapshot may stand."""
    a, b = previous.select(key, "mtime"), current.select(key, "mtime")
    return a.join(b, [key, "mtime"], "left_anti").isEmpty() and b.join(a, [key, "mtime"], "left_anti").isEmpty()


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def keep_known(rows: DataFrame, known: DataFrame, key: str, path: str = "path") -> DataFrame:
    """One row a key: the one whose path is already known under it, else the first path; rejected rows marked."""
    k = known.select(F.col(key), F.col(path).alias("__old"))
    order = W.partitionBy(key).orderBy(F.desc(F.coalesce(F.col(path) == F.col("__old"), F.lit(False))), path)
    return rows.join(k, key, "left").withColumn("rejected", F.row_number().over(order) > 1).drop("__old")


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes over current: rows of new keys come in, those of known keys are replaced."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes)


def remove(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key), key, "left_anti")


def source_digest(rows: DataFrame, root: str, parts: list[str], order: list[str]) -> DataFrame:
    """(root, digest, records): SHA-256 over a root's rows in a total order."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    rows_ = F.array_sort(F.collect_list(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))))
    return rows.groupBy(root).agg(F.sha2(F.concat_ws("\x1e", F.transform(rows_, lambda r: r["line"])), 256).alias("digest"), F.count("*").alias("records"))


def pending(queue: DataFrame, artifacts: DataFrame, limit: int = 200) -> DataFrame:
    """The oldest pending roots that are live, untimed ones first."""
    rows = queue.where("status = 'pending'").join(artifacts.where("deleted_at is null and redacted_at is null").select("artifact_id", "occurred_at"), "artifact_id")
    return rows.orderBy(F.asc_nulls_first("occurred_at"), "artifact_id").limit(min(limit, 200))


def reopen(queue: DataFrame, touched: DataFrame, digests: DataFrame) -> DataFrame:
    """The queue after changes: a root that was touched is pending with its new digest.

    queue: artifact_id, status, digest, event_id; touched: artifact_id, event_id, system_only (a
    change of system messages alone doesn't reopen a root); digests: artifact_id, digest.
    """
    t = touched.where("not system_only").groupBy("artifact_id").agg(F.max("event_id").alias("event_id")).join(digests, "artifact_id")
    return upsert(queue, t.select("artifact_id", F.lit("pending").alias("status"), "digest", "event_id"), ["artifact_id"])


def complete(queue: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, rejected): done rows (artifact_id, status, digest, event_id) take effect if nothing moved since.

    `no-durable-memory` is for conversations only (column entity).
    """
    d = done.join(queue.select("artifact_id", F.col("digest").alias("__d"), F.col("event_id").alias("__e")), "artifact_id", "left")
    ok = F.coalesce((F.col("digest") == F.col("__d")) & (F.col("event_id") == F.col("__e")) & ((F.col("status") != "no-durable-memory") | (F.col("entity") == "conversation")), F.lit(False))
    return upsert(queue, d.where(ok).select("artifact_id", "status", "digest", "event_id"), ["artifact_id"]), d.where(~ok).select(done.columns)


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose foreign key finds no parent."""
    return children.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def verify(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """expected counts (keys, n) beside the actual rows' counts: keys, n, found, ok."""
    got = actual.groupBy(*keys).agg(F.count("*").alias("found"))
    return expected.join(got, keys, "left").select(*keys, "n", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) == F.col("n")).alias("ok"))


def high_water(rows: DataFrame, group: list[str], time: str, version: str) -> DataFrame:
    """The latest time (null if none) and the highest version (0 if none) of each group."""
    return rows.groupBy(*group).agg(F.max(time).alias("latest"), F.coalesce(F.max(version), F.lit(0)).alias("version"))
