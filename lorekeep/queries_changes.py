"""Registered queries of incremental work: change feed, burst refresh, late snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import events as E
from .plans.artifacts import refresh_layer
from .queries import ORACLE_SQL, messages, query, t

ONE = "everything"  # all records belong to one source instance, whose units are spread over tasks


def happened(rows: DataFrame, batch: int, entity: str, key: Column, parent: tuple[str, Column] | None = None, *, operation: str = "upsert", payload: Column | None = None, sequence: int | None = None, seen: int | None = None) -> DataFrame:
    """Events (EVENT) of one batch, an event a row."""
    cols = {
        "batch_seq": F.lit(batch), "batch_id": F.lit(f"b{batch}"), "source": F.lit("tpch"), "source_instance": F.lit(ONE), "observed_at": F.expr(f"timestamp'2024-01-01' + interval {seen or batch} day"), "ordinal": F.row_number().over(W.partitionBy(key % 64).orderBy(key)) * 64 + key % 64,
        "record": F.lit("event"), "operation": F.lit(operation), "entity": F.lit(entity), "external_id": key, "source_sequence": F.lit(sequence or batch), "payload": F.lit("{}") if payload is None else payload,
    }
    if parent:
        cols |= {"parent_entity": F.lit(parent[0]), "parent_external_id": parent[1]}
    return rows.select([cols.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in (x.split(" ") for x in E.EVENT.split(", "))])


def claimed(rows: DataFrame, batch: int, entity: str, parent: tuple[str, Column], seen: int | None = None) -> DataFrame:
    """Complete coverage claims of one batch: all children of a kind of these parents were in it."""
    return happened(rows, batch, entity, parent[1], parent, seen=seen).withColumns({"record": F.lit("coverage"), "external_id": F.lit(None).cast("string"), "operation": F.lit(None).cast("string"), "payload": F.lit(None).cast("string")})


def together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MOVED = "(o_custkey + 1) % (select count(*) from customer)"


@query(f"""select distinct parent from (select o_custkey as parent from orders where o_orderstatus = 'P' union all select {MOVED} from orders where o_orderstatus = 'P'
union all select o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT')""")
def moves_feed(spark, sf):
    """Conversations whose bursts may differ after batch 1: former and new parents of messages that moved, and those of messages that got a file."""
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    n = c.count()
    filed = o.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    events = together(
        happened(c, 1, "conversation", F.col("c_custkey")),
        happened(o, 1, "message", F.col("o_orderkey"), ("conversation", F.col("o_custkey"))).withColumn("ordinal", F.col("ordinal") + 2**30),
        happened(o.where("o_orderstatus = 'P'"), 2, "message", F.col("o_orderkey"), ("conversation", (F.col("o_custkey") + 1) % n)),
        happened(filed, 3, "attachment", F.col("o_orderkey"), ("message", F.col("o_orderkey"))),
    )
    state, log = E.apply_events(events)
    return E.change_feed(log, 1).join(state.withColumnRenamed("artifact_id", "parent_artifact_id"), "parent_artifact_id").select(F.col("external_id").cast("long").alias("parent"))


@query("""select o_orderkey, c_mktsegment <> 'BUILDING' or o_orderstatus in ('F', 'P') as live, o_orderstatus = 'P' and c_mktsegment = 'BUILDING' as restored
from orders join customer on c_custkey = o_custkey""")
def coverage_restore(spark, sf):
    """A complete snapshot removes what it lacks; a late one, taken before, brings nothing back; a later sighting does.

    Batch 2 covers the conversations of a market segment and holds finished orders only. Batch 3 sights
    all open ones again, but was taken before batch 2; batch 4 sights pending ones after it.
    """
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    part = o.join(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    parent, text = ("conversation", F.col("o_custkey")), F.to_json(F.struct(F.col("o_orderstatus").alias("text")))
    sighted = lambda rows, batch, seen: happened(rows, batch, "message", F.col("o_orderkey"), parent, payload=text, sequence=1, seen=seen)
    events = together(
        happened(c, 1, "conversation", F.col("c_custkey")),
        sighted(o, 1, 1).withColumn("ordinal", F.col("ordinal") + 2**30),
        sighted(part.where("o_orderstatus = 'F'"), 2, 10),
        claimed(part.select("o_custkey").distinct(), 2, "message", parent, seen=10).withColumn("ordinal", F.col("ordinal") + 2**30),
        sighted(part.where("o_orderstatus <> 'F'"), 3, 5),
        sighted(part.where("o_orderstatus = 'P'"), 4, 20),
    )
    state, _ = E.apply_events(events)
    live = F.col("deleted_at").isNull()
    return state.where("entity = 'message'").select(F.col("external_id").cast("long").alias("o_orderkey"), live.alias("live"), (live & (F.col("last_observed_at") == F.lit("2024-01-21").cast("timestamp"))).alias("restored"))


def speech(spark, sf) -> DataFrame:
    """Messages as group_bursts() takes them; artifact_uri is the place in the conversation."""
    none = F.array().cast("array<string>")
    same = {"parent_title": "", "source": "chat", "source_instance": "d", "entity": "message", "author_id": "", "classification": ""}
    return messages(spark, sf).select(
        "artifact_id", F.row_number().over(W.partitionBy("conv_id").orderBy("occurred_at", "artifact_id")).cast("string").alias("artifact_uri"), F.col("conv_id").cast("string").alias("parent_artifact_id"), *[F.lit(v).alias(k) for k, v in same.items()],
        F.col("role").alias("author_name"), none.alias("participant_names"), none.alias("reactions"), "occurred_at", "text", F.lit(False).alias("attachment_link"), F.lit(False).alias("deleted"), F.lit(False).alias("redacted"),
    )


@query(ORACLE_SQL["bursts_by_author"])
def bursts_refreshed(spark, sf):
    """A second generation of bursts: of the first one only conversations that changed are regrouped.

    In the first generation the conversations that open with a message of the system lack their last turn.
    """
    now = speech(spark, sf)
    opened = now.where("artifact_uri = '1' and author_name = 'system'").select("parent_artifact_id")
    if opened.isEmpty():
        opened = now.where("artifact_uri = '1' and length(text) % 2 = 0").select("parent_artifact_id")
    last = F.row_number().over(W.partitionBy("parent_artifact_id").orderBy(F.desc("occurred_at"), F.desc("artifact_id")))
    short = now.join(opened, "parent_artifact_id", "left_semi").withColumn("k", last).where("k > 1").drop("k")
    before = short.unionByName(now.join(opened, "parent_artifact_id", "left_anti"))
    bursts, vectors, _ = refresh_layer(None, before)
    bursts, _, _ = refresh_layer((bursts, vectors), now, opened)
    return bursts.select(F.col("parent_artifact_id").cast("long").alias("conv_id"), F.col("first_artifact_uri").cast("long").alias("first"), F.col("author_name").alias("author"), F.col("record_count").cast("long").alias("n"), F.length("text").cast("long").alias("chars"))
