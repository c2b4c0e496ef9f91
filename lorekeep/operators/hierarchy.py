"""Parent hierarchies: closures, cascades, liveness by ancestors, contexts, roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written

#: Levels that a hierarchy may have; a deeper one, and so a cycle, is an error.
DEPTH = 8


def failing(message: Column) -> Column:
    """A condition that fails the query with a message. It counts as random, so that it is never planned ahead of a join."""
    return F.isnull(F.raise_error(F.concat(message, F.substring(F.rand().cast("string"), 1, 0))))


def refuse(rows: DataFrame, depth: int) -> DataFrame:
    """No rows: any row, which lies deeper than a hierarchy may be, fails the query."""
    return rows.where(failing(F.lit(f"the hierarchy has more than {depth} levels or a cycle")))


def closure(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, ancestor, distance) for all ancestors, at most depth levels up or an error.

    nodes: node, parent. An equi-join a level, written out, until a level is empty.
    """
    edges = nodes.where("parent is not null").select("node", "parent")
    edges = written(edges)
    up = edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out = up
    for level in range(2, depth + 2):
        up = written(up.join(edges.select(F.col("node").alias("ancestor"), F.col("parent").alias("next")), "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(level).alias("distance")))
        if up.isEmpty():
            break
        out = out.unionByName(up if level <= depth else refuse(up, depth))
    return out


def below(edges: DataFrame, roots: DataFrame, depth: int = DEPTH, through=None) -> DataFrame:
    """(root, node, depth) of all descendants of roots (column root), level by level.

    through: condition on a node (and its columns in edges) to be reached and passed.
    """
    e = written(edges if through is None else edges.where(through))
    level = roots.select("root", F.col("root").alias("at")).distinct()
    out = None
    for k in range(1, depth + 2):
        level = written(level.join(e.select(F.col("parent").alias("at"), "node"), "at").select("root", F.col("node").alias("at")))
        one = level.select("root", F.col("at").alias("node"), F.lit(k).alias("depth"))
        out = one if out is None else out.unionByName(one if k <= depth else refuse(one, depth))
        if level.isEmpty():
            break
    return out


def hidden(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Nodes with a dead ancestor. nodes: node, parent, dead."""
    dead = nodes.where("dead").select(F.col("node").alias("ancestor"))
    return closure(nodes, depth).join(dead, "ancestor", "left_semi").select("node").distinct()


def active(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Live nodes whose ancestors all are live."""
    return nodes.where("not dead").join(hidden(nodes, depth), "node", "left_anti")


def cascade(nodes: DataFrame, deleted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Live descendants that the deletion of nodes (column root) tombstones, by depth: root, node, depth.

    A dead node on the way ends its branch.
    """
    return below(nodes.select("node", "parent", "dead"), deleted, depth, F.expr("not dead")).orderBy("depth", "node")


def roots(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, root): the last ancestor, a node without a parent being its own."""
    top_ = closure(nodes, depth).groupBy("node").agg(F.max_by("ancestor", "distance").alias("root"))
    return nodes.select("node").join(top_, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def conversation_context(artifacts: DataFrame, conversations: DataFrame) -> DataFrame:
    """(root, artifact_id): messages and attachments of a conversation, and the messages' attachments."""
    rows = artifacts.select("artifact_id", F.col("parent_artifact_id").alias("parent"), "entity")
    first = conversations.select("root").distinct().join(rows.where("entity in ('message', 'attachment')"), F.expr("root = parent")).select("root", "artifact_id", "entity")
    second = first.where("entity = 'message'").select("root", F.col("artifact_id").alias("m")).join(rows.where("entity = 'attachment'"), F.expr("m = parent")).select("root", "artifact_id")
    return first.select("root", "artifact_id").union(second).distinct()


def context(artifacts: DataFrame, links: DataFrame, roots_: DataFrame) -> DataFrame:
    """(root, artifact_id) of conversations and meetings, each by its own rule; other entities are an error."""
    kinds = roots_.select("root").distinct().join(artifacts.select(F.col("artifact_id").alias("root"), "entity"), "root")
    known = F.col("entity").isin("conversation", "meeting")
    wrong = kinds.where(F.when(known, F.lit(False)).otherwise(failing(F.concat(F.lit("no context for a "), "entity"))))
    talks, meetings = (kinds.where(F.col("entity") == e).select("root") for e in ("conversation", "meeting"))
    return conversation_context(artifacts, talks).unionByName(meeting_context(artifacts, links, meetings)).unionByName(wrong.select("root", F.col("root").alias("artifact_id")))


def meeting_context(artifacts: DataFrame, links: DataFrame, meetings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, artifact_id) of a meeting: parts below it or contained in it, and related chats' messages.

    Parts are recordings, transcripts, cues and attachments, reached by parent or by `contains`.
    """
    kinds = "entity in ('recording', 'transcript', 'transcript-cue', 'attachment')"
    rows = artifacts.where(kinds).select("artifact_id", F.col("parent_artifact_id").alias("parent"))
    contained = links.where("relation = 'contains'").select(F.col("target").alias("artifact_id"), F.col("source").alias("parent")).join(rows.select("artifact_id"), "artifact_id", "left_semi").select("artifact_id", "parent")
    steps = written(rows.union(contained).distinct())
    level = meetings.select("root", F.col("root").alias("at")).distinct()
    seen = None
    for k in range(1, depth + 2):
        level = written(level.join(steps, F.expr("at = parent")).select("root", F.col("artifact_id").alias("at")).distinct())
        seen = level if seen is None else seen.union(level if k <= depth else refuse(level, depth))
        if level.isEmpty():
            break
    chats = meetings.select("root").join(links.where("relation = 'related-chat'"), F.expr("root = source")).select("root", F.col("target").alias("c"))
    talk = conversation_context(artifacts, chats.select(F.col("c").alias("root")).distinct()).select(F.col("root").alias("c"), "artifact_id")
    return seen.select("root", F.col("at").alias("artifact_id")).union(chats.join(talk, "c").select("root", "artifact_id")).distinct()
