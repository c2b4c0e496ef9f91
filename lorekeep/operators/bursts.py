"""Bursts: runs of messages of one author in one parent, bounded in gap, number and length."""

from __future__ import annotations

import hashlib
import re
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import canonical
from ..functions.text import IDENTIFIER

# Bounds of a burst, least length to be embedded.
RECORDS, CHARACTERS, GAP, LEAST = 8, 2000, timedelta(minutes=15), 200
_IDENTIFIER = re.compile("(?i)" + IDENTIFIER.removeprefix("(?iU)"))
FIELDS = "burst_id string, source string, source_instance string, entity string, parent_artifact_id string, parent_title string, author_id string, author_name string, first_artifact_uri string, last_artifact_uri string, started_at timestamp, ended_at timestamp, record_count int, text string, embed boolean"


def author_key(author_id: Column, author_name: Column) -> Column:
    """By id, or else by name without regard to case and spacing."""
    name = F.lower(F.trim(F.regexp_replace(F.coalesce(author_name, F.lit("")), r"\s+", " ")))
    own = F.trim(F.coalesce(author_id, F.lit("")))
    return F.when(own != "", F.concat(F.lit("id:"), own)).otherwise(F.concat(F.lit("name:"), name))


def line_of(author_name: str, author_id: str, text: str) -> str:
    name, words = author_name or author_id, " ".join(text.split())
    return f"{name}: {words}" if name else words


def rendered(rows: list[dict]) -> str:
    """Title, participants in order of appearance, one line a record; empty lines are left out."""
    names = dict.fromkeys(n.strip() for r in rows for n in r["participant_names"] if n.strip())
    title = (rows[0]["parent_title"] or "").strip()
    lines = [title, f"Participants: {', '.join(names)}" if names else ""] + [line_of(r["author_name"], r["author_id"], r["text"]) for r in rows]
    return "\n".join(x for x in lines if x)


def worth_embedding(rows: list[dict], text: str) -> bool:
    """Not all system messages, and long enough or with an identifier, a reaction or an attachment."""
    if all(r["classification"].casefold() == "system" for r in rows):
        return False
    return len(text) >= LEAST or any(r["reactions"] or r["attachment_link"] for r in rows) or bool(_IDENTIFIER.search("\n".join(r["text"] for r in rows)))


def burst_row(rows: list[dict]) -> dict:
    first, last = rows[0], rows[-1]
    text = rendered(rows)[:CHARACTERS]
    identity = canonical({"parent": first["parent_artifact_id"], "author": first["author_key"], "first": first["artifact_id"], "last": last["artifact_id"], "text": text})
    same = {c: first[c] for c in ("source", "source_instance", "entity", "parent_artifact_id", "parent_title", "author_id", "author_name")}
    return same | {
        "burst_id": "burst_" + hashlib.sha256(identity.encode()).hexdigest()[:32], "first_artifact_uri": first["artifact_uri"], "last_artifact_uri": last["artifact_uri"],
        "started_at": first["occurred_at"], "ended_at": last["occurred_at"], "record_count": len(rows), "text": text, "embed": worth_embedding(rows, text),
    }


def fold(batches):
    """Task: records by parent and in order to bursts.

    A burst ends where parent or author changes, after a gap of more than 15 minutes, at 8 records
    and before its text would exceed 2,000 characters. Only the open burst is held, however long a
    conversation is.
    """
    columns, held, rows = [f.split(" ")[0] for f in FIELDS.split(", ")], [], []
    for pdf in batches:
        for r in pdf.to_dict("records"):
            r["participant_names"], r["reactions"] = list(r["participant_names"]), list(r["reactions"])
            if held:
                last = held[-1]
                same = r["parent_artifact_id"] == last["parent_artifact_id"] and r["author_key"] == last["author_key"] and r["occurred_at"] - last["occurred_at"] <= GAP
                if not same or len(held) >= RECORDS or len(rendered([*held, r])) > CHARACTERS:
                    rows.append(burst_row(held))
                    held = []
            held.append(r)
        if rows:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if held:
        yield pd.DataFrame([burst_row(held)], columns=columns)


def group_bursts(records: DataFrame) -> DataFrame:
    """Bursts of live records: deleted and redacted ones are left out, missing texts and lists are empty.

    Records are sorted once, by parent and time, and folded as they stream by.
    """
    texts = ("parent_artifact_id", "parent_title", "source", "source_instance", "entity", "author_id", "author_name", "text", "classification", "artifact_uri")
    empty = F.array().cast("array<string>")
    r = records.where("not coalesce(deleted, false) and not coalesce(redacted, false) and occurred_at is not null")
    r = r.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {c: F.coalesce(c, empty) for c in ("participant_names", "reactions")} | {"attachment_link": F.coalesce("attachment_link", F.lit(False))})
    r = r.withColumn("author_key", author_key(F.col("author_id"), F.col("author_name"))).drop("deleted", "redacted")
    return r.repartition("parent_artifact_id").sortWithinPartitions("parent_artifact_id", "occurred_at", "artifact_id").mapInPandas(fold, FIELDS)


def simple_bursts(records: DataFrame) -> DataFrame:
    """Bursts without titles and participants, by built-in functions: parent, island, part, first, last, n, chars.

    records: parent, author, at (timestamp), id, line (the rendered line). The fold over an
    island's records runs as an aggregate over its sorted array.
    """
    w = W.partitionBy("parent").orderBy("at", "id")
    new = F.coalesce((F.lag("author").over(w) != F.col("author")) | (F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > int(GAP.total_seconds() * 1e6)), F.lit(True))
    r = records.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lists = r.groupBy("parent", "island").agg(F.array_sort(F.collect_list(F.struct("at", "id", F.char_length("line").alias("n")))).alias("rows"))
    kind = "struct<done:array<struct<first:bigint,last:bigint,n:int,chars:int>>,first:bigint,last:bigint,n:int,chars:int>"
    start = F.from_json(F.lit('{"done":[],"n":0,"chars":0}'), kind)

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] >= RECORDS) | (s["chars"] + 1 + x["n"] > CHARACTERS)
        closed = F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), s["n"].alias("n"), s["chars"].alias("chars"))))
        fresh = F.struct(F.when(s["n"] > 0, closed).otherwise(s["done"]).alias("done"), x["id"].alias("first"), x["id"].alias("last"), F.lit(1).alias("n"), x["n"].cast("int").alias("chars"))
        more = F.struct(s["done"].alias("done"), s["first"].alias("first"), x["id"].alias("last"), (s["n"] + 1).alias("n"), (s["chars"] + 1 + x["n"]).cast("int").alias("chars"))
        return F.when((s["n"] == 0) | full, fresh).otherwise(more).cast(kind)

    def finish(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), s["n"].alias("n"), s["chars"].alias("chars"))))

    done = lists.select("parent", "island", F.posexplode(F.aggregate("rows", start, step, finish)).alias("part", "b"))
    return done.select("parent", "island", "part", "b.first", "b.last", "b.n", "b.chars")


def refresh_bursts(previous: DataFrame, current: DataFrame) -> DataFrame:
    """current (burst_id, digest, ...) with state: reused, changed or added; and removed rows of previous."""
    both = previous.select("burst_id", F.col("digest").alias("old")).join(current.select("burst_id", F.col("digest").alias("new")), "burst_id", "full")
    return both.select("burst_id", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "reused").otherwise("changed").alias("state"))
