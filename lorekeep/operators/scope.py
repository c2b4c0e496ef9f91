"""Scope predicates, identity lookup and mentioned documents."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TICKET
from .lexical import top


@dataclass
class Scope:
    """Optional predicates on notes; an empty status means any."""

    source_id: str | None = None
    root_scope: str | None = None
    status: str = "active"
    path_prefix: str | None = None
    repository: str | None = None
    project: str | None = None
    ticket: str | None = None

    def predicate(self) -> Column:
        """Holds before any ranking. Names match without regard to case."""
        out = F.lit(True)
        for name in ("source_id", "root_scope", "status"):
            if value := getattr(self, name):
                out = out & (F.col(name) == value)
        if self.path_prefix:
            out = out & F.startswith(F.lower("path"), F.lit(self.path_prefix.rstrip("/").lower()))
        for value, names in ((self.repository, "repos"), (self.project, "projects"), (self.ticket, "identifiers")):
            if value:
                out = out & named(names, value)
        return out


def named(array: str, value: str) -> Column:
    """An element, the scope's id or a part of the path equals the value."""
    v = value.lower()
    return F.exists(array, lambda x: F.lower(x) == v) | (F.lower("scope_id") == v) | F.contains(F.lower("path"), F.lit(f"/{v}/"))


def planned_ticket(query: Column) -> Column:
    """The first ticket-like token of a query, or null: it becomes the ticket scope if none is given."""
    found = F.regexp_extract(query, TICKET, 1)
    return F.when(found != "", found)


@dataclass
class ArtifactScope:
    source: str | None = None
    source_instance: str | None = None
    entities: tuple[str, ...] = ()
    parent: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None

    def _common(self) -> Column:
        out = F.lit(True)
        for column, value in (("source", self.source), ("source_instance", self.source_instance), ("parent_artifact_id", self.parent)):
            if value is not None:
                out = out & (F.col(column) == value)
        return out & F.col("entity").isin(*self.entities) if self.entities else out

    def records(self) -> Column:
        """Live records; a record without a time is out as soon as a bound is set."""
        out = self._common() & live()
        if self.date_from is not None:
            out = out & (F.col("occurred_at") >= F.lit(self.date_from))
        if self.date_to is not None:
            out = out & (F.col("occurred_at") <= F.lit(self.date_to))
        return out

    def bursts(self) -> Column:
        """Bursts that fit entirely into the bounds."""
        out = self._common()
        if self.date_from is not None:
            out = out & (F.col("started_at") >= F.lit(self.date_from))
        if self.date_to is not None:
            out = out & (F.col("ended_at") <= F.lit(self.date_to))
        return out


def live() -> Column:
    return F.col("deleted_at").isNull() & F.col("redacted_at").isNull()


def check_filters(scope: Scope | None, artifacts: ArtifactScope | None) -> str:
    """Which provider a request selects; both kinds of filters together are an error."""
    if scope is not None and artifacts is not None:
        raise ValueError("note filters and artifact filters exclude each other")
    return "notes" if scope is not None else "artifacts" if artifacts is not None else "both"


def identity_lookup(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The document that a query names exactly, if any: query_id, memory_id, path.

    By id, then path, then title; among equals the shortest path, then the id.
    """
    q = queries.select("query_id", F.trim("query").alias("q"))
    keys = F.array(F.struct(F.lit(0).alias("p"), F.col("memory_id").alias("key")), F.struct(F.lit(1).alias("p"), F.lower("path").alias("key")), F.struct(F.lit(2).alias("p"), F.lower("title").alias("key")))
    d = docs.select("memory_id", "path", F.explode(keys).alias("k")).select("memory_id", "path", "k.p", "k.key")
    asked = q.select("query_id", F.explode(F.array(F.struct(F.lit(True).alias("exact"), F.col("q").alias("key")), F.struct(F.lit(False).alias("exact"), F.lower("q").alias("key")))).alias("k")).select("query_id", "k.exact", "k.key")
    hits = asked.join(d, "key").where(F.col("exact") == (F.col("p") == 0))
    return top(hits, [F.asc("p"), F.asc(F.length("path")), F.asc("memory_id")], 1).select("query_id", "memory_id", "path")


def mentioned(queries: DataFrame, docs: DataFrame, least: int = 4) -> DataFrame:
    """Documents whose id, path, stem or title of 4 characters or more occurs in the query.

    query_id, memory_id, at, matched, position: ordered by first place, longest match, title. The
    batch of queries is a stated set that meets every document's names.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    names = docs.select("memory_id", "title", F.explode(F.array_distinct(F.array(F.lower("memory_id"), F.lower("path"), F.lower(stem), F.lower("title")))).alias("name")).where(F.length("name") >= least)
    hits = names.join(queries.select("query_id", F.lower("query").alias("q")), F.expr("contains(q, name)"))
    hits = hits.select("query_id", "memory_id", "title", F.expr("instr(q, name)").alias("at"), F.length("name").alias("matched"))
    best = hits.groupBy("query_id", "memory_id", "title").agg(F.min("at").alias("at"), F.max("matched").alias("matched"))
    return top(best, [F.asc("at"), F.desc("matched"), F.asc("title"), F.asc("memory_id")], 2**31 - 1, "position").drop("title")
