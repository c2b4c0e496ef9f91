"""Event batches applied to current state: ordering, tombstones, cascades, coverage, redaction, receipts.

Exact path: events that may depend on each other are folded in order. A cascade, a claim and a new
parent reach along the hierarchy only, so a unit is what hierarchy and events connect, mostly a
conversation with what it holds, and units are folded in parallel, however large a source instance
is. Records that no event reaches aren't read by the fold. Set path: batches of upserts only are
folded per key with grouped aggregates.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import BASE32, artifact_id, canonical
from ..staging import written

#: source_version prefixes of the tombstones that a later sighting revives.
DERIVED = ("coverage:", "cascade:")
EVENT = "batch_seq long, batch_id string, source string, source_instance string, observed_at timestamp, ordinal int, record string, operation string, entity string, external_id string, parent_entity string, parent_external_id string, source_sequence long, source_updated_at timestamp, source_version string, payload string, covered_from timestamp, covered_to timestamp"
STATE = "source string, source_instance string, artifact_id string, entity string, external_id string, parent_artifact_id string, payload string, payload_sha256 string, occurred_at string, source_sequence long, source_updated_at timestamp, source_version string, first_observed_at timestamp, last_observed_at timestamp, last_event_id string, deleted_at timestamp, redacted_at timestamp"
LOG = "source string, source_instance string, batch_id string, ordinal int, event_id string, artifact_id string, disposition string, derived boolean, source_version string, payload string, batch_seq long, dirty_before string, dirty_after string"
#: Rows that one task folds, units permitting, and the most levels that a closure may climb.
A_TASK, LEVELS = 20_000, 64
_NULL = hashlib.sha256(b"null").hexdigest()
_PAIRS = [a + b for a in BASE32 for b in BASE32]


def _id(prefix: str, *parts) -> str:
    raw = hashlib.sha256("\0".join(["" if p is None else str(p) for p in parts]).encode()).digest()[:20]
    bits = int.from_bytes(raw, "big")
    return prefix + "".join([_PAIRS[bits >> at & 1023] for at in range(150, -1, -10)])


def _utc(t) -> str | None:
    """A time as the canonical UTC text that identities use."""
    return None if t is None else pd.Timestamp(t).tz_localize(None).isoformat() + "+00:00"


class Instance:
    """State of one source instance, changed event by event."""

    def __init__(self, source: str, instance: str, state: list[dict], seen: dict[str, str | None]):
        self.source, self.instance = source, instance
        self.rows = {r["artifact_id"]: r for r in state}
        self.children: dict[str, set[str]] = {}
        for r in state:
            self._hang(r["artifact_id"], r["parent_artifact_id"])
        self.seen = dict(seen)  # event id -> payload, None once redacted
        self.keys: dict[tuple[str, str], str] = {}
        self.log: list[dict] = []
        self.undo: list = []  # how to take back what the current batch has done, last step first

    def keep(self, row: dict) -> None:
        """Remember a row as it is, before it changes."""
        before = dict(row)
        self.undo.append(lambda: (row.clear(), row.update(before)))

    def see(self, event: str, payload: str | None) -> None:
        known, before = event in self.seen, self.seen.get(event)
        self.undo.append(lambda: self.seen.update({event: before}) if known else self.seen.pop(event, None))
        self.seen[event] = payload

    def _hang(self, child: str, parent: str | None) -> None:
        if parent:
            self.children.setdefault(parent, set()).add(child)

    def _note(self, e: dict, event: str, artifact: str, disposition: str, derived: bool = False, version: str | None = None, payload: str | None = None, dirty: tuple = (None, None)) -> None:
        self.log.append({"source": self.source, "source_instance": self.instance, "batch_id": e["batch_id"], "ordinal": -1 if derived else e["ordinal"], "event_id": event, "artifact_id": artifact, "disposition": disposition, "derived": derived, "source_version": version if derived else e["source_version"], "payload": payload, "batch_seq": e["batch_seq"], "dirty_before": dirty[0], "dirty_after": dirty[1]})

    def key(self, entity: str, external: str) -> str:
        found = self.keys.get((entity, external))
        if found is None:
            found = self.keys[entity, external] = _id("art_", self.source, self.instance, entity, external)
        return found

    def parent_of(self, e: dict, artifact: str) -> str | None:
        if not e["parent_entity"]:
            return None
        parent = self.key(e["parent_entity"], e["parent_external_id"])
        if parent not in self.rows:
            raise ValueError(f"the parent of {e['external_id']} does not exist")
        at, hops = parent, 0
        while at:
            if at == artifact:
                raise ValueError(f"{e['external_id']} would be its own ancestor")
            at, hops = self.rows[at]["parent_artifact_id"] if at in self.rows else None, hops + 1
        return parent

    def reader(self, row: dict | None) -> str | None:
        """The record whose bursts hold a row: a message's or cue's parent, a conversation or transcript itself, a file's message's parent."""
        if row is None:
            return None
        if row["entity"] in ("message", "transcript-cue"):
            return row["parent_artifact_id"]
        if row["entity"] == "attachment":
            return self.rows[row["parent_artifact_id"]]["parent_artifact_id"] if row["parent_artifact_id"] in self.rows else None
        return row["artifact_id"] if row["entity"] in ("conversation", "transcript") else None

    @staticmethod
    def compare(row: dict, e: dict, sha: str) -> str:
        """newer, stale or conflict: by sequence, else time, else version; equal order needs an equal payload."""
        for name in ("source_sequence", "source_updated_at"):
            old, new = row[name], e[name]
            if old is not None and new is not None:
                if new != old:
                    return "newer" if new > old else "stale"
                return "newer" if sha == row["payload_sha256"] else "conflict"
        return "newer" if e["source_version"] == row["source_version"] and sha == row["payload_sha256"] else "conflict"

    def derived_tombstone(self, row: dict) -> bool:
        return row["deleted_at"] is not None and str(row.get("last_version") or row["source_version"] or "").startswith(DERIVED)

    def apply(self, e: dict) -> None:
        artifact = self.key(e["entity"], e["external_id"])
        parent = self.parent_of(e, artifact)
        value = json.loads(e["payload"]) if e["payload"] is not None else None
        payload = canonical(value)
        sha = hashlib.sha256(payload.encode()).hexdigest()
        ordering = e["source_sequence"] if e["source_sequence"] is not None else _utc(e["source_updated_at"]) or e["source_version"] or sha
        event = _id("evt_", self.source, self.instance, e["entity"], e["external_id"], parent, e["operation"], ordering, sha)
        row, upsert = self.rows.get(artifact), e["operation"] == "upsert"
        fields = {"payload": payload, "payload_sha256": sha, "occurred_at": (value or {}).get("occurred_at") if upsert else None}
        order = {c: e[c] for c in ("source_sequence", "source_updated_at", "source_version")}
        now, before = e["observed_at"], self.reader(row)
        if event in self.seen:
            revive = row is not None and row["redacted_at"] is None and upsert and self.seen[event] is not None and self.derived_tombstone(row) and now > row["deleted_at"]
            if revive:
                self.keep(row)
                row.update(fields, **order, parent_artifact_id=parent, last_observed_at=now, last_event_id=event, last_version=e["source_version"], deleted_at=None)
                self._hang(artifact, parent)
            self._note(e, event, artifact, "accepted" if revive else "unchanged", dirty=(before, self.reader(row)) if revive else (None, None))
            return
        if row is not None and row["redacted_at"] is not None and e["operation"] != "redact":
            self.see(event, None)
            self._note(e, event, artifact, "redacted")
            return
        if row is not None and e["operation"] != "redact":
            late = upsert and self.derived_tombstone(row) and now <= row["deleted_at"]
            state = "stale" if late else self.compare(row, e, sha)
            if state != "newer":
                self.see(event, payload)
                self._note(e, event, artifact, state, payload=payload)
                return
        if row is None:
            row = self.rows[artifact] = {"source": self.source, "source_instance": self.instance, "artifact_id": artifact, "entity": e["entity"], "external_id": e["external_id"], "parent_artifact_id": None, "payload": None, "payload_sha256": sha, "occurred_at": None, "first_observed_at": now, "deleted_at": None, "redacted_at": None}
            row.update(payload=payload)
            self.undo.append(lambda: self.rows.pop(artifact))
        else:
            self.keep(row)
        if upsert:
            row.update(fields, **order, parent_artifact_id=parent, deleted_at=None, redacted_at=None)
            disposition = "accepted"
        elif e["operation"] == "delete":
            row.update(order, parent_artifact_id=parent or row["parent_artifact_id"], deleted_at=now)
            disposition = "tombstone"
        else:
            for old in [x for x in self.log if x["artifact_id"] == artifact]:
                self.keep(old)
                old["payload"] = None
            for k in self.events_of(artifact):
                self.see(k, None)
            row.update(fields, **order, parent_artifact_id=parent or row["parent_artifact_id"], deleted_at=None, redacted_at=now)
            disposition = "redacted"
        row.update(last_observed_at=now, last_event_id=event, last_version=e["source_version"])
        self._hang(artifact, row["parent_artifact_id"])
        self.see(event, payload)
        self.owner = getattr(self, "owner", {})
        self.owner.setdefault(artifact, set()).add(event)
        self._note(e, event, artifact, disposition, payload=None if disposition == "redacted" else payload, dirty=(before, self.reader(row)))
        if disposition == "tombstone":
            self.cascade(e, artifact, event)

    def events_of(self, artifact: str) -> set[str]:
        return {x["event_id"] for x in self.log if x["artifact_id"] == artifact} | getattr(self, "owner", {}).get(artifact, set())

    def bury(self, e: dict, row: dict, version: str) -> str:
        event = _id("evt_", self.source, self.instance, row["entity"], row["external_id"], row["parent_artifact_id"], "delete", version, _NULL)
        self.keep(row)
        row.update(deleted_at=e["observed_at"], last_observed_at=e["observed_at"], last_event_id=event, last_version=version)
        self.see(event, None)
        self._note(e, event, row["artifact_id"], "tombstone", True, version, dirty=(self.reader(row),) * 2)
        return event

    def cascade(self, e: dict, artifact: str, cause: str) -> None:
        """Tombstone live descendants, level by level and by id; a dead one ends its branch."""
        level = [artifact]
        while level:
            level = sorted(c for p in level for c in self.children.get(p, ()) if self.rows[c]["parent_artifact_id"] == p and self.rows[c]["deleted_at"] is None and self.rows[c]["redacted_at"] is None)
            for c in level:
                self.bury(e, self.rows[c], f"cascade:{cause}")

    def cover(self, claim: dict, present: set[str]) -> None:
        """A complete claim removes the parent's live children of a kind that the batch doesn't hold."""
        parent = self.key(claim["parent_entity"], claim["parent_external_id"])
        if parent not in self.rows:
            raise ValueError("a complete coverage claim requires an existing parent")
        for c in sorted(self.children.get(parent, ())):
            row = self.rows[c]
            if row["parent_artifact_id"] != parent or row["entity"] != claim["entity"] or row["deleted_at"] is not None or row["redacted_at"] is not None or c in present or row["last_observed_at"] > claim["observed_at"]:
                continue
            at = pd.Timestamp(row["occurred_at"]).tz_localize(None) if row["occurred_at"] and pd.Timestamp(row["occurred_at"]).tz is None else pd.Timestamp(row["occurred_at"]).tz_convert(None) if row["occurred_at"] else None
            if (claim["covered_from"] is not None and (at is None or at < claim["covered_from"])) or (claim["covered_to"] is not None and (at is None or at > claim["covered_to"])):
                continue
            self.cascade(claim, c, self.bury(claim, row, f"coverage:{claim['batch_id']}"))

    def batch_or_nothing(self, events: list[dict], strict: bool) -> None:
        """Apply a batch; one that breaks the hierarchy is an error or leaves no trace but a log row that says why."""
        logged = len(self.log)
        self.undo = []
        try:
            self.batch(events)
        except ValueError as why:
            if strict:
                raise
            for step in reversed(self.undo):
                step()
            del self.log[logged:]
            self._note(events[0], f"batch:{events[0]['batch_id']}", None, "rejected", payload=str(why))

    def batch(self, events: list[dict]) -> None:
        claims = [e for e in events if e["record"] == "coverage"]
        own = [e for e in events if e["record"] == "event"]
        for e in own:
            self.apply(e)
        done = set()
        for c in claims:
            key = tuple(c[k] for k in ("parent_entity", "parent_external_id", "entity", "covered_from", "covered_to"))
            if key not in done:
                done.add(key)
                parent = self.key(c["parent_entity"], c["parent_external_id"])
                present = {a for e in own if e["entity"] == c["entity"] and self.rows.get(a := self.key(e["entity"], e["external_id"]), {}).get("parent_artifact_id") == parent}
                self.cover(c, present)


def _plain(pdf: pd.DataFrame) -> list[dict]:
    columns = [[None] * len(pdf) if pdf[c].isna().all() else pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns]
    rows = [dict(zip(pdf.columns, r)) for r in zip(*columns)]
    for c in ("source_sequence", "ordinal", "batch_seq"):
        if c in pdf.columns and not pdf[c].isna().all():
            for r in rows:
                if r[c] is not None:
                    r[c] = int(r[c])
    return rows


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def apply_events(events: DataFrame, state: DataFrame | None = None, log: DataFrame | None = None, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Apply batches in order; returns the new state (STATE) and the log of dispositions (LOG).

    events: EVENT, one row per event or complete coverage claim (record 'event' or 'coverage').
    state and log: what earlier batches left. A batch that breaks the hierarchy
    is an error; without strict it is rejected as a whole, with one log row of disposition
    'rejected' and the reason as its payload, while other batches go on.
    """
    spark = events.sparkSession
    reach, labels, total = hierarchy_units(events, state, together=not strict)
    bare = state is None and log is None
    state = spark.createDataFrame([], STATE) if state is None else state
    log = spark.createDataFrame([], LOG) if log is None else log
    names, logged = _columns(STATE), _columns(LOG)
    both = names + [f"log_{c}" for c in logged]
    out = ", ".join(["kind string", STATE] + [f"log_{x}" for x in LOG.split(", ")])

    def run(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        rows = _plain(old)
        known = [r for r in rows if r["kind"] == "state"]
        past = [{c: r[f"log_{c}"] for c in logged} for r in rows if r["kind"] == "log"]
        versions = {r["event_id"]: r["source_version"] for r in past}
        for r in known:
            r["last_version"] = versions.get(r["last_event_id"], r["source_version"])
        inst = Instance(key[0], key[1], known, {r["event_id"]: r["payload"] for r in past})
        inst.owner = {}
        for r in past:
            inst.owner.setdefault(r["artifact_id"], set()).add(r["event_id"])
        events_ = sorted(_plain(new), key=lambda e: (e["batch_seq"], e["ordinal"]))
        done: dict[str, list[dict]] = {}
        for e in events_:
            done.setdefault(e["batch_id"], []).append(e)
        for batch in done.values():
            inst.batch_or_nothing(batch, strict)
        gone = {x["artifact_id"] for x in inst.rows.values() if x["redacted_at"] is not None}  # rejected rows have no artifact
        now, told_ = list(inst.rows.values()), past + inst.log
        final = {"kind": ["state"] * len(now) + ["log"] * len(told_)}
        final |= {c: [r.get(c) for r in now] + [None] * len(told_) for c in names}
        final |= {f"log_{c}": [None] * len(now) + [None if c == "payload" and r["artifact_id"] in gone else r[c] for r in told_] for c in logged}
        return pd.DataFrame(final, columns=["kind", *both], dtype=object)

    parts = max(1, -(-total // A_TASK))
    part = lambda unit: F.pmod(F.xxhash64(unit), F.lit(parts)).cast("int").alias("part")
    unit = F.coalesce("label", "v")
    # what an event names last is in its unit, and mostly the unit itself: only units of several parents are looked up
    dealt = events.withColumn("v", _named()[1]).join(labels.toDF("v", "label"), "v", "left").select(*events.columns, part(unit))
    known = reach.select("u", "v").join(labels.toDF("v", "label"), "v", "left").select("u", part(unit))
    near, far = _by_node(state).join(known, "u").drop("u"), _by_node(state).join(reach.select("u"), "u", "left_anti").select(names)
    told, untold = _by_node(log).join(known, "u").drop("u"), _by_node(log).join(reach.select("u"), "u", "left_anti").select(logged)
    left = near.select(F.lit("state").alias("kind"), *names, *[F.lit(None).cast(t.split(" ")[1]).alias(f"log_{t.split(' ')[0]}") for t in LOG.split(", ")], "part")
    past = told.select(F.lit("log").alias("kind"), F.col("source"), F.col("source_instance"), *[F.lit(None).cast(t.split(" ")[1]).alias(t.split(" ")[0]) for t in STATE.split(", ")[2:]], *[F.col(c).alias(f"log_{c}") for c in logged], "part")
    keys = ["source", "source_instance", "part"]
    # written once, since state and log are both read from it
    tasks = parts // 4  # so that a task can sort what it gets
    old = left.unionByName(past) if not bare else spark.createDataFrame([], left.schema)
    sides = [d.repartition(tasks, *keys) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else d for d in (dealt, old)]
    done = written(sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInPandas(run, out))
    if bare:
        far, untold = state, log
    return done.where("kind = 'state'").select(names).unionByName(far), done.where("kind = 'log'").select(*[F.col(f"log_{c}").alias(c) for c in logged]).unionByName(untold)


def _node(artifact: Column) -> Column:
    """64 bits for an artifact id. Records that share them are folded together, which changes nothing."""
    return F.when(artifact.isNotNull(), F.xxhash64(artifact))


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.withColumn("u", _node(F.col("artifact_id")))


def _named() -> tuple[Column, Column]:
    """Nodes of the record that an event is about and of the parent that it names, else of the record again; a claim is about its parent."""
    key = lambda entity, external: _node(artifact_id(F.col("source"), F.col("source_instance"), F.col(entity), F.col(external)))
    parent = key("parent_entity", "parent_external_id")
    own = F.when(F.col("record") == "event", key("entity", "external_id")).otherwise(parent)
    return own, F.when(F.col("parent_entity").isNotNull(), parent).otherwise(own)


def hierarchy_units(events: DataFrame, state: DataFrame | None, *, together: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """What events connect: (u, v), a record that they name or reach and one of the nodes that it hangs on, once a record;
    (u, label), the unit of such a node v where it isn't v itself; and the number of events and records.

    Old and new parents connect, so a record that moves brings both trees into one unit. together:
    a batch connects all that it names, since it is accepted or rejected as a whole.
    """
    own, parent = _named()
    edges = events.select(own.alias("u"), parent.alias("v"), F.lit(1).alias("n"), "batch_id")
    if together:
        edges = edges.union(edges.select("u", F.xxhash64(F.lit("batch:"), "batch_id"), F.lit(0), "batch_id"))
    edges = edges.select("u", "v", "n")
    if state is not None:
        edges = written(edges.groupBy("u", "v").agg(F.sum("n").alias("n")))
        edges = edges.union(reached(edges.select("u", "v"), state.select(_node(F.col("artifact_id")).alias("u"), _node(F.col("parent_artifact_id")).alias("v"))).select("u", "v", F.lit(0)))
    # a record hangs on its least node p, and its other nodes do so too
    pairs = written(edges.repartition("u").groupBy("u", "v").agg(F.sum("n").alias("n")).withColumn("p", F.min("v").over(W.partitionBy("u"))))
    first = pairs.where("v = p").select("u", "v")
    # records on which nothing hangs follow their node: the graph is of the others only
    inner = first.where("u <> v").join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    links = written(inner.union(pairs.where("v <> p").select("v", "p")).distinct())
    labels = smallest_reachable(written(links.union(links.select("v", "u")).distinct())).where("u <> label")
    events_, records = pairs.agg(F.sum("n"), F.count_if(F.col("v") == F.col("p"))).first()
    return first, written(labels), (events_ or 0) + records


def reached(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Edges (u, v) of the tree (u child, v parent or null; a root's edge leads to itself) that nodes of edges lead to, up and down."""
    seen = written(edges.select("u").union(edges.select("v")).distinct())
    frontier, out = seen, None
    for _ in range(LEVELS):  # up to the roots and down to the leaves of all that events name
        up = tree.join(frontier.toDF("u"), "u", "left_semi").select("u", F.coalesce("v", "u").alias("v"))
        down = tree.join(frontier.toDF("v"), "v", "left_semi").select("u", "v")
        more = written(up.union(down).distinct())
        out = more if out is None else out.union(more)
        frontier = written(more.select("u").union(more.select("v")).distinct().join(seen, "u", "left_anti"))
        if frontier.isEmpty():
            return out
        seen = seen.union(frontier)
    raise ValueError(f"the hierarchy has more than {LEVELS} levels")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(u, label): for each node the smallest node that edges (u, v), which go both ways, connect it with.

    A round lets each node follow its least neighbour, if that is smaller, and that one's choice
    again, and joins what met into one node: only nodes smaller than all their neighbours stay, so
    the graph shrinks by a factor each round, long paths too.
    """
    labels, left = None, edges.where("u <> v")
    alone = edges.select("u").distinct()
    while labels is None or not left.isEmpty():
        least = left.groupBy("u").agg(F.min("v").alias("near")).select("u", F.least("u", "near").alias("p"))
        least = written(least.join(least.select(F.col("u").alias("p"), F.col("p").alias("far")), "p").select("u", F.col("far").alias("p")))
        before = alone.select("u", F.col("u").alias("label")) if labels is None else labels
        labels = written(before.join(least.toDF("label", "p"), "label", "left").select("u", F.coalesce("p", "label").alias("label")))
        joined = left.join(least.toDF("u", "pu"), "u").join(least.toDF("v", "pv"), "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        left = written(joined.distinct())
    return labels


def new_batches(manifests: DataFrame, ledger: DataFrame) -> DataFrame:
    """manifests (batch_id, sha256) not yet in the ledger; the same id with another hash is an error."""
    both = manifests.join(ledger.select("batch_id", F.col("sha256").alias("__old")), "batch_id", "left")
    checked = F.when(F.col("__old") != F.col("sha256"), F.raise_error(F.concat(F.lit("batch differs from its receipt: "), "batch_id")).cast("string")).otherwise(F.col("__old"))
    return both.withColumn("__old", checked).where("__old is null").drop("__old")


def receipts(log: DataFrame) -> DataFrame:
    """One row a batch: accepted, unchanged, stale, conflict, tombstone, redacted, derived, artifacts_changed."""
    count = lambda d: F.count_if((F.col("disposition") == d) & ~F.col("derived")).alias(d)
    changed = F.count_distinct(F.when(F.col("disposition").isin("accepted", "tombstone", "redacted"), F.col("artifact_id"))).alias("artifacts_changed")
    return log.groupBy("batch_id").agg(*[count(d) for d in ("accepted", "unchanged", "stale", "conflict", "tombstone", "redacted")], F.count_if("derived").alias("derived"), changed)


# -- set-based path -------------------------------------------------------------------------------


def dedupe(events: DataFrame, key: str = "event_id", order: str = "ordinal") -> DataFrame:
    """The first event of each id."""
    return events.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__k = 1").drop("__k")


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest event of each key, by partial aggregation of a struct in the order's columns."""
    rest = [c for c in events.columns if c not in (*keys, *order)]
    return events.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__x")).select(*keys, "__x.*").select(events.columns)


def dispositions(events: DataFrame, keys: list[str], position: str, order: str, payload: str) -> DataFrame:
    """events with disposition, for upserts only: accepted, stale, conflict or unchanged.

    In arrival order (position), an event is stale below the greatest order seen so far, and at
    that order a conflict if its payload differs from the one accepted first there, else unchanged.
    """
    w = W.partitionBy(*keys).orderBy(position)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    e = events.withColumn("__high", F.max(order).over(before))
    at = W.partitionBy(*keys, order).orderBy(position)
    e = e.withColumn("__first", F.first(payload).over(at))
    d = F.when(F.col("__high").isNull() | (F.col(order) > F.col("__high")), "accepted").when(F.col(order) < F.col("__high"), "stale").when(F.col(payload) == F.col("__first"), "unchanged").otherwise("conflict")
    return e.withColumn("disposition", d).drop("__high", "__first")


def covered(children: DataFrame, present: DataFrame, claims: DataFrame) -> DataFrame:
    """Children that complete claims remove: child, parent, occurred_at columns of children.

    claims: parent, observed_at, covered_from, covered_to. A child observed after the snapshot stays.
    """
    c = children.join(claims, "parent").where("last_observed_at <= observed_at and (covered_from is null or occurred_at >= covered_from) and (covered_to is null or occurred_at <= covered_to)")
    return c.join(present.select("child"), "child", "left_anti").select(children.columns).distinct()


def dirty_parents(log: DataFrame, state: DataFrame) -> DataFrame:
    """Present parents of records whose events were accepted; change_feed() knows former ones too."""
    changed = log.where("disposition in ('accepted', 'tombstone', 'redacted')").select("artifact_id").distinct()
    return state.join(changed, "artifact_id", "left_semi").select(F.coalesce("parent_artifact_id", "artifact_id").alias("parent_artifact_id")).distinct()


def change_feed(log: DataFrame, after: int | None = None) -> DataFrame:
    """(parent_artifact_id, change): conversations and transcripts whose bursts may differ since batch `after`.

    Old and new parents of a record that moved, and the conversation of a message that got a file.
    change is the number of the last batch that did so: what a reader keeps to ask for later ones.
    """
    rows = log if after is None else log.where(F.col("batch_seq") > after)
    parents = rows.select("batch_seq", F.explode(F.array("dirty_before", "dirty_after")).alias("parent_artifact_id")).where("parent_artifact_id is not null")
    return parents.groupBy("parent_artifact_id").agg(F.max("batch_seq").alias("change"))


def parse_time(value: str | None) -> datetime | None:
    return None if value is None else pd.Timestamp(value).to_pydatetime()
