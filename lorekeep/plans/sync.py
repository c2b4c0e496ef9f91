"""Build one generation: notes, bursts and graph together, published by one pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import embed
from ..operators.bursts import group_bursts
from ..operators.graph import acceptable, graph_health
from ..operators.maintenance import diff, keep_known
from ..sources.store import Store
from ..sources.vault import chunk, parse
from .recall import Notes


def changed_documents(raw: DataFrame, previous: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(documents, states): notes whose content is unchanged are taken from the previous generation.

    raw: as vault.scan() gives. Of two notes with one id, the known path keeps it.
    """
    docs = parse(raw)
    if previous is None:
        return keep_known(docs, docs.select("memory_id", "path").limit(0), "memory_id").where("not rejected").drop("rejected"), docs.select("path", F.lit("added").alias("state"))
    known = keep_known(docs, previous.select("memory_id", "path"), "memory_id").where("not rejected").drop("rejected")
    states = diff(previous.select("path", "mtime", "hash"), known.select("path", "mtime", "hash"))
    same = previous.join(states.where("state = 'unchanged'"), "path", "left_semi")
    new = known.join(states.where("state in ('added', 'changed')"), "path", "left_semi")
    return same.unionByName(new), states


def sync(store: Store, raw: DataFrame, records: DataFrame | None = None, counter: int = 0, keep: int = 3) -> str:
    """Publish a generation of all layers; a layer that fails leaves the previous generation current."""
    gen = store.current()
    previous = store.table(gen, "docs") if gen else None
    docs, _ = changed_documents(raw, previous)
    notes = Notes.build(docs, chunk(docs))
    tables = notes.tables()
    if records is not None:
        bursts = group_bursts(records)
        tables["bursts"] = bursts
        tables["burst_vectors"] = bursts.where("embed").select(F.col("burst_id").alias("id"), embed(F.col("text"), stored=True).alias("v"))
    before = store.manifest(gen)["tables"]["nodes"] if gen else 0

    def check(made: dict[str, DataFrame]) -> None:
        if not acceptable(graph_health(made["nodes"], made["edges"]), before).first().acceptable:
            raise ValueError("the graph is unsound or has shrunk too far")

    new = store.publish(tables, {"counter": counter}, check)
    store.retain(keep)
    return new
