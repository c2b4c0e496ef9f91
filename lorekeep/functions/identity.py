"""Deterministic identities: base32 digests, artifact, event and burst ids, canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def base32_hex(digest: Column, length: int = 32) -> Column:
    """Lower-case base32 of the first 5 * length bits of a hex string: each 10 hex digits give 8 letters."""
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(-(-length // 8))]
    return F.translate(F.substring(F.concat(*groups), 1, length), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def digest_id(prefix: str, *parts: Column) -> Column:
    """prefix and the base32 of the first 20 bytes of the SHA-256 of the parts joined by NUL."""
    return F.concat(F.lit(prefix), base32_hex(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)))


def artifact_id(source: Column, instance: Column, entity: Column, external_id: Column) -> Column:
    return digest_id("art_", source, instance, entity, external_id)


def event_id(source: Column, instance: Column, entity: Column, external_id: Column, parent: Column, operation: Column, sequence: Column, updated_at: Column, version: Column, payload_sha256: Column) -> Column:
    """Replay-stable: ordered by sequence, else update time, else version, else payload; no delivery data."""
    some = lambda c: F.when(c != "", c)
    ordering = F.coalesce(sequence.cast("string"), some(updated_at), some(version), payload_sha256)
    return digest_id("evt_", source, instance, entity, external_id, parent, operation, ordering, payload_sha256)


def artifact_uri(entity: Column, artifact: Column) -> Column:
    return F.concat(F.lit("artifact://"), entity, F.lit("/"), artifact)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, non-ASCII kept."""
    return _CANONICAL(value)


def canonical_json(document: Column) -> Column:
    """A JSON text in canonical form; null stays null."""

    @F.pandas_udf("string")
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else canonical(json.loads(d)))

    return run(document)
