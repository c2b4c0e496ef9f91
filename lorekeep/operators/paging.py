"""Ordered keyset paging with opaque cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("occurred_key", "artifact_id")


def keyed(rows: DataFrame) -> DataFrame:
    """rows with occurred_key: the time as UTC text, '' for none, so that untimed records come first."""
    return rows.withColumn("occurred_key", F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")))


def cursor(occurred_key: str, artifact_id: str) -> str:
    raw = json.dumps([occurred_key, artifact_id], separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def position(text: str) -> tuple[str, str]:
    """The key of a cursor; anything else is an error."""
    try:
        key, artifact = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if not isinstance(key, str) or not isinstance(artifact, str):
            raise ValueError
    except (ValueError, TypeError) as e:
        raise ValueError("the cursor is not valid") from e
    return key, artifact


def beyond(key: tuple[str, str], later: bool) -> Column:
    a, b = F.col(KEY[0]), F.col(KEY[1])
    return ((a > key[0]) | ((a == key[0]) & (b > key[1]))) if later else ((a < key[0]) | ((a == key[0]) & (b < key[1])))


def after(rows: DataFrame, key: tuple[str, str] | None, limit: int) -> DataFrame:
    """The next page: a filter on the key and a bounded top, so no offset is counted off."""
    rows = keyed(rows)
    return (rows if key is None else rows.where(beyond(key, True))).orderBy(*KEY).limit(limit)


def before(rows: DataFrame, key: tuple[str, str], limit: int) -> DataFrame:
    """The page before, in ascending order."""
    return keyed(rows).where(beyond(key, False)).orderBy(*[F.desc(c) for c in KEY]).limit(limit).orderBy(*KEY)


def around(rows: DataFrame, key: tuple[str, str], limit: int) -> DataFrame:
    """The record of a key with limit // 2 before it and the rest after it; focus marks it."""
    half = limit // 2
    focus = keyed(rows).where((F.col(KEY[0]) == key[0]) & (F.col(KEY[1]) == key[1]))
    page = before(rows, key, half).unionByName(focus).unionByName(after(rows, key, limit - half - 1))
    return page.withColumn("focus", (F.col(KEY[0]) == key[0]) & (F.col(KEY[1]) == key[1])).orderBy(*KEY)


def cursors(page: list, key: tuple[str, str], limit: int) -> tuple[str | None, str | None]:
    """(previous, next) of an around page: a cursor only where that half is full."""
    half = limit // 2
    earlier = [r for r in page if (r[KEY[0]], r[KEY[1]]) < key]
    later = [r for r in page if (r[KEY[0]], r[KEY[1]]) > key]
    return (cursor(*(earlier[0][c] for c in KEY)) if earlier and len(earlier) == half else None, cursor(*(later[-1][c] for c in KEY)) if later and len(later) == limit - half - 1 else None)


def text_window(text: Column, phrase: Column, size: int = 5000) -> Column:
    """At most size characters of a text, centred on a phrase if it occurs, else from the start."""
    at = F.coalesce(F.instr(F.lower(text), F.lower(phrase)), F.lit(0))
    start = F.greatest(F.lit(1), F.least(at - F.floor((size - F.length(phrase)) / 2), F.length(text) - size + 1)).cast("int")
    return F.when(F.length(text) <= size, text).when(at == 0, F.substring(text, 1, size)).otherwise(F.substring(text, start, F.lit(size)))


def by_id(rows: DataFrame, wanted: DataFrame, key: str = "artifact_id") -> DataFrame:
    """wanted ids with their rows; found is false for an id that no row has."""
    return wanted.select(key).distinct().join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
