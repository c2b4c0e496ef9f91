from datetime import datetime, timedelta

import pytest

from lorekeep.operators.bursts import group_bursts, refresh_bursts

SCHEMA = "artifact_id string, artifact_uri string, parent_artifact_id string, parent_title string, source string, source_instance string, entity string, author_id string, author_name string, participant_names array<string>, reactions array<string>, occurred_at timestamp, text string, classification string, attachment_link boolean, deleted boolean, redacted boolean"
T0 = datetime(2024, 1, 1, 10)


def rec(i, minute, author="a", parent="P", text="hello", **more):
    row = dict(artifact_id=f"m{i:02d}", artifact_uri=f"artifact://message/m{i:02d}", parent_artifact_id=parent, parent_title="", source="s", source_instance="d", entity="message", author_id=author, author_name="", participant_names=[], reactions=[], occurred_at=T0 + timedelta(minutes=minute), text=text, classification="", attachment_link=False, deleted=False, redacted=False)
    return row | more


def counts(spark, rows):
    return [r.record_count for r in group_bursts(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).orderBy("parent_artifact_id", "started_at", "first_artifact_uri").collect()]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([rec(1, 0), rec(2, 5), rec(3, 6, "b")], [2, 1]),
        ([rec(1, 0), rec(2, 16)], [1, 1]),
        ([rec(1, 0), rec(2, 15)], [2]),
        ([rec(1, 0), rec(2, 1, parent="Q"), rec(3, 2)], [2, 1]),
        ([rec(1, 0, "", author_name="Ann"), rec(2, 1, "", author_name="Bob")], [1, 1]),
        ([rec(1, 0, "", author_name=" ANN  x"), rec(2, 1, "", author_name="ann X")], [2]),
        ([rec(i, i) for i in range(9)], [8, 1]),
        ([rec(1, 0, text="x" * 1200), rec(2, 1, text="y" * 1200)], [1, 1]),
        ([rec(1, 0), rec(2, 1, deleted=True), rec(3, 2, redacted=True)], [1]),
    ],
)
def test_bounds(spark, rows, want):
    assert counts(spark, rows) == want


def test_text_and_embedding(spark):
    def first(*rows):
        return group_bursts(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).first()

    assert len(first(rec(1, 0, text="z" * 2500)).text) == 2000
    assert first(rec(1, 0, parent_title=" T ", participant_names=["Ann", "Bob", "Ann"], author_name="Ann", text="a \n b")).text == "T\nParticipants: Ann, Bob\nAnn: a b"
    assert not first(rec(1, 0)).embed
    assert first(rec(1, 0, text="see ABC-12")).embed and first(rec(1, 0, reactions=["+1"])).embed and first(rec(1, 0, attachment_link=True)).embed
    assert first(rec(1, 0, text="w" * 250)).embed and not first(rec(1, 0, text="w" * 250, classification="System")).embed
    a, b = first(rec(1, 0)), first(rec(1, 0))
    assert a.burst_id == b.burst_id and a.burst_id.startswith("burst_") and len(a.burst_id) == 38


def test_many_records_stream_by(spark):
    """100 conversations of 1,000 messages and 100 transcripts of 500 cues, a second apart, give 18,800 bursts."""
    from pyspark.sql import functions as F

    n = spark.range(150_000).select((F.col("id") % 200).alias("p"), F.floor(F.col("id") / 200).alias("k")).where("p < 100 or k < 500")
    n = n.unionByName(spark.range(25_000).select((F.col("id") % 100).alias("p"), (F.floor(F.col("id") / 100) + 750).alias("k")))
    text, none = F.lit(""), F.array().cast("array<string>")
    cols = {"artifact_id": F.lpad(F.col("k").cast("string"), 6, "0"), "artifact_uri": F.col("k").cast("string"), "parent_artifact_id": F.col("p").cast("string"), "author_id": F.concat(F.lit("u"), "p"), "text": F.lit("a line"), "occurred_at": F.timestamp_seconds(F.col("k") + 1_700_000_000), "participant_names": none, "reactions": none, "attachment_link": F.lit(False), "deleted": F.lit(False), "redacted": F.lit(False)}
    rows = n.select([cols.get(c.split(" ")[0], text).alias(c.split(" ")[0]) for c in SCHEMA.split(", ")])
    got = group_bursts(rows).groupBy("parent_artifact_id").agg(F.count("*").alias("bursts"), F.sum("record_count").alias("n")).collect()
    assert rows.count() == 150_000 and sum(r.bursts for r in got) == 18_800 and sum(r.n for r in got) == 150_000


def test_a_refresh_equals_a_full_build(spark):
    from pyspark.sql import functions as F

    from lorekeep.plans.artifacts import refresh_layer

    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    long = "word " * 60
    before = [*[rec(i, i, parent="P", text=long) for i in range(9)], rec(20, 0, parent="Q", text=long), rec(21, 90, parent="Q"), rec(30, 0, parent="R", text=long)]
    after = [*[rec(i, i, parent="P", text=long) for i in range(9)], rec(20, 0, parent="Q", text=long), rec(21, 90, parent="Q", text="other"), rec(22, 200, parent="Q", text=long)]
    bursts, vectors, states = refresh_layer(None, frame(before))
    assert {r.state for r in states.collect()} == {"embedded", "plain"}
    dirty = spark.createDataFrame([("Q",), ("R",)], "parent_artifact_id string")
    got = refresh_layer((bursts, vectors), frame(after), dirty)
    full = refresh_layer(None, frame(after))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got[0].select(full[0].columns)) == key(full[0]) and key(got[1]) == key(full[1])
    counts = {r.state: r["count"] for r in got[2].groupBy("state").count().collect()}
    kept = bursts.where("parent_artifact_id = 'P'").count()
    assert counts == {"kept": kept, "reused": 1, "embedded": 1, "plain": 1, "removed": 2}
    assert got[0].where("parent_artifact_id = 'R'").isEmpty()


def test_refresh(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "burst_id string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "burst_id string, digest string")
    assert {r.burst_id: r.state for r in refresh_bursts(old, new).collect()} == {"a": "reused", "b": "changed", "c": "removed", "d": "added"}


def test_empty(spark):
    assert group_bursts(spark.createDataFrame([], SCHEMA)).count() == 0
