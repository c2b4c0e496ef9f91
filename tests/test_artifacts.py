import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.vectors import embed, hashed_features
from lorekeep.operators import distill as D
from lorekeep.operators.bursts import group_bursts
from lorekeep.operators.events import apply_events
from lorekeep.operators.scope import ArtifactScope
from lorekeep.plans import artifacts as A

from test_events import EVENT, conv, ev


@pytest.fixture(scope="module")
def rows(spark):
    def msg(i, text, minute, **more):
        return ev(0, i, f"m{i}", seq=1, payload=json.dumps({"text": text, "occurred_at": f"2024-01-01T10:{minute:02d}:00Z", "author": {"id": "a", "name": "Ann"}} | more))

    events = [ev(0, 0, "c", entity="conversation", parent=None, seq=1, payload=json.dumps({"title": "Release chat"})), msg(1, "the rollout of the zebra service is done", 0, aliases=[{"kind": "old", "value": "x1"}]), msg(2, "see TICK-77 for zebra details", 5, links=[{"relation": "about", "target": {"entity": "message", "external_id": "m1"}}]), msg(3, "lunch?", 40), msg(4, "zebra zebra gone", 50), ev(0, 9, "m4", "delete", seq=2), ev(0, 10, "f", entity="attachment", parent=("message", "m3"), seq=1)]
    state, _ = apply_events(spark.createDataFrame(events, EVENT))
    return A.records(state.checkpoint()).checkpoint()


def test_search(spark, rows):
    q = spark.createDataFrame([(1, "zebra")], "query_id int, query string")
    found = A.search_records(A.index_records(rows), rows, q).orderBy("rank").collect()
    assert {r.external_id for r in found} == {"m1", "m2"} and all(0 < r.score < 1 for r in found)
    late = ArtifactScope(entities=("message",), date_from=datetime(2024, 1, 1, 10, 3))
    assert [r.external_id for r in A.search_records(A.index_records(rows), rows, q, late).collect()] == ["m2"]


def test_scores_equal_to_nine_decimals_tie_by_id(spark):
    """A word that all records hold weighs 1e-6, so records of nearly one length differ beyond the ninth decimal only."""
    texts = [("b", "word " + "x " * 4000), ("a", "word " + "x " * 4001), ("c", "word")]
    rows = spark.createDataFrame([(i, "", "", t, "") for i, t in texts], "artifact_id string, title string, author_name string, text string, external_id string")
    rows = rows.selectExpr("*", "'s' source", "'i' source_instance", "'message' entity", "timestamp'2024-01-01' occurred_at", "cast(null as timestamp) deleted_at", "cast(null as timestamp) redacted_at")
    found = {r.artifact_id: r for r in A.search_records(A.index_records(rows), rows, spark.createDataFrame([(1, "word")], "query_id int, query string")).collect()}
    assert found["b"].score > found["a"].score and round(found["b"].score, 9) == round(found["a"].score, 9)
    assert [found[i].rank for i in "cab"] == [1, 2, 3]


def test_relations(spark, rows):
    assert [(r.kind, r.value) for r in A.aliases(rows).collect()] == [("old", "x1")]
    ids = {r.external_id: r.artifact_id for r in rows.collect()}
    assert [(r.source, r.relation, r.target) for r in A.links(rows).collect()] == [(ids["m2"], "about", ids["m1"])]
    assert A.broken_links(rows).count() == 0


def test_bursts(spark, rows):
    bursts = group_bursts(A.burst_records(rows)).checkpoint()
    got = bursts.orderBy("started_at").collect()
    assert [r.record_count for r in got] == [2, 1] and got[0].text.startswith("Release chat\n") and got[0].embed and got[1].embed
    vectors = bursts.select(F.col("burst_id").alias("id"), embed(F.col("text"), stored=True).alias("v"))
    q = spark.createDataFrame([(1, "zebra rollout")], "query_id int, query string")
    assert A.search_bursts(bursts, vectors, q).where("rank = 1").first().record_count == 2
    assert A.search_bursts(bursts, vectors, q, ArtifactScope(date_to=datetime(2024, 1, 1, 10, 3))).count() == 0


def test_hashed_vector():
    v = hashed_features("Cache cache")
    assert abs(sum(x * x for x in v.values()) - 1) < 1e-12 and hashed_features("") == {}
    assert v == hashed_features("cache, CACHE.")


@pytest.mark.parametrize("text, want", [("\n".join(f"[00:{i:02d}] hello there" for i in range(12)), True), ("Ann: one\nBob: two\nAnn: three\nBob: four\nplain\nplain", True), ("> q\n" * 13, True), ("A note: with\nfew lines\nand text", False), (None, False)])
def test_transcripts(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(D.is_transcript(F.col("t")).alias("x")).first().x is want


def test_system_messages(spark):
    df = spark.createDataFrame([(None, "system", "upsert"), ("system", "system", "upsert"), ("user", "system", "upsert"), ("system", None, "delete"), (None, "user", "upsert")], "b string, a string, o string")
    assert [r.x for r in df.select(D.system_only(F.col("b"), F.col("a"), F.col("o")).alias("x")).collect()] == [True, True, False, True, False]


def test_notes(spark):
    path = spark.sql("select 'Chats' f, 'Über: a/b!' t, date'2024-02-03' d, 'art_abcdefghijklmnop' a").select(D.note_path(*map(F.col, "ftda")).alias("x")).first().x
    assert path == "Chats/2024-02-03-uber-a-b-abcdefghij.md"
    once = D.replace_managed("mine\n", "one")
    assert D.replace_managed(once, "two") == once.replace("one", "two") and once.startswith("mine\n")
    with pytest.raises(ValueError):
        D.replace_managed(once + D.BEGIN, "x")
    assert D.safe_path("a/b.md") == "a/b.md"
    for bad in ("../a.md", "/a.md", "c:/a.md", "a.txt", "a//b.md", ".x/a.md"):
        with pytest.raises(ValueError):
            D.safe_path(bad)
    with pytest.raises(ValueError):
        D.safe_path("A.md", {"a.md"})
    uri = "artifact://message/art_" + "a" * 32
    good = f"---\nmemory_id: m\nupdated: '2024-01-02'\n---\n{D.BEGIN}\nx\n{D.END}\n## Evidence\n- {uri}\n"
    assert D.note_problems(good, memory_id="m", context={uri}) == []
    assert D.note_problems(good, memory_id="n", context=set()) == ["memory_id", "evidence outside the context"]
    assert "evidence" in D.note_problems("no", memory_id="m", context=set())
    assert not D.calendar_date("2024-02-30")
