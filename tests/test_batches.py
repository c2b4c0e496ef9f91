import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.secrets import holds_secret, plain_secret, sanitised
from lorekeep.operators import hierarchy as H
from lorekeep.operators import maintenance as M
from lorekeep.operators import paging as P
from lorekeep.operators.events import apply_events
from lorekeep.operators.fusion import merge_raw
from lorekeep.operators.scope import ArtifactScope, Scope, check_filters
from lorekeep.sources import batches as B
from lorekeep.sources import legacy
from lorekeep.sources.store import Store
from lorekeep.streaming.apply import apply_stream, distinct_events, read_events, sessions

HEAD = {"schema": "any/artifact-batch@1", "record": "batch", "batch_id": "b1", "source": "teams", "source_instance": "default", "observed_at": "2024-01-02T00:00:00Z", "event_count": 2, "coverage": [{"parent": {"entity": "conversation", "external_id": "c"}, "entity": "message", "complete": True}]}
EVENTS = [
    {"schema": "any/artifact-event@1", "record": "event", "entity": "conversation", "operation": "upsert", "external_id": "c", "source_sequence": 1, "payload": {"title": "T"}},
    {"schema": "any/artifact-event@1", "record": "event", "entity": "message", "operation": "upsert", "external_id": "m", "parent": {"entity": "conversation", "external_id": "c"}, "source_sequence": 1, "payload": {"text": "hi", "occurred_at": "2024-01-01T10:00:00Z"}},
]


def write(path, head=HEAD, events=EVENTS):
    path.write_text("\n".join(json.dumps(x) for x in [head, *events]) + "\n")
    return str(path)


def test_read_and_apply(spark, tmp_path):
    rows = B.lines(B.read_batches(spark, write(tmp_path / "a.jsonl")))
    assert B.problems(rows).count() == 0
    e = B.events(rows)
    assert [(r.record, r.ordinal > 2**29) for r in e.orderBy("ordinal").collect()] == [("event", False), ("event", False), ("coverage", True)]
    state, log = apply_events(e)
    assert {r.external_id for r in state.collect()} == {"c", "m"} and log.where("disposition = 'accepted'").count() == 2


@pytest.mark.parametrize(
    "change, problem",
    [({"event_count": 3}, "event count"), ({"schema": "x"}, "manifest"), ({"source": "Bad Name"}, "manifest"), ({}, "event"), ({}, "secret")],
)
def test_refused(spark, tmp_path, change, problem):
    events = [dict(EVENTS[0]), dict(EVENTS[1])]
    if problem == "event":
        events[1]["operation"] = "erase"
    if problem == "secret":
        events[1] = events[1] | {"payload": {"text": "password = hunter2secret"}}
    rows = B.lines(B.read_batches(spark, write(tmp_path / "a.jsonl", HEAD | change, events)))
    assert problem in {r.problem for r in B.problems(rows).collect()}


def test_hash_is_of_exact_bytes(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"{}\n")
    b.write_bytes(b"{}\r\n")
    assert len({r.sha256 for p in (a, b) for r in B.read_batches(spark, str(p)).collect()}) == 2


@pytest.mark.parametrize("text", ["api_key: abcd1234", "https://user:pw12@host/x", "Authorization: Bearer abcdefghijklmnop", "see https://h/x?access_token=abc", "password%3Dhunter22", "&#112;assword=hunter22", '{"client_secret": "x"}', '{"a": [{"b": "token = abcdef"}]}', '{"a": "{\\"password\\": \\"x\\"}"}'])
def test_secrets_found(text):
    assert holds_secret(text)


@pytest.mark.parametrize("text", [None, "", "the password policy changed", "a token of thanks", "https://host/path?page=2", '{"title": "secretary"}', "basic training"])
def test_no_secret(text):
    assert not holds_secret(text)


def test_sanitised(spark):
    df = spark.createDataFrame([("x password = hunter22 y",), ("https://u:pw12@host/a",), ("nothing",)], "t string")
    got = [r.x for r in df.select(sanitised(F.col("t")).alias("x")).collect()]
    assert got == ["x password = [REDACTED] y", "https://u:[REDACTED]@host/a", "nothing"]
    assert [r.x for r in df.select(plain_secret(F.col("t")).alias("x")).collect()] == [True, True, False]


def test_paging(spark):
    rows = spark.createDataFrame([(f"a{i:02d}", datetime(2024, 1, 1, 10, i) if i else None) for i in range(20)], "artifact_id string, occurred_at timestamp")
    page = P.after(rows, None, 5).collect()
    assert [r.artifact_id for r in page] == ["a00", "a01", "a02", "a03", "a04"]
    key = (page[-1].occurred_key, page[-1].artifact_id)
    assert P.position(P.cursor(*key)) == key
    assert [r.artifact_id for r in P.after(rows, key, 3).collect()] == ["a05", "a06", "a07"]
    assert [r.artifact_id for r in P.before(rows, key, 3).collect()] == ["a01", "a02", "a03"]
    around = P.around(rows, key, 5).collect()
    assert [(r.artifact_id, r.focus) for r in around] == [("a02", False), ("a03", False), ("a04", True), ("a05", False), ("a06", False)]
    assert all(P.cursors(around, key, 5))
    with pytest.raises(ValueError):
        P.position("%%%")
    t = spark.createDataFrame([("x" * 6000 + "needle" + "y" * 6000,)], "t string").select(P.text_window(F.col("t"), F.lit("NEEDLE"), 100).alias("w")).first().w
    assert len(t) == 100 and "needle" in t


def test_scopes(spark):
    rows = spark.createDataFrame([("s", "d", "message", "p", datetime(2024, 1, 2), None, None), ("s", "d", "message", "p", None, None, None), ("s", "d", "meeting", "p", datetime(2024, 1, 2), datetime(2024, 1, 3), None)], "source string, source_instance string, entity string, parent_artifact_id string, occurred_at timestamp, deleted_at timestamp, redacted_at timestamp")
    assert rows.where(ArtifactScope(source="s").records()).count() == 2
    assert rows.where(ArtifactScope(entities=("message",), date_from=datetime(2024, 1, 1)).records()).count() == 1
    with pytest.raises(ValueError):
        check_filters(Scope(), ArtifactScope())
    assert check_filters(None, ArtifactScope()) == "artifacts"


def test_meeting_context(spark):
    art = spark.createDataFrame([("m", None, "meeting"), ("t", "m", "transcript"), ("q", "t", "transcript-cue"), ("r", None, "recording"), ("c", None, "conversation"), ("x", "c", "message"), ("y", "x", "attachment"), ("z", None, "message")], "artifact_id string, parent_artifact_id string, entity string")
    links = spark.createDataFrame([("m", "contains", "r"), ("m", "related-chat", "c")], "source string, relation string, target string")
    got = H.meeting_context(art, links, spark.createDataFrame([("m",)], "root string"))
    assert {r.artifact_id for r in got.collect()} == {"t", "q", "r", "x", "y"}


def test_work_queue(spark):
    q = spark.createDataFrame([("a", "pending", "d1", "e1"), ("b", "pending", "d2", "e2")], "artifact_id string, status string, digest string, event_id string")
    done = spark.createDataFrame([("a", "distilled", "d1", "e1", "meeting"), ("b", "distilled", "old", "e2", "meeting")], "artifact_id string, status string, digest string, event_id string, entity string")
    after, rejected = M.complete(q, done)
    assert {r.artifact_id: r.status for r in after.collect()} == {"a": "distilled", "b": "pending"} and [r.artifact_id for r in rejected.collect()] == ["b"]
    touched = spark.createDataFrame([("a", "e9", False), ("b", "e8", True)], "artifact_id string, event_id string, system_only boolean")
    again = M.reopen(after, touched, spark.createDataFrame([("a", "d9"), ("b", "d8")], "artifact_id string, digest string"))
    assert {r.artifact_id: (r.status, r.digest) for r in again.collect()} == {"a": ("pending", "d9"), "b": ("pending", "d2")}


def test_merge_raw(spark):
    now = datetime(2024, 1, 31)
    dist = spark.createDataFrame([("q", "n1", "Note", 0.1, 1)], "query_id string, id string, title string, score double, rank int")
    gate = spark.createDataFrame([("q", True)], "query_id string, answered boolean")
    cols = "query_id string, query string, now timestamp, producer string, uri string, artifact_id string, external_id string, entity string, title string, text string, occurred_at timestamp, score double, rank int"
    raw = lambda query, *rows: spark.createDataFrame([("q", query, now, p, u, u, e, "message", "", t, datetime(2024, 1, 1), 0.5, k) for p, u, e, t, k in rows], cols)
    out = merge_raw(dist, gate, raw("words", ("artifact-fts", "u1", "x1", "some words", 1), ("artifact-vector", "u1", "x1", "burst", 1)), 5).orderBy("rank").collect()
    assert [(r.id, r.evidence) for r in out] == [("n1", "distilled"), ("u1", "raw")] and out[0].answered
    assert abs(out[1].score - (2 * (1 / 61 + 0.02) + 0.03 * 0.5)) < 1e-9
    exact = merge_raw(dist, gate, raw('"some words"', ("artifact-fts", "u1", "x1", "some words", 1)), 5).where("rank = 1").first()
    assert (exact.id, exact.reason, exact.answered) == ("u1", "exact phrase", True)
    lead = merge_raw(dist.limit(0), gate, raw("words", ("artifact-vector", "u1", "words", "t", 1)), 5).first()
    assert not lead.answered


def test_legacy(spark):
    c = spark.createDataFrame([("c1", "n", "k", "t", "2024")], "id string, name string, kind string, thread_type string, updated_at string")
    m = spark.createDataFrame([("c1", "m1", "A", "2024", "hi", "1", "2024"), ("zz", "m2", "A", "2024", "hi", "1", "2024")], "conversation_id string, message_id string, author string, timestamp string, content_markdown string, version string, updated_at string")
    a = spark.createDataFrame([("c1", "m1", 0, "f", "x", "2024")], "conversation_id string, message_id string, attachment_index int, name string, content_type string, updated_at string")
    g = spark.createDataFrame([("c1", "s", "2024-01-01T10:00", "o", "2024")], "conversation_id string, subject string, start_time string, organizer_id string, updated_at string")
    e = legacy.to_events(c, m, a, g)
    assert e.count() == 5 and [(r.external_id, r.problem) for r in legacy.plan_problems(e).collect()] == [("zz/m2", "no parent")]
    n = spark.createDataFrame([("n1", "## Transcript\n[00:01] Ann: one\nmore\n[00:02] Bob: two\n## Next\nx")], "note_id string, text string")
    assert [(r.cue, r.speaker, r.text) for r in legacy.cues(n).orderBy("cue").collect()] == [(1, "Ann", "one\nmore"), (2, "Bob", "two")]
    assert legacy.fingerprint(m).first() == legacy.fingerprint(m.orderBy("message_id")).first()
    rows = spark.createDataFrame([("r1", "T1"), ("r2", "T2"), ("r3", "T2")], "row_id string, title string")
    notes = spark.createDataFrame([("n1", None, "T1"), ("n2", "r2", "zz")], "note_id string, row_id string, title string")
    assert {(r.row_id, r.note_id) for r in legacy.match_notes(rows, notes).collect()} == {("r1", "n1"), ("r2", "n2")}


def test_stream(spark, tmp_path):
    from test_events import EVENT, conv, ev

    src = tmp_path / "in"
    spark.createDataFrame([conv(), ev(0, 1, "m", seq=1)], EVENT).coalesce(1).write.json(str(src))
    store = Store(spark, str(tmp_path / "store"))
    apply_stream(read_events(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([ev(1, 1, "m", seq=2, text="new"), conv(0)], EVENT).coalesce(1).write.mode("append").json(str(src))
    apply_stream(read_events(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination()
    gen = store.current()
    assert store.table(gen, "log").count() == 3 and "new" in store.table(gen, "state").where("external_id = 'm'").first().payload


def test_stream_of_split_batches(spark, tmp_path):
    """A batch whose rows arrive in two micro-batches is applied whole; a replay changes nothing, another content is refused."""
    from test_events import EVENT, conv, ev

    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))

    def arrive(rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(str(src))
        apply_stream(read_events(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination()
        gen = store.current()
        return {r.external_id for r in store.table(gen, "state").where("deleted_at is null").collect()}, store.table(gen, "waiting").count()

    assert arrive([conv(), ev(0, 1, "m1", seq=1)]) == ({"c", "m1"}, 0)
    assert arrive([ev(0, 2, "m2", seq=1)])[0] >= {"m1", "m2"}  # the rest of batch 0
    live, waiting = arrive([ev(1, 2, "x", record="manifest"), ev(1, 1, "m3", seq=1)])
    assert "m3" not in live and waiting == 2
    live, waiting = arrive([ev(1, 2, "m4", seq=1)])
    assert {"m3", "m4"} <= live and waiting == 0
    before = store.current()
    arrive([ev(1, 2, "m4", seq=1)])
    assert store.current() == before
    with pytest.raises(Exception, match="differs from its receipt"):
        arrive([ev(1, 2, "m4", seq=1, text="other")])


def test_a_bad_batch_is_rejected_alone(spark):
    from test_events import EVENT, conv, ev

    from lorekeep.operators.events import apply_events

    bad = [ev(1, 1, "m1", seq=2, text="changed"), ev(1, 2, "lost", seq=1, parent=("conversation", "nowhere"))]
    state, log = apply_events(spark.createDataFrame([conv(), ev(0, 1, "m1", seq=1, text="first"), *bad, ev(2, 1, "m2", seq=1)], EVENT), strict=False)
    rows = {r.external_id: r.payload for r in state.collect()}
    assert "first" in rows["m1"] and "m2" in rows and "lost" not in rows
    assert [(r.batch_id, "does not exist" in r.payload) for r in log.where("disposition = 'rejected'").collect()] == [("b1", True)]
    again, _ = apply_events(spark.createDataFrame([bad[0]], EVENT), state, log)  # the refused event is not known as seen
    assert "changed" in {r.external_id: r.payload for r in again.collect()}["m1"]


def test_a_hierarchy_that_is_too_deep_is_an_error(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, i == 0) for i in range(10)], "node string, parent string, dead boolean")
    for rows in (H.closure(chain), H.hidden(chain), H.below(chain, spark.createDataFrame([("n0",)], "root string"))):
        with pytest.raises(Exception, match="more than 8 levels"):
            rows.collect()
    assert H.closure(chain.where("node < 'n9'")).count() == 36
    loop = spark.createDataFrame([("a", "b", False), ("b", "a", False)], chain.schema)
    with pytest.raises(Exception, match="or a cycle"):
        H.roots(loop).collect()


def test_graph_merge_refuses_what_is_broken(spark):
    from lorekeep.operators.graph import merge_graphs

    nodes = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "id string, label string")
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "source string, target string")
    n, e = merge_graphs({"a": (nodes("x", "y"), edges(("x", "y"))), "b": (nodes("x"), edges())})
    assert {r.id for r in n.collect()} == {"a:x", "a:y", "b:x"} and [tuple(r) for r in e.collect()] == [("a:x", "a:y")]
    with pytest.raises(Exception, match="repeated node"):
        merge_graphs({"a": (nodes("x", "x"), edges())})[0].collect()
    with pytest.raises(Exception, match="dangling edge"):
        merge_graphs({"a": (nodes("x"), edges(("x", "z")))})[1].collect()


def test_stream_functions(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "e").mkdir()
    e.coalesce(1).write.parquet(str(tmp_path / "e/x"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e/*"))
    q = distinct_events(s, "ts", "event_id").writeStream.format("memory").queryName("d").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("d").count() == e.count()
    q = sessions(s, "ts", "user_id").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    n = sessions(e, "ts", "user_id").count()
    assert n - 150 <= spark.table("w").count() <= n
