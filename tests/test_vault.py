import json
import os
from datetime import datetime

import pytest

from lorekeep.operators.evaluate import judge, summary
from lorekeep.operators.scope import Scope
from lorekeep.plans.recall import Notes, connect, related, route, search
from lorekeep.plans.sync import sync
from lorekeep.sources.store import Store, append_audit, damaged, objects, unreferenced
from lorekeep.sources.vault import chunk, graph_json, parse, scan

NOTES = {
    "Repos/beta/Tickets/BETA-219/Cache.md": "---\nmemory_id: beta-219-cache\ntitle: Cache invalidation for BETA-219\nprimary_scope: {kind: repository, id: beta}\nrelated: ['[[Login flow]]']\nrelated_repos: [beta]\nupdated: 2024-06-01\n---\n# Cache invalidation\nThe cache key must contain the tenant id. See [[Deploy guide]].\n",
    "Repos/alpha/Login.md": "---\nmemory_id: alpha-login\ntitle: Login flow\nprimary_scope: {kind: repository, id: alpha}\nrelated_repos: [alpha]\n---\nUsers sign in with a device code; tokens expire after one hour.\n",
    "Guides/Deploy.md": "---\nmemory_id: deploy\ntitle: Deploy guide\n---\n# Steps\nRun the pipeline, then watch the canary for ten minutes.\n## Rollback\nRedeploy the previous image.\n",
    "Guides/Start.md": "---\nmemory_id: start\ntitle: Windowless startup launch\nreview_after: 2020-01-01\n---\nThe scheduler opens the helper through a hidden wrapper script.\n",
    "Old/Archive.md": "---\nmemory_id: old\ntitle: Cache of old days\nstatus: archived\n---\nThe cache key must contain the tenant id.\n",
    ".hidden/No.md": "cache",
    "restricted/No.md": "cache",
}
NOW = datetime(2024, 6, 30)


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    return fill(tmp_path_factory.mktemp("vault a"))


def fill(root):
    for name, text in NOTES.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def notes(spark, vault):
    docs = parse(scan(spark, {"core": str(vault)})).cache()
    return Notes.build(docs, chunk(docs).cache()).settled()


def asked(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q, NOW) for i, q in enumerate(queries)], "query_id string, query string, now timestamp")


def test_scan_and_parse(notes):
    rows = {r.memory_id: r for r in notes.docs.collect()}
    assert set(rows) == {"beta-219-cache", "alpha-login", "deploy", "start", "old"}
    assert rows["beta-219-cache"].path == "core/Repos/beta/Tickets/BETA-219/Cache.md" and "BETA-219" in rows["beta-219-cache"].identifiers
    assert [(r.ordinal, r.heading) for r in notes.chunks.where("memory_id = 'deploy'").orderBy("ordinal").collect()] == [(0, "Steps … Rollback")]


def test_recall(spark, notes):
    q = asked(spark, "BETA-219 cache key tenant", "how do users sign in with a device code", "start without terminal window hidden", "quarterly revenue of the antarctic branch")
    results, answers = search(notes, q)
    top = {r.query_id: r.memory_id for r in results.where("rank = 1").collect()}
    said = {r.query_id: r.answered for r in answers.collect()}
    assert top["q0"] == "beta-219-cache" and top["q1"] == "alpha-login" and top["q2"] == "start"
    assert said["q0"] and said["q1"] and not said.get("q3", False)
    assert results.where("memory_id = 'old'").count() == 0
    first = results.where("query_id = 'q0' and rank = 1").first()
    assert any(x.startswith("exact identifier") for x in first.reasons) and "tenant" in first.context
    cases = spark.createDataFrame([("q0", ["beta-219-cache"], ["old"], "core/Repos/beta/Tickets/BETA-219/Cache.md", False), ("q1", ["alpha-login"], [], None, False), ("q3", [], [], None, True)], "query_id string, expected array<string>, forbidden array<string>, expected_path string, no_answer boolean")
    s = summary(judge(cases, results.select("query_id", "memory_id", "path", "rank").withColumnRenamed("memory_id", "id"), answers)).first()
    assert (s.cases, s.passed, s.recall_at_1, s.mrr, s.no_answer_accuracy, s.leakage, s.citation_failures) == (3, 3, 1.0, 1.0, 1.0, 0.0, 0)


def test_scope_comes_before_ranking(spark, notes):
    q = asked(spark, "cache key tenant", "cache key tenant")
    results, _ = search(notes, q, {"q1": Scope(repository="ALPHA"), "q0": Scope(status="archived")})
    got = {(r.query_id, r.memory_id) for r in results.collect()}
    assert got and all(m == ("old" if k == "q0" else "alpha-login") for k, m in got)


def test_graph(spark, notes):
    edges = {(r.source, r.target, r.relation) for r in notes.edges.collect()}
    assert ("alpha-login", "beta-219-cache", "declared-related") in edges and ("beta-219-cache", "deploy", "body-link") in edges and ("beta-219-cache", "scope:repository:beta", "belongs-to") in edges
    near = related(notes, spark.createDataFrame([("alpha-login",)], "memory_id string"))
    assert {(r.node, r.distance) for r in near.collect()} >= {("beta-219-cache", 1), ("deploy", 2)}
    path = connect(notes, spark.createDataFrame([("alpha-login", "deploy")], "source string, target string")).first().path
    assert path == ["alpha-login", "beta-219-cache", "deploy"]


def test_routes(notes):
    assert route("artifact://message/art_x", notes.docs)[0] == "artifact"
    assert route("open Deploy guide", notes.docs) == ("exact", ["Deploy guide"])
    assert route("how is Login flow related to Deploy guide", notes.docs) == ("path", ["alpha-login", "deploy"])
    assert route("anything else", notes.docs)[0] == "search"


def test_generations(spark, tmp_path):
    vault = fill(tmp_path / "vault")
    store = Store(spark, str(tmp_path / "store"))
    one = sync(store, scan(spark, {"core": str(vault)}))
    (vault / "Guides/Deploy.md").write_text(NOTES["Guides/Deploy.md"] + "More.\n")
    two = sync(store, scan(spark, {"core": str(vault)}))
    (vault / "Guides/Deploy.md").write_text(NOTES["Guides/Deploy.md"])
    assert store.current() == two != one and store.verified(one) and store.health()["status"] == "ok"
    old = {r.memory_id: r.hash for r in store.table(one, "docs").collect()}
    new = {r.memory_id: r.hash for r in store.table(two, "docs").collect()}
    assert [k for k in new if new[k] != old[k]] == ["deploy"]
    loaded = Notes.load(lambda n: store.table(two, n))
    assert search(loaded, asked(spark, "device code sign in"))[0].where("rank = 1").first().memory_id == "alpha-login"

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.publish({"docs": store.table(two, "docs")}, check=refuse)
    assert store.current() == two and len(store.generations()) == 2
    with store.lease(one):
        assert store.retain(1) == []
    assert store.retain(1) == [one]
    Store(spark, str(tmp_path / "store")).backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).health()["status"] == "ok"
    with pytest.raises(FileExistsError):
        store.backup(str(tmp_path / "copy"))
    assert append_audit(store, "recall", "search", {"query": "private words"})
    line = next((tmp_path / "store/audit/recall").glob("*.jsonl")).read_text()
    assert "private" not in line and json.loads(line)["query"]["length"] == 13


def test_two_notes_with_one_id(spark, tmp_path):
    for name in ("b.md", "a.md"):
        (tmp_path / name).write_text("---\nmemory_id: same\n---\n" + name)
    store = Store(spark, str(tmp_path / "store"))
    sync(store, scan(spark, {"core": str(tmp_path)}))
    assert [r.path for r in store.table(store.current(), "docs").collect()] == ["core/a.md"]


def test_graph_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B", "source_file": "b.md"}], "links": [{"source": "a", "target": "b", "relation": "r", "confidence": "EXTRACTED"}, {"source": "a", "target": "zz", "relation": "r"}]}))
    nodes, edges = graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and [(r.source, r.target) for r in edges.collect()] == [("a", "b")]


def test_objects(spark, tmp_path):
    import hashlib

    good = hashlib.sha256(b"one").hexdigest()
    (tmp_path / good).write_bytes(b"one")
    (tmp_path / ("0" * 64)).write_bytes(b"two")
    found = objects(spark, str(tmp_path))
    want = spark.createDataFrame([(good,), ("0" * 64,)], "sha256 string")
    assert [r.sha256 for r in damaged(found, want).collect()] == ["0" * 64]
    assert [r.sha256 for r in unreferenced(found, want).collect()] == [hashlib.sha256(b"two").hexdigest()]
