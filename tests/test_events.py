import json
import random
from datetime import datetime

import pytest

from lorekeep.operators import events as E
from lorekeep.operators.events import EVENT, apply_events, change_feed, dirty_parents, new_batches, receipts

T = [datetime(2024, 1, d) for d in range(1, 28)]
NAMES = [c.split(" ")[0] for c in EVENT.split(", ")]


def ev(batch, ordinal, ext, op="upsert", entity="message", parent=("conversation", "c"), text="x", seq=None, at=None, version=None, day=None, **more):
    row = dict(batch_seq=batch, batch_id=f"b{batch}", source="s", source_instance="d", observed_at=T[batch if day is None else day], ordinal=ordinal, record="event", operation=op, entity=entity, external_id=ext, parent_entity=parent and parent[0], parent_external_id=parent and parent[1], source_sequence=seq, source_updated_at=at, source_version=version, payload=None if op == "delete" else json.dumps({"text": text}), covered_from=None, covered_to=None)
    return tuple((row | more)[n] for n in NAMES)


def conv(batch=0, ordinal=0):
    return ev(batch, ordinal, "c", entity="conversation", parent=None, seq=1)


def cover(batch, ordinal=99, **more):
    return ev(batch, ordinal, None, entity="message", record="coverage", operation=None, payload=None, **more)


def run(spark, *batches):
    state = log = None
    for b in batches:
        state, log = apply_events(spark.createDataFrame(list(b), EVENT), state, log)
    return {r.external_id: r for r in state.collect()}, [(r.batch_id, r.ordinal, r.disposition) for r in log.orderBy("batch_id", "derived", "ordinal").collect()], state, log


def test_ordering(spark):
    s, log, _, _ = run(spark, [conv(), ev(0, 1, "m", seq=5, text="a"), ev(0, 2, "m", seq=4, text="b"), ev(0, 3, "m", seq=5, text="c"), ev(0, 4, "m", seq=6, text="d"), ev(0, 5, "m", seq=5, text="a")])
    assert [d for *_, d in log] == ["accepted", "accepted", "stale", "conflict", "accepted", "unchanged"]
    assert json.loads(s["m"].payload)["text"] == "d" and s["m"].source_sequence == 6


def test_times_and_versions(spark):
    _, log, _, _ = run(spark, [conv(), ev(0, 1, "m", at=T[3]), ev(0, 2, "m", at=T[2], text="y"), ev(0, 3, "m", at=T[3], text="z"), ev(0, 4, "n", version="1"), ev(0, 5, "n", version="2", text="y")])
    assert [d for *_, d in log] == ["accepted", "accepted", "stale", "conflict", "accepted", "conflict"]


def test_replay_changes_nothing(spark):
    batch = [conv(), ev(0, 1, "m", seq=1)]
    s, log, _, _ = run(spark, batch, batch)
    assert [d for *_, d in log].count("unchanged") == 2 and s["m"].deleted_at is None


def test_delete_cascades_and_later_sighting_revives(spark):
    m, a = ev(0, 1, "m", seq=1), ev(0, 2, "a", entity="attachment", parent=("message", "m"), seq=1)
    gone = ev(1, 1, "c", "delete", entity="conversation", parent=None, seq=2)
    s, log, state, lg = run(spark, [conv(), m, a], [gone])
    assert all(s[k].deleted_at == T[1] for k in ("c", "m", "a"))
    assert receipts(lg).where("batch_id = 'b1'").first().derived == 2
    again, _ = apply_events(spark.createDataFrame([ev(2, 1, "m", seq=1)], EVENT), state, lg)
    assert {r.external_id: r.deleted_at for r in again.collect()}["m"] is None
    early, log2 = apply_events(spark.createDataFrame([ev(2, 1, "m", seq=3, text="new", day=1)], EVENT), state, lg)
    assert log2.where("batch_id = 'b2'").first().disposition == "stale"


def test_explicit_delete_is_not_revived(spark):
    s, log, _, _ = run(spark, [conv(), ev(0, 1, "m", seq=1)], [ev(1, 1, "m", "delete", seq=2)], [ev(2, 1, "m", seq=1)])
    assert log[-1][2] == "unchanged" and s["m"].deleted_at == T[1]


def test_redaction_is_durable(spark):
    s, log, state, lg = run(spark, [conv(), ev(0, 1, "m", seq=1, text="secret")], [ev(1, 1, "m", "redact", seq=2)], [ev(2, 1, "m", seq=9, text="secret")])
    assert s["m"].redacted_at == T[1] and "secret" not in s["m"].payload
    assert [d for *_, d in log][-1] == "redacted"
    assert lg.where("payload like '%secret%'").count() == 0


def test_tombstone_first(spark):
    s, log, _, _ = run(spark, [conv(), ev(0, 1, "m", "delete", seq=5)], [ev(1, 1, "m", seq=4)])
    assert s["m"].deleted_at == T[0] and log[-1][2] == "stale"


def test_coverage(spark):
    base = [conv(), ev(0, 1, "m1", seq=1), ev(0, 2, "m2", seq=1), ev(0, 3, "x", entity="attachment", seq=1)]
    s, _, state, log = run(spark, base, [ev(1, 1, "m1", seq=1), cover(1), cover(1, 100)])
    assert s["m2"].deleted_at == T[1] and s["m1"].deleted_at is None and s["x"].deleted_at is None
    assert receipts(log).where("batch_id = 'b1'").first().derived == 1
    later, _ = apply_events(spark.createDataFrame([ev(2, 1, "m2", seq=1)], EVENT), state, log)
    assert {r.external_id: r.deleted_at for r in later.collect()}["m2"] is None


def test_delayed_coverage_keeps_newer_rows(spark):
    s, _, _, _ = run(spark, [conv()], [ev(3, 1, "m", seq=1)], [cover(4, day=2)])
    assert s["m"].deleted_at is None


def test_coverage_within_times(spark):
    rows = [conv(), ev(0, 1, "in", seq=1, payload=json.dumps({"occurred_at": "2024-01-05T00:00:00"})), ev(0, 2, "out", seq=1, payload=json.dumps({"occurred_at": "2024-02-05T00:00:00"})), ev(0, 3, "none", seq=1)]
    s, _, _, _ = run(spark, rows, [cover(1, covered_from=T[0], covered_to=T[20])])
    assert s["in"].deleted_at == T[1] and s["out"].deleted_at is None and s["none"].deleted_at is None


@pytest.mark.parametrize("bad", [[ev(0, 1, "m")], [conv(), ev(0, 1, "c", entity="conversation", parent=("conversation", "c"), seq=2)]])
def test_broken_hierarchy(spark, bad):
    with pytest.raises(Exception, match="parent|ancestor"):
        run(spark, bad)


def test_moves_and_dirty_parents(spark):
    two = ev(0, 1, "c2", entity="conversation", parent=None, seq=1)
    s, _, state, log = run(spark, [conv(), two, ev(0, 2, "m", seq=1)], [ev(1, 1, "m", seq=2, parent=("conversation", "c2"))])
    assert s["m"].parent_artifact_id == s["c2"].artifact_id
    assert s["c2"].artifact_id in {r[0] for r in dirty_parents(log, state).collect()}


def test_ledger(spark):
    ledger = spark.createDataFrame([("b1", "h1")], "batch_id string, sha256 string")
    assert [r.batch_id for r in new_batches(spark.createDataFrame([("b1", "h1"), ("b2", "h")], ledger.schema), ledger).collect()] == ["b2"]
    with pytest.raises(Exception, match="differs"):
        new_batches(spark.createDataFrame([("b1", "other")], ledger.schema), ledger).collect()


def test_a_move_and_a_file_mark_the_right_conversations(spark):
    two = ev(0, 1, "c2", entity="conversation", parent=None, seq=1)
    third = ev(0, 3, "c3", entity="conversation", parent=None, seq=1)
    first = [conv(), two, third, ev(0, 2, "m", seq=1), ev(0, 4, "n", seq=1, parent=("conversation", "c3"))]
    moved = [ev(1, 1, "m", seq=2, parent=("conversation", "c2"))]
    filed = [ev(2, 1, "f", entity="attachment", parent=("message", "m"), seq=1), ev(2, 2, "n", seq=1, parent=("conversation", "c3"))]
    s, _, _, log = run(spark, first, moved, filed)
    ids = {s[x].artifact_id: x for x in ("c", "c2", "c3")}
    feed = lambda after: {ids[r.parent_artifact_id]: r.change for r in change_feed(log, after).collect()}
    assert feed(None) == {"c": 1, "c2": 2, "c3": 0} and feed(0) == {"c": 1, "c2": 2} and feed(1) == {"c2": 2} and feed(2) == {}


def test_units_of_one_instance_are_tasks_of_their_own(spark, monkeypatch):
    """Small tasks, and batches one by one over stored state, give what one task over all gives."""
    rng = random.Random(4)
    batches = [[conv(), *[ev(0, i, f"c{i}", entity="conversation", parent=None, seq=1) for i in range(1, 9)], *[ev(0, 100 + i, f"m{i}", seq=1, parent=("conversation", f"c{1 + i % 8}")) for i in range(30)]]]
    for b in range(1, 4):
        batches.append([ev(b, i, f"m{rng.randrange(30)}", seq=b + 1, parent=("conversation", f"c{1 + rng.randrange(8)}")) for i in range(4)] + [ev(b, 50, f"c{rng.randrange(1, 9)}", entity="conversation", parent=None, seq=b + 5, op=rng.choice(["delete", "upsert"]))])
    key = lambda df: sorted(map(str, df.collect()))
    at_once = apply_events(spark.createDataFrame([e for b in batches for e in b], EVENT))
    want = key(at_once[0]), key(at_once[1])
    monkeypatch.setattr(E, "A_TASK", 3)
    _, _, state, log = run(spark, *batches)
    assert (key(state), key(log)) == want


def test_smallest_reachable(spark):
    rng = random.Random(9)
    path = rng.sample(range(1000, 1300), 300)
    pairs = list(zip(path, path[1:])) + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, x) for x in range(501, 560)] + [(900, 900)]
    pairs = [(f"{a:04d}", f"{b:04d}") for a, b in pairs]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u string, v string").distinct()
    assert {r.u: r.label for r in E.smallest_reachable(edges).collect()} == {x: root(x) for x in list(parent)}


def test_only_units_of_several_parents_are_looked_up(spark):
    """Flat conversations need no graph; a move and a file do, and ids in it are numbers."""
    flat = [conv(), *[ev(0, i, f"m{i}", seq=1) for i in range(1, 9)], cover(0)]
    first, labels, total = E.hierarchy_units(spark.createDataFrame(flat, EVENT), None)
    assert labels.isEmpty() and first.count() == 9 and total == 10 + 9
    assert [k for _, k in first.dtypes] == ["bigint", "bigint"]
    moved = [ev(0, 20, "c2", entity="conversation", parent=None, seq=1), ev(1, 1, "m1", seq=2, parent=("conversation", "c2")), ev(1, 2, "f", entity="attachment", parent=("message", "m1"), seq=1)]
    _, labels, _ = E.hierarchy_units(spark.createDataFrame(flat + moved, EVENT), None)
    assert labels.count() == 2 and labels.select("label").distinct().count() == 1


def test_identities_of_the_fold_are_those_of_columns(spark):
    from lorekeep.functions.identity import artifact_id
    from pyspark.sql import functions as F

    row = spark.range(40).select(F.col("id").cast("string").alias("x"), artifact_id(F.lit("s"), F.lit("d"), F.lit("message"), F.col("id").cast("string")).alias("a")).collect()
    one = E.Instance("s", "d", [], {})
    assert all(one.key("message", r.x) == r.a for r in row) and all(one.key("message", r.x) is one.key("message", r.x) for r in row)


def test_a_group_of_the_fold_stays_small(spark):
    """60,000 rows aren't folded as one or two groups, whose rows a worker holds at once."""
    from pyspark.sql import functions as F

    first = spark.range(30_000).select(F.xxhash64("id").alias("u"), F.xxhash64(F.col("id") % 3000).alias("v"))
    sizes = first.groupBy(F.pmod(F.xxhash64("v"), F.lit(-(-60_000 // E.A_TASK)))).count()
    assert 2 * sizes.agg(F.max("count")).first()[0] < 25_000
