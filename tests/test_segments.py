import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import lexical as L
from lorekeep.sources.segments import SegmentedIndex
from lorekeep.sources.store import Store

FIELDS = {"title": 4.0, "text": 1.0}
WORDS = [f"w{i}" for i in range(30)] + ["the"] * 20 + ["x_y", "a-b/c", "Straße", "déjà"]
QUERIES = [(1, "w1 the w2"), (2, "the"), (3, "nothing here"), (4, "x_y w3 déjà"), (5, ""), (6, "w4 w4 w5 a.b"), (7, "b.a the")]


def doc(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 20, 60])))


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, 7) for i, d in sorted(docs.items())], "id long, title string, text string, len int")


def whole_and_top(spark, index, docs, k=4):
    """Both ways to search an index, and a full rebuild over the same documents."""
    q = spark.createDataFrame(QUERIES, "query_id int, query string")
    plain = L.build_index(frame(spark, docs), "id", FIELDS, positions=True)
    ranked = lambda scored: {(r.query_id, r.id, r.bm25, r["rank"]) for r in L.top(scored.withColumn("bm25", F.round("bm25", 6)), [F.desc("bm25"), F.asc("id")], k).collect()}
    want = ranked(L.bm25(plain, q))
    assert ranked(L.bm25(index.whole(), q)) == want
    found, read = index.top(q, k)
    assert {(r.query_id, r.id, r.bm25, r["rank"]) for r in found.collect()} == want
    assert {(r.term, r.n) for r in index.whole().terms.collect()} == {(r.term, r.n) for r in plain.terms.collect()}
    m = index.manifest()
    stats = plain.stats.first()
    assert m["docs"] == stats.docs and abs(m["tokens"] / m["docs"] - stats.avglen) < 1e-9
    assert all(r.opened <= r.blocks for r in read.collect())
    return want


@pytest.mark.parametrize("shape", [{}, {"fanout": 2, "shard": 7, "block": 3}])
def test_commits_equal_a_full_rebuild(spark, tmp_path, shape):
    rng = random.Random(2)
    index = SegmentedIndex(Store(spark, str(tmp_path / "i")), FIELDS, **shape)
    docs = {i: (f"Title {rng.choice(WORDS)}", doc(rng) + (" a.b w1" if i % 5 == 0 else "")) for i in range(40)} | {90: (None, None), 91: ("", "")}
    index.commit(frame(spark, docs))
    for _ in range(2):
        edits = {i: ("edited the", doc(rng)) for i in rng.sample(range(60), 6)}
        removed = rng.sample(range(60), 5)
        index.commit(frame(spark, edits), spark.createDataFrame([(i,) for i in [*removed, 5000]], "id long"))
        docs = {i: d for i, d in docs.items() if i not in removed} | edits
    assert whole_and_top(spark, index, docs)
    segments = index.manifest()["segments"]
    assert len(segments) <= (4 if not shape else 3) and sum(s["docs"] - s["deleted"] for s in segments) == len(docs)


def test_an_edit_of_one_note_writes_one_small_segment(spark, tmp_path):
    index = SegmentedIndex(Store(spark, str(tmp_path / "i")), FIELDS)
    docs = {i: ("t", f"w{i} the") for i in range(200)}
    index.commit(frame(spark, docs))
    before = index.manifest()["segments"]
    index.commit(frame(spark, {7: ("t", "new words")}))
    after = index.manifest()["segments"]
    assert [s["name"] for s in after[:1]] == [s["name"] for s in before] and len(after) == 2
    assert after[0]["deleted"] == 1 and after[1]["docs"] == 1 and after[1]["postings"] == 3
    assert index.read("commits", index.manifest()["commits"][-1], "changes").count() == 4  # w7, the, new, words; t cancels out
    index.commit(None, frame(spark, {i: d for i, d in docs.items() if i != 7}).select("id"))
    assert [s["docs"] - s["deleted"] for s in index.manifest()["segments"]] == [1]


def test_refused_commits_leave_the_index_as_it_was(spark, tmp_path):
    index = SegmentedIndex(Store(spark, str(tmp_path / "i")), FIELDS)
    index.commit(frame(spark, {1: ("a", "b"), 2: ("c", "d")}))
    m = index.manifest()
    twice = frame(spark, {3: ("x", "y")})
    with pytest.raises(ValueError, match="two rows of one id"):
        index.commit(twice.union(twice))
    with pytest.raises(RuntimeError, match="another commit"):
        index._publish("late", {}, "an older one")
    assert index.manifest() == m


def test_few_blocks_are_opened_where_a_rare_word_decides(spark, tmp_path):
    index = SegmentedIndex(Store(spark, str(tmp_path / "i")), {"text": 1.0}, block=8)
    docs = spark.range(600).select("id", F.concat(F.lit("the of and "), F.when(F.col("id") % 97 == 0, "needle").otherwise(F.concat(F.lit("hay"), F.col("id").cast("string")))).alias("text"))
    index.commit(docs)
    found, read = index.top(spark.createDataFrame([(1, "the needle of and")], "query_id int, query string"), 3)
    assert [r.id for r in found.orderBy("rank").collect()] == [0, 97, 194]
    r = read.first()
    assert r.blocks > 200 and r.opened <= 2


def test_a_commit_shuffles_postings_twice(spark, tmp_path, monkeypatch):
    """signed_frequencies, bm25_three_generations, bm25_block_max: a commit writes postings once, then blocks and forward rows."""
    from lorekeep.sources import segments as S

    sizes = []
    monkeypatch.setattr(S, "written", lambda df, real=S.written: sizes.append(df.columns) or real(df))
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "id long, text string")
    index = S.SegmentedIndex(S.Store(spark, str(tmp_path / "i")), {"text": 1.0})
    index.commit(docs)
    assert sum("places" in c for c in sizes) == 1
    rows = index.parts(index.manifest(), "forward").select("id", "len", "terms", "tfs").collect()
    assert sorted((r.id, r.len, sorted(zip(r.terms or [], r.tfs or []))) for r in rows) == [(1, 3, [("a", 2.0), ("b", 1.0)]), (2, 0, []), (3, 1, [("b", 1.0)])]


def test_a_commit_leaves_only_what_is_read_again(spark, tmp_path):
    """signed_frequencies, bm25_three_generations: no table but the segment's and the commit's stays, and of dropped segments none after prune()."""
    import os

    from lorekeep.staging import shared

    here = shared(spark).removeprefix("file:")
    tables = lambda: {f for f in os.listdir(here) if f.startswith("table-")}
    before, index = tables(), SegmentedIndex(Store(spark, str(tmp_path / "i")), {"text": 1.0})
    docs = spark.createDataFrame([(i, f"the w{i}") for i in range(9)] + [(9, None)], "id long, text string")
    index.commit(docs)
    first = index.manifest()["segments"][0]["name"]
    index.commit(None, docs.where("id = 3"))
    index.commit(docs)
    assert tables() == before
    assert index.prune() == [first] and index.prune() == []
    assert os.listdir(tmp_path / "i" / "segments") == [s["name"] for s in index.manifest()["segments"]]
    assert {(r.term, r.n) for r in index.frequencies(index.manifest()).collect()} == {("the", 9), *((f"w{i}", 1) for i in range(9))}
    found, _ = index.top(spark.createDataFrame([(1, "w3")], "query_id int, query string"), 2)
    assert [r.id for r in found.collect()] == [3]
