import sqlite3

import pytest
from pyspark.sql import functions as F

from lorekeep.operators.lexical import bm25, build_index, normalised

DOCS = [
    (1, "Launch note", "the scripts/launch-hidden.vbs file starts hidden windows. hidden hidden"),
    (2, "Other", "vbs scripts/launch-hidden in another order of things"),
    (3, "Über notes", "nothing to see but für and a note: here"),
    (4, "Long", "word " * 60 + "hidden"),
    (5, "Empty", ""),
    (6, "Launch", "a.b a.b b.a"),
    (7, "Misc", "windows and doors"),
]


@pytest.mark.parametrize("query", ["hidden", "scripts/launch-hidden.vbs", "launch hidden windows", "note", "a.b", "absent", "...", "Über"])
def test_matches_full_text_search_of_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(title, text, tokenize = \"unicode61 remove_diacritics 2 tokenchars '_-:/#'\")")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this SQLite")
    con.executemany("insert into f(rowid, title, text) values (?, ?, ?)", DOCS)
    import re

    terms = list(dict.fromkeys(w for w in (m.casefold().strip("._:/#@+-") for m in re.findall(r"[A-Za-z0-9][A-Za-z0-9_.:/#@+-]*", query)) if w))
    want = dict(con.execute("select rowid, -bm25(f, 4.0, 1.0) from f where f match ?", (" OR ".join(f'"{w}"' for w in terms),)).fetchall()) if terms else {}
    docs = spark.createDataFrame(DOCS, "id long, title string, text string")
    index = build_index(docs, "id", {"title": 4.0, "text": 1.0}, positions=True)
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    got = {r.id: r.bm25 for r in bm25(index, q).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_lexical_norm_reads_whole_passages(spark, tmp_path):
    """A document that holds only words behind a passage's first 24 is found."""
    from lorekeep.queries import QUERIES

    words = [f"w{i}" for i in range(30)]
    spark.createDataFrame([(1, words[0]), (2, words[29]), (3, "others")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.query_id, r.id) for r in QUERIES["lexical_norm"](spark, str(tmp_path)).collect()} == {(7, 1), (7, 2)}


def test_scope_keeps_statistics(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, text string")
    index = build_index(docs, "id", {"text": 1.0})
    q = spark.createDataFrame([(1, "hidden")], "query_id int, query string")
    everything = {r.id: r.bm25 for r in bm25(index, q).collect()}
    some = {r.id: r.bm25 for r in bm25(index, q, allowed=spark.createDataFrame([(1, 4)], "query_id int, id long")).collect()}
    assert some == {4: everything[4]}


def test_normalised(spark):
    assert [r[0] for r in spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "s double").select(normalised(F.col("s"))).collect()] == [0.0, 0.0, 0.5]


def test_containing(spark):
    from lorekeep.operators.lexical import containing

    texts = ["the quick brown fox", "a quick brown foxtrot ran", "brown quick", "", None, "xthe quick browny"]
    phrases = ["the quick brown", "quick brown fox", "quick", "e quick brown f", "none of these words", "", "ran."]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string")
    assert {(r.id, r.phrase_id) for r in containing(d, p).collect()} == {(i, j) for i, t in enumerate(texts) if t is not None for j, x in enumerate(phrases) if x in t}


def test_tokens_are_counted_where_texts_are_read(spark):
    """bm25_topk, bm25_best_per_group, lexical_norm, eval_recall_mrr, doc_diversity: only what is asked for is shuffled, by document."""
    docs = spark.createDataFrame([(1, "Ärger ärger über x"), (2, None), (3, "über uber"), (3, "Uber y")], "id long, text string")
    index = build_index(docs, "id", {"text": 1.0}, positions=True)
    rows = sorted((r.term, r.id, r.tf, r.n, r.len, r.places) for r in index.postings.collect())
    assert rows == [("arger", 1, 2.0, 2, 4, [0, 1]), ("uber", 1, 1.0, 1, 4, [2]), ("uber", 3, 3.0, 3, 4, [0, 0, 1]), ("x", 1, 1.0, 1, 4, [3]), ("y", 3, 1.0, 1, 4, [1])]
    assert sorted(map(tuple, index.lengths.collect())) == [(1, 4), (2, 0), (3, 4)]
    once = build_index(docs.where("id < 3"), "id", {"text": 1.0})
    assert "Exchange" not in once.postings._jdf.queryExecution().executedPlan().toString()
    scored = bm25(once, spark.createDataFrame([(1, "x arger")], "query_id int, query string"))
    assert not any("hashpartitioning(query_id" in line and ", id#" in line for line in scored._jdf.queryExecution().executedPlan().toString().splitlines())
