import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline  # noqa: E402
from lorekeep.llm.embeddings import embedding_neardup
from lorekeep.llm.jaccard import ngram_jaccard
from lorekeep.llm.language import Automaton, identify_language
from lorekeep.llm.lines import line_dedup
from lorekeep.llm.mixing import mix_sources
from lorekeep.llm.quality import quality_scores
from lorekeep.llm.queries import QUERIES
from lorekeep.llm.warc import archive_pages, lookup, read_records, surt, write_archives, write_index


# -- embeddings -----------------------------------------------------------------------------------


def plain_links(rows, threshold=0.93):
    ok = lambda e, lab: lab is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
    n, parent = len(rows), list(range(len(rows)))
    degree = [0] * n
    ids = [2**63 - 1 if r[0] is None else r[0] for r in rows]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la == lb and ok(a, la) and ok(b, lb) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    degree[i] += 1
                    degree[j] += 1
                    parent[root(i)] = root(j)
    low = {}
    for i in range(n):
        low[root(i)] = min(low.get(root(i), 2**63), ids[i])
    none = lambda x: None if x == 2**63 - 1 else x
    return sorted(((none(ids[i]), degree[i], none(low[root(i)]), ids[i] == low[root(i)]) for i in range(n)), key=repr)


def test_embeddings(spark, monkeypatch):
    import lorekeep.llm.embeddings as M

    monkeypatch.setattr(M, "BLOCK", 40)
    monkeypatch.setattr(M, "CAPS", 3)  # so that caps meet in several groups
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(420):
        c = centres[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in c * rng.choice([1, 1, 5])], int(i % 3) if i % 11 else None))
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, [None] + [1.0] * 15, 1), (505, [float("inf")] * 16, 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (None, rows[1][1], 1), (3, rows[3][1], 0), (3, rows[3][1], 0)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, h1 int").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_neardup(df).collect()), key=repr)
    assert got == plain_links(rows)
    assert embedding_neardup(df.limit(0)).count() == 0


def test_the_largest_id_is_no_null(spark):
    last = 2**63 - 1
    v = spark.createDataFrame([(last, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (None, [0.0, 1.0], "a"), (last, None, "a")], "vec_id long, embedding array<double>, label string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_neardup(v).collect()), key=repr)
    assert got == sorted([(last, 1, last, True), (None, 1, last, False), (None, 0, None, True), (last, 0, last, True)], key=repr)
    pages = spark.createDataFrame([(None, "u", "x"), (last, "u", "x"), (None, None, "y")], "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(pages).collect()}
    assert got == {(None, 1, "revisit", last), (last, 1, "response", None), (None, 1, "response", None)}


def test_embeddings_of_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 1), (None, [1.0, 0.01, 0.0], 1), (None, [0.01, 1.0, 0.0], 1), (9, [0.0, 0.0, 1.0], 1), (9, [-1.0, 0.0, 0.0], 1), (8, [0.0, 0.01, 1.0], 1), (7, [-1.0, 0.01, 0.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_neardup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    assert got == plain_links(rows) and {(1, 1), (2, 2), (8, 8), (7, 7), (9, 8), (9, 7)} <= {(a, c) for a, _, c, _ in got}


@pytest.mark.parametrize("k", [3, 100])
def test_cells_are_fitted_at_every_size(spark, sf, monkeypatch, k):
    import lorekeep.llm.embeddings as M

    fitted, plain = [], M.fit_cells
    monkeypatch.setattr(M, "fit_cells", lambda d, n: fitted.append(plain(d, n)) or fitted[-1])
    QUERIES["op1_embedding_neardup"](spark, sf)
    assert all(len(c.top) >= M.LEAST_CELLS for cells in fitted for c in cells.values()) and fitted[0]
    x = M.unit(np.random.default_rng(k).normal(size=(3000, 8)))
    cells = M.Cells(x, k).of(x)
    assert k / 2 <= len(set(cells.tolist())) <= 1.3 * k + 3


# -- quality and language -------------------------------------------------------------------------


def test_quality_on_the_held_out_fold(spark, sf):
    r = QUERIES["op5_quality_classifier"](spark, sf.replace("0.001", "0.01")).toPandas()
    lab = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet").toPandas()
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]).all() and r.score.between(0, 1).all() and ((r.score >= 0.3) == (r.predicted == 1)).all()
    m = r[r.held_out].merge(lab, on="doc_id")
    assert len(m) > 40 and (m.predicted == m.quality).mean() > 0.95


def test_bradley_terry_against_plain_descent():
    """Scores from the same pairs by plain gradient descent on the logistic loss of feature differences."""
    from lorekeep.llm.quality import BradleyTerry

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    y = (x @ [2.0, -1.0, 0.5, 0.0] + rng.normal(size=60) > 0).astype(int)
    bt = BradleyTerry(x, y, pairs=500, ridge=1e-2)
    good, bad = [i for i in range(60) if y[i]], [i for i in range(60) if not y[i]]
    draw = np.random.default_rng(7)
    a = [i for _ in range(-(-500 // len(good))) for i in draw.permutation(good).tolist()][:500]
    b = [i for _ in range(-(-500 // len(bad))) for i in draw.permutation(bad).tolist()][:500]
    mean, scale = x.mean(0), x.std(0)
    z = np.clip((x - mean) / scale, -8, 8)
    w = np.zeros(4)
    for _ in range(4000):
        d = z[a] - z[b]
        w = w - 0.5 * (1e-2 * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0))
    s = z @ w
    low = sorted(s)
    cut = (low[len(bad) - 1] + low[len(bad)]) / 2
    want = [1 / (1 + np.exp(-(v - cut + np.log(0.3 / 0.7)))) for v in s]
    assert np.allclose(bt.scores(x), want, atol=1e-5) and ((bt.scores(x) >= 0.3) == (s >= cut)).all()


def test_every_pair_of_labelled_documents_counts():
    """The model of all pairs against the loss of each pair's difference, written out."""
    from lorekeep.llm.quality import BradleyTerry, newton, some_pairs

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)) ** 3
    y = (x @ [2.0, -1.0, 0.5, 0.0, 1.0] + rng.normal(size=400) > 1).astype(int)
    bt = BradleyTerry(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    w = newton(np.zeros(5), *some_pairs((z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 5), 1e-3), 1e-3)
    assert np.abs(bt.w - w).max() < 1e-7


@pytest.mark.parametrize("labelled", [30, 1])
def test_quality_learns_from_every_label(spark, sf, labelled):
    """More labelled rows than the driver holds give the model of all of them."""
    from lorekeep.llm.quality import BradleyTerry, features, fit

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    learnt = sorted(i for i in label if i in text and zlib.crc32(str(i).encode()) % 5)
    assert len(learnt) > 2 * labelled
    x = np.array([features(text[i]) for i in learnt])
    want, got = BradleyTerry(x, np.array([label[i] for i in learnt])), fit(docs, labels, labelled=labelled)
    assert np.abs(got.scores(x) - want.scores(x)).max() < 1e-7


def test_quality_against_brute_force(spark, sf):
    """The query's scores from the features of each text, one by one, with a model fitted on rows that plain Python picks."""
    import lorekeep.llm.quality as Q

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    learnt = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 5)
    bt = Q.BradleyTerry(np.array([Q.features(docs[i]) for i in learnt]), np.array([labels[i] for i in learnt]))
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op5_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        want = float(bt.scores(Q.features(t)[None, :])[0])
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == (want >= 0.3)


def test_features_of_a_text():
    """The first features against their plain definitions."""
    import lorekeep.llm.quality as Q

    t = "Ab cd, ab 12\n\nXY  é\nAb cd, ab 12"
    x, n, words = Q.features(t), len(t.encode()), t.split()
    letters = lambda f: sum(map(f, t.encode())) / n
    up, low = letters(lambda b: 65 <= b <= 90), letters(lambda b: 97 <= b <= 122)
    want = [np.log1p(n), np.log1p(len(words)), up, low, letters(lambda b: 48 <= b <= 57), letters(lambda b: b > 127), letters(lambda b: b == 44), letters(lambda b: b == 32), letters(lambda b: b == 10)]
    assert np.allclose(x[:9], want) and abs(x[9] - up / (up + low + 1e-6)) < 1e-12 and abs(x[14] - 2 / 3) < 1e-12


def test_one_id_with_several_texts_is_learnt_alike(spark):
    rows = [(i % 20, f"text {'abc '[i % 4]} {i} " * (i % 7 + 1)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    runs = [sorted((r.doc_id, r.text, r.score) for r in quality_scores(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels).collect()) for x, n in ((rows, 1), (rows[::-1], 5))]
    assert runs[0] == runs[1]


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "text", "c"), (3, "x" * 200_000, "d"), (3, "x" * 200_000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, none).collect()
    assert {r.score for r in got} == {0.5} and len(got) == 5
    one = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 4)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality_scores(docs, one).collect())
    assert quality_scores(docs.limit(0), one).count() == 0


def test_automaton_against_greedy_parsing():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc ") for _ in range(300))
    auto = Automaton(text)
    for _ in range(50):
        query = bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(1, 60)))
        at, phrases = 0, 0
        while at < len(query):
            n = 1
            while at + n < len(query) and query[at : at + n + 1] in text:
                n += 1
            at, phrases = at + n, phrases + 1
        lanes = np.frombuffer(query, np.uint8)[:, None]
        assert int(auto.phrases(lanes, np.ones(len(query), int))[0]) == phrases


@pytest.mark.parametrize("query, phrases", [(b"abdc", 3), (b"dddd", 4), (b"abcabc", 1), (b"cab", 1), (b"d", 1), (b"acb", 3), (b"dabcd", 3)])
def test_phrases_of_small_cases(query, phrases):
    assert int(Automaton(b"abcabc").phrases(np.frombuffer(query, np.uint8)[:, None], np.ones(len(query), int))[0]) == phrases


def greedy(text, known):
    at, phrases = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in known:
            n += 1
        at, phrases = at + n, phrases + 1
    return phrases


def test_language_against_brute_force(spark, sf):
    """The query's rows from the fitted texts by substring search alone."""
    import lorekeep.llm.language as L

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {}
    plain = L.CrossParser.__init__
    try:
        L.CrossParser.__init__ = lambda self, t: (texts.update(t), plain(self, t))[1]
        L.fit(docs)
    finally:
        L.CrossParser.__init__ = plain
    assert set(texts) == {r.lang for r in docs.select("lang").distinct().collect() if r.lang}
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op9_language_id"](spark, sf).collect()}
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 6000]
    assert len(rows) > 100
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        raw = L.normal(r.text)
        cost = sorted((sum(greedy(raw[i : i + L.LANE], t) for i in range(0, len(raw), L.LANE)) * np.log2(len(t)) / len(raw), lang) for lang, t in texts.items())
        assert got[r.doc_id][0] == cost[0][1] and abs(got[r.doc_id][1] - cost[1][0] / (cost[0][0] + cost[1][0])) < 1e-12


def test_language_on_the_held_out_fold(spark, sf):
    big = sf.replace("0.001", "0.01")
    r = QUERIES["op9_language_id"](spark, big).toPandas().merge(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in r.doc_id]).all()
    h = r[r.held_out]
    assert len(h) > 150 and (h.lang_pred == h.lang).mean() > 0.97 and r.score.between(0, 1).all()


def test_language_cases(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta" if i % 2 else "uno dos tres cuatro", "xx" if i % 2 else "yy", 1) for i in range(40)] + [(90, None, "xx", 1), (91, "123 --- !", "yy", 1), (92, "", None, 1), (None, "uno dos", None, 1), (93, "alpha " * 60_000, None, 1)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0) and got[None][0] == "yy" and got[93][0] == "xx" and got[1][0] == "xx" and got[2][0] == "yy"
    assert {r.lang_pred for r in identify_language(docs.withColumn("lang", docs.lang.substr(99, 1)).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert identify_language(docs.limit(0)).count() == 0


def test_rare_languages_are_learnt(spark):
    rng = random.Random(9)
    words = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(80)}
    rows = [(1000 * i + j, " ".join(rng.choice(w) for _ in range(30)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(24 if i < 70 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_language(docs).toPandas()
    assert got.lang_pred.nunique() == 80 and (got.lang_pred == got.lang).all() and (got.score > 0.5).all()


# -- mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        tau = left / sum(w[s] for s in open_)
        full = {s for s in open_ if tau * w[s] > most * sizes[s] + 1e-9}
        if not full:
            target |= {s: tau * w[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, monkeypatch, seed):
    import lorekeep.llm.mixing as M

    monkeypatch.setattr(M, "LEVELS", 4)  # so that the level is enclosed in several rounds
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 5, 100, 10_000, 1_000_000]) + rng.randrange(3) for i in range(150)} | {None: 40}
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, total long").repartition(3)).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-9 * (1 + want[s]) for s in want)


def test_equal_texts_of_two_sources(spark):
    rows = [(1, "a b c d", "x")] * 2 + [(1, "a b c d", "y")] * 2 + [(i, "w " * i, "x") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mix_sources(docs).collect()
    want = {s: sum(r.copies for r in mix if r.doc_id == 1 and r.source == s) for s in "xy"}
    out = corpus_pipeline.STAGES[3][1](spark, docs, "").collect()
    assert {s: sum(r.doc_id == 1 and r.source == s for r in out) for s in "xy"} == want


def nearest(sizes, aim):
    """The distance to aim of the nearest sum with none, one or two of each size: all sums as bits of a number."""
    reach = 1
    for s in sizes:
        reach |= reach << s | reach << 2 * s
    return min(abs(i - aim) for i in range(max(0, int(aim) - 5000), int(aim) + 5000) if reach >> i & 1)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_targets_are_met_as_sums_allow(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    by_source = {}
    for r in mix_sources(docs).collect():
        by_source.setdefault(r.source, []).append(r)
    for rows in by_source.values():
        miss = abs(sum(r.taken for r in rows) - rows[0].target)
        assert abs(miss - nearest([r.size for r in rows], rows[0].target)) < 1e-6
        # few documents leave the rates that entropy balancing gave them
        assert sum(not np.floor(r.rate - 1e-9) <= r.copies <= np.ceil(r.rate + 1e-9) for r in rows) <= (len(rows) if len(rows) < 40 else len(rows) // 10)


def test_trades():
    from lorekeep.llm.mixing import EXACT, traded

    assert traded([3, 5, 1885], [1, 1, 0], [0] * 3, [2] * 3, 1893.0) == [1, 1, 1]
    assert traded([2, 2], [1, 1], [0] * 2, [2] * 2, 5.4) == [1, 2] or traded([2, 2], [1, 1], [0] * 2, [2] * 2, 5.4) == [2, 1]
    assert traded([], [], [], [], 7.0) == [] and traded([10], [1], [0], [2], 10.2) == [1]
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.choice([1, 7, 20, 400, 1885]) for _ in range(rng.randrange(1, 12))]
        copies, aim = [rng.randrange(3) for _ in sizes], rng.uniform(0, 2 * sum(sizes))
        new = traded(sizes, copies, [0] * len(sizes), [2] * len(sizes), aim)
        assert all(0 <= c <= 2 for c in new) and abs(abs(sum(a * b for a, b in zip(sizes, new)) - aim) - nearest(sizes, aim)) < 1e-6
    huge = [rng.randrange(10**8, 10**9) for _ in range(40)]
    new = traded(huge, [1] * 40, [0] * 40, [2] * 40, 1.3 * sum(huge))
    assert abs(sum(a * b for a, b in zip(huge, new)) - 1.3 * sum(huge)) < 100 * 2 * sum(huge) / EXACT


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 20, 20, 60, 400]), rng.choice(["hot"] * 8 + ["a", "b", "Z", None])) for i in range(1500)] + [(9001, None, "hot"), (None, "x y", "a"), (5, "x y", "a"), (5, "x y", "a"), (9002, "big " * 3000, "hot"), (9003, "", "empty")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, rate int, copies int")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken == r.copies * r.size <= 2 * r.size and 0 <= r.rate <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in want:  # as near as any choice of none, one or two copies comes
        assert abs(abs(taken[s] - want[s]) - nearest([r.size for r in got if r.source == s], want[s])) < 1e-6
    again = {(r.doc_id, r.size, r.taken) for r in mix_sources(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    assert mix_sources(docs.limit(0)).count() == 0


def test_rates_are_exponentially_tilted(spark):
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 3]) for i in range(900)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.rate * r.size for r in mine) - mine[0].target) < 1e-5 * mine[0].target
        free = [(r.size, np.log(r.rate)) for r in mine if r.rate < 2]
        if free:
            slopes = [y / x for x, y in free]
            assert max(slopes) - min(slopes) < 1e-9


# -- archives -------------------------------------------------------------------------------------


def plain_pages(rows):
    first, out = {}, []
    key = lambda d: 2**63 if d is None else d
    for d, _, h in rows:
        first[h or ""] = min(first.get(h or "", 2**64), key(d))
    for d, _, h in rows:
        raw = (h or "").encode()
        revisit = key(d) > first[h or ""]
        out.append((d, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=repr)


def test_archives(spark):
    rows = [(i, f"https://www.Example{i % 5}.org:443/a/{i % 50}?q={i}#f", "same" if i % 3 == 0 else f"<p>é {i}</p>" * (i % 7)) for i in range(700)] + [(900, None, None), (901, "::bad[", ""), (902, "x\ny", "z" * 300_000), (None, "http://h/", "same"), (7, "http://h/", f"<p>é {7}</p>" * 0)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, archive int").repartition(4)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_pages(pages).collect()), key=repr)
    assert got == plain_pages(rows)
    assert archive_pages(pages.limit(0)).count() == 0


def test_archives_of_repeated_ids(spark):
    rows = [(5, "http://h/1", "first payload"), (5, "http://h/2", "second and longer payload"), (10, "http://h/3", "second and longer payload"), (5, "http://h/4", ""), (None, "http://h/5", "only"), (None, "http://h/5", "only"), (11, "http://h/6", "first payload"), (12, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_pages(pages).collect()), key=repr)
    assert got == plain_pages(rows)


def test_lookup(spark, tmp_path):
    rows = [(i, f"http://host{i % 7}.net/p{i % 90}", f"body {i}") for i in range(900)]
    captures = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    index = write_index(captures, str(tmp_path / "w"), files=3)
    assert index.agg({"captures": "sum"}).first()[0] == 900
    keys = [surt("http://HOST3.net/p10") + " ", surt("http://host0.net/p0") + " ", "net,none)/ "]
    found = read_records(lookup(spark.createDataFrame([(k,) for k in keys], "key string"), index)).collect()
    want = {i for i, u, _ in rows if u in ("http://host3.net/p10", "http://host0.net/p0")}
    assert {r.page_id for r in found} == want and all(bytes(r.payload).decode() == f"body {r.page_id}" for r in found)


@pytest.mark.parametrize("url, key", [("https://Blog.Example.com:8080/A/b?X=1#z", "com,example,blog)/a/b?x=1"), (None, ")/"), ("http://a.b", "b,a)/")])
def test_keys(url, key):
    assert surt(url) == key


# -- pipeline -------------------------------------------------------------------------------------


def plain_rates(rows, targets, most=2.0):
    """The rate of each (source, size) by bisection on the dual."""
    out = {}
    for s in {s for s, _ in rows}:
        mine = [n for t, n in rows if t == s and n]
        if not mine:
            continue
        mean, goal = sum(mine) / len(mine), targets[s]
        rate = lambda n, lam: min(most, np.exp(min(50.0, lam * n / mean)))
        lo, hi = -1e4, 1e4
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if sum(rate(n, lam) * n for n in mine) < goal else (lo, lam)
        for n in mine:
            out[s, n] = most if goal >= most * sum(mine) * (1 - 1e-12) else rate(n, lam)
    return out


def test_pipeline(spark, sf):
    """run() against plain versions of its stages, each over what the plain one before it kept."""
    import lorekeep.llm.quality as Q
    from test_lines_jaccard import plain_jaccard, plain_lines
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    text = {r.doc_id: r.text for r in docs}
    learnt = sorted(i for i in labels if i in text and zlib.crc32(str(i).encode()) % 5)
    bt = Q.BradleyTerry(np.array([Q.features(text[i]) for i in learnt]), np.array([labels[i] for i in learnt]))
    kept = [(r.doc_id, r.text) for r in docs if bt.scores(Q.features(r.text)[None, :])[0] >= 0.3]
    kept = [(d, t) for d, _, gone, t in plain_lines(kept) if not gone or t]
    stand = {c for _, _, c in plain_jaccard(kept, 5, 80)}
    kept = [(d, t) for d, t in kept if d in stand]
    assert len(docs) > len(kept) > 50
    source = {r.doc_id: r.source for r in docs}
    words = {d: len((t or "").split()) for d, t in kept}
    sizes = {}
    for d, _ in kept:
        sizes[source[d]] = sizes.get(source[d], 0) + words[d]
    targets = plain_targets(sizes)
    rates = plain_rates([(source[d], words[d]) for d, _ in kept], targets)
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, list(r.ids), r.source))
    lib, taken = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")), {}
    traded = 0
    for d, t in kept:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        copies = got.pop(d, [])
        assert all(c == (len(ids), ids, source[d]) for c in copies)
        rate = rates.get((source[d], words[d]), 1.0)
        assert len(copies) <= 2
        traded += not np.floor(rate - 1e-6) <= len(copies) <= np.ceil(rate + 1e-6)
        taken[source[d]] = taken.get(source[d], 0) + len(copies) * words[d]
    assert not got
    assert traded <= 0.2 * len(kept)  # nearly every rate is rounded down or up
    for s, goal in targets.items():  # no choice of copies comes nearer to the target
        assert abs(abs(goal - taken[s]) - nearest([words[d] for d, _ in kept if source[d] == s], goal)) < 1e-6


def test_stages_against_their_operators(spark, sf):
    """Each stage keeps what its operator says, and the columns of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality, lines, near, mix, tokens = [f for _, f in corpus_pipeline.STAGES]
    a = quality(spark, docs, sf)
    good = {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in a.collect()} == good and a.columns == docs.columns
    b = lines(spark, a, sf)
    want = {r.doc_id: r.text for r in line_dedup(a).collect() if not (r.n_dropped and not r.text)}
    assert {r.doc_id: r.text for r in b.collect()} == want and all(r.n_chars == len(r.text) for r in b.collect())
    c = near(spark, b, sf)
    assert {r.doc_id for r in c.collect()} == {r.component_id for r in ngram_jaccard(b).collect()}
    d = mix(spark, c, sf)
    copies = {r.doc_id: r.copies for r in mix_sources(c).collect() if r.copies}
    got = {}
    for r in d.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == copies and d.columns == docs.columns
    assert tokens(spark, d, sf).count() == d.count()


BODY, OTHER = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))


@pytest.mark.parametrize(
    "rows, stay",
    [
        ([(1, BODY), (None, BODY + " more"), (None, OTHER)], [0, 2]),
        ([(1, BODY), (5, BODY + " more"), (5, OTHER)], [0, 2]),
        ([(None, BODY), (2**63 - 1, BODY + " more"), (2**63 - 1, OTHER)], [1, 2]),
        ([(None, BODY), (None, BODY + " more"), (None, None), (7, ""), (7, "a b")], None),
        ([(3, BODY), (3, BODY), (4, BODY)], [0, 1]),
    ],
)
def test_no_near_copy_stays_under_odd_ids(spark, rows, stay):
    near = corpus_pipeline.STAGES[2][1]
    docs = spark.createDataFrame([(d, t, i, 0) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row_1 int, stands int")
    got = sorted(r.row_1 for r in near(spark, docs, "").collect())
    assert got == stay if stay is not None else got in ([0, 2, 3, 4], [1, 2, 3, 4])


def test_the_last_stage_decodes(spark, sf, tmp_path, monkeypatch):
    """With a tokenizer that gives z's id to another string, a text doesn't come back."""
    import json

    spec = json.loads(open(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    spec["added_tokens"].append({"content": "wrong", "id": spec["model"]["vocab"]["z"]})
    path = tmp_path / "bpe.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    docs = spark.createDataFrame([(1, "z", "s", "en")], "doc_id long, text string, source string, lang string")
    tokens = corpus_pipeline.STAGES[-1][1]
    assert tokens(spark, docs, sf).count() == 1
    monkeypatch.setattr(corpus_pipeline.public_tokenizers, "path", lambda name: str(path))
    with pytest.raises(Exception, match="does not come back"):
        tokens(spark, docs.withColumn("text", docs.text), sf).collect()


@pytest.mark.parametrize("step", range(5))
def test_stages_take_odd_tables(spark, sf, step):
    rows = [(None, None, None, None, None, "k"), (1, "", "en", "s", 0, None), (1, "", "en", "s", 0, None), (2, "one two three four five six", None, "s", 3, "x"), (3, "long " * 20_000, "en", None, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string").selectExpr("*", "1 as kept", "2 as `row`", "3 as copies", "4 as copy", "5 as d", "6 as r", "7 as k", "8 as p", "9 as score")
    f = corpus_pipeline.STAGES[step][1]
    for docs in (df, df.limit(0)):
        out = f(spark, docs, sf)
        assert out.count() <= 2 * len(rows)
        if step < 4:
            assert out.columns == df.columns
