import random
import tracemalloc

import numpy as np
import pytest

from lorekeep.llm import bpe, common
from lorekeep.llm.common import connected_components
from lorekeep.llm.jaccard import ngram_jaccard, repeats, without_near_copies
from lorekeep.llm.lines import SEGMENT_BITS, line_dedup, positions, segments

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, seg string, tok long, n_lines string"


def test_the_largest_id_is_no_null(spark):
    last, text = 2**63 - 1, "a line of some length\nanother one that is long"
    rows = [(None, text), (last, text), (last, "x")]
    got = {(r.doc_id, r.n_dropped, r.text) for r in line_dedup(frame(spark, rows)).collect()}
    assert got == {(None, 2, ""), (last, 0, text), (last, 0, "x")}
    got = sorted(((r.doc_id, r.component_id, r.stands) for r in ngram_jaccard(frame(spark, rows), k=3, percent=90).collect()), key=repr)
    assert got == sorted([(None, last, False), (last, last, True), (last, last, True)], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(3)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_lines(rows, least=10):
    holders = {}
    key = lambda x: lower(x.strip(SPACE))
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(x.strip(SPACE)) >= least:
                holders.setdefault(key(x), set()).add(2**63 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), set())) > 1 and (2**63 if d is None else d) != min(h))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


CASES = [
    [],
    [(1, None), (2, ""), (None, None)],
    [(1, "A common line!\nown one here"), (2, " a COMMON line! \t\nshort\nshort"), (2, "a common line!"), (None, "a common line!\nx")],
    [(5, "same line twice\nsame line twice"), (6, "ÀÉ accented line"), (7, "àé accented line"), (8, "É accented lines\r"), (9, "É accented lines")],
    [(3, "x" * 300_000 + "\nshared shared"), (4, "shared shared\n" * 2000), (4, "y" * 9)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("bits", [None, 19])
def test_lines(spark, rows, bits):
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup(frame(spark, rows), filter_bits=bits).collect()), key=repr)
    assert got == plain_lines(rows)


def test_a_full_filter_is_still_right(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(f"line number {rng.randrange(3000)} of the pool" for _ in range(20))) for i in range(400)]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(frame(spark, rows), filter_bits=19).collect()), key=repr)
    assert got == plain_lines(rows)


def plain_jaccard(rows, k, percent):
    def words(t):
        out, w = [], ""
        for c in lower(t or ""):
            if c in SPACE:
                out, w = out + [w] * bool(w), ""
            else:
                w += c
        return out + [w] * bool(w)

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    ids = [2**63 - 1 if d is None else d for d, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), 2**63), d)
    none = lambda x: None if x == 2**63 - 1 else x
    return sorted(((none(ids[i]), len(sets[i]), none(low[root(i)])) for i in range(len(rows))), key=repr)


def corpus(seed, n=160):
    """Families of near copies, chains, copies, texts that share a passage, short and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(0, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(vocabulary)
        elif kind < 0.6:
            t = rng.choices(vocabulary, k=rng.randrange(0, 5))
        else:
            t = rng.choices(vocabulary, k=rng.randrange(20, 90))
            if kind < 0.8:
                t = passage + t
        texts.append(t)
        rows.append((i, " ".join(t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, rows[0][1]), (None, "alone here entirely now")]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, monkeypatch, k, percent, seed):
    import lorekeep.llm.jaccard as J

    monkeypatch.setattr(J, "MEMBERS", 16)  # so that groups are dealt into several blocks
    rows = corpus(seed)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(frame(spark, rows), k=k, percent=percent).collect()), key=repr)
    assert got == plain_jaccard(rows, k, percent)


def test_jaccard_of_null_and_repeated_ids(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(6)]
    near = lambda t, i: " ".join(t[:i] + ["other"] + t[i + 1 :])
    rows = [(10 + i, " ".join(t)) for i, t in enumerate(base)] + [(None, near(t, 0)) for t in base[:3]] + [(77, near(t, 59)) for t in base[2:5]]
    chain = [f"c{i}" for i in range(60)]  # 20 and 21 are linked only through a row without an id
    rows += [(20, " ".join(["x0", "x1"] + chain[2:])), (None, " ".join(chain)), (21, " ".join(chain[:58] + ["y0", "y1"])), (None, "q " * 3 + " ".join(chain[::-1]))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(frame(spark, rows), k=3, percent=90).collect()), key=repr)
    assert got == plain_jaccard(rows, 3, 90)
    assert {(21, 20), (77, 12), (77, 13), (77, 14), (None, 11)} <= {(d, c) for d, _, c in got}


def test_jaccard_of_nothing_and_of_a_long_text(spark):
    assert ngram_jaccard(frame(spark, [])).count() == 0
    long = " ".join(f"a{i}" for i in range(60_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(frame(spark, [(1, long), (2, long + " end"), (3, long)])).collect()}
    assert got == {1: (59_996, 1), 2: (59_997, 1), 3: (59_996, 1)}


def test_a_large_group_of_near_copies(spark, monkeypatch):
    import lorekeep.llm.jaccard as J

    monkeypatch.setattr(J, "MEMBERS", 64)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 120], f"x{i}", *base[i % 120 + 1 :]])) for i in range(600)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(frame(spark, rows), k=3, percent=90).collect()), key=repr)
    assert got == plain_jaccard(rows, 3, 90)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100), (None, 7)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    low = {}
    for a, b in edges:
        if a is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def python_deep(node):
    """Python evaluations that a task runs one into the other: (at the plan's top, at most anywhere)."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return python_deep(node.initialPlan())
    below = [python_deep(node.children().apply(i)) for i in range(node.children().size())]
    here = max((b[0] for b in below), default=0) + any(x in name for x in ("MapIn", "EvalPython", "InPandas", "InArrow"))
    return 0 if "Exchange" in name else here, max([here, *(b[1] for b in below)])


def test_a_task_needs_one_python_worker(spark, monkeypatch):
    seen = []
    deep = lambda df: seen.append(python_deep(df._jdf.queryExecution().executedPlan())[1])
    kind = type(spark.range(1))
    table, collect = common.Scratch.table, kind.collect
    monkeypatch.setattr(common.Scratch, "table", lambda self, df, *a, **b: deep(df) or table(self, df, *a, **b))
    monkeypatch.setattr(kind, "collect", lambda self: deep(self) or collect(self))
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (2, text + " end"), (3, "a common line of text\nx"), (4, "a common line of text\ny"), (5, None)]
    assert len(line_dedup(frame(spark, rows)).collect()) == 5
    assert len(without_near_copies(frame(spark, rows)).collect()) == 4
    assert max(seen) == 1 and sum(seen) > 10


def test_a_worker_lets_other_operators_go(monkeypatch):
    held = {"path": "a model"}
    monkeypatch.setitem(common.KEPT, "other", held)
    assert list(common.lean(iter, keeps="other")([1])) == [1] and held
    assert list(common.lean(iter)([1])) == [1] and not held
    assert bpe._MODELS is common.KEPT["bpe"]


def test_repeats():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << 40, n).astype(np.uint64) for n in (0, 400_000, 300_000)]
    parts.append(parts[1][:1000])
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    size = sum(x.nbytes for x in parts)
    tracemalloc.start()
    try:
        got = repeats(parts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0].tolist() == values[n > 1].tolist() and got[1].tolist() == n[n > 1].tolist()
    assert parts == [] and most < 1.5 * size
    assert [x.tolist() for x in repeats([np.zeros(0, np.uint64)])] == [[], []]


@pytest.mark.parametrize("bits", [19, 20, 24, 30])
def test_segments(bits):
    hashes = np.random.default_rng(4).integers(0, 1 << 64, 300_000, np.uint64)
    for some in (hashes, hashes[:2], hashes[:0]):
        want = {}
        for x in np.unique(positions(some, bits)).tolist():
            want.setdefault(x >> SEGMENT_BITS, []).append(x % (1 << SEGMENT_BITS))
        got = segments(some, bits)
        assert {s: p.tolist() for s, p in got.items()} == want and all(p.dtype == np.uint32 for p in got.values())
    del want, got
    tracemalloc.start()
    try:
        segments(hashes, bits)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 4 * hashes.nbytes
