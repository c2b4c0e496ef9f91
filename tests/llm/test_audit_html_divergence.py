import html as entities
import itertools
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from lorekeep.llm import divergence as D
from lorekeep.llm.audit import filter_audit
from lorekeep.llm.divergence import source_divergence
from lorekeep.llm.html import extract_html, main_text

# -- filter audit ---------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order applied to every row, one filter after another."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}  # a null id has no label
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in first and (d is None or first[t] < d)}
        rows.append((s or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                redundant = sum(x in r[1] and bool(r[1] & set(order[: step - 1])) for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_against_plain_orders(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a" * 3, "AB c", "one # two", " ".join(f"w{i}" for i in range(60)), "same words " * 40, "Ärger ÀÉ " * 30, "x" * 200_000, "w W " * 50_000, " ".join(f"Word{i}" for i in range(80)) + " |"]
    docs = [(rng.choice([None, 2**63 - 1, *range(60)]), rng.choice(texts), rng.choice([None, "", "a", "b", "hot", "hot", "hot"])) for _ in range(400)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 50)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, source string, part int, mask int, n int").repartition(5)
    got = audited(filter_audit(d, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")))
    assert got == plain_audit(docs, labels)
    assert len(got) == 600 * 4


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(empty, no_labels).count() == 0
    one = audited(filter_audit(spark.createDataFrame([(1, None, None)], empty.schema), no_labels))
    assert len(one) == 600 and one["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and one["", "BACDE", 1] == [1, 0, 0, 0, 0, 0, 0]


# -- HTML -----------------------------------------------------------------------------------------


class PlainArticle(HTMLParser):
    """Blocks of the <article> of a page whose only broken markup are open paragraphs and bold runs."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks, self.held = False, [], []
        self.feed(page)
        self.close()

    def flush(self):
        if block := " ".join("".join(self.held).split()):
            self.blocks.append(block)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag == "br":
            self.held.append(" " if self.inside else "")
        elif tag not in ("b", "a"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.held.append(data)


def test_whole_pages_against_another_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract_html(pages).collect()}
    for r in pages.collect():
        want = "\n\n".join(PlainArticle(r.html).blocks)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) > 0 and got[r.page_id].url == r.url


A = "Some words of the article that go on for a while, so that it is as dense as text is."
P = f"<p>{A}</p>"
MENU = '<div id="m1">' + "".join(f'<a href="/{i}">Entry {i}</a> ' for i in range(9)) + "</div>"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("<html><body><nav><a href=x>y</a></nav></body></html>", []),
        ("no &lt;markup&gt; at\n\tall ", ["no <markup> at all"]),
        (f"{MENU}<div class=c1>{P * 3}</div><div class=c2>Copyright 2020 someone</div>", [A] * 3),
        (f"{MENU}<div class=c1>{P * 3}</div><div class=c7>{P * 2}</div><div class=c2>Copyright 2020</div>", [A] * 5),
        (f"<header><h1>Site</h1></header><main><h1>Title</h1>{P}</main><footer>{P}</footer>", ["Title", A]),
        (f"<article><header><h1>Title</h1></header>{P}</article><aside>{P * 4}</aside>", ["Title", A]),
        (f"<div class='site-header'>Site</div><div><h1>Title</h1><div>{P * 3}</div></div>", ["Title", *[A] * 3]),
        (f"<article>{P}</article><section id='comments'><article class='comment'>{P * 9}</article></section>", [A]),
        (f"<article>{P}<div class='cookie-notice'>{A}</div><form><input value=x><p>{A}</p><button>Go</button></form></article>", [A]),
        (f"<div class='page has-sidebar'><article>{P}</article><div class=sidebar>{P * 3}</div></div>", [A]),
        (f"<form id=aspnet><article>{P}<textarea>t</textarea></article></form>", [A]),
        (f"<article>{P}<div hidden>{A}</div><div style='display: none'>{A}</div><template>{A}</template></article>", [A]),
        ("<article><p>one<p>two<ul><li>three<li>four</ul><table><tr><td>five<td>six</table></article>", ["one", "two", "three", "four", "five", "six"]),
        ("<article><p>a<script>x='<p>'</script>b<b>c<br>d</p><!-- <p>no --> e &eacute;&#x41;&amp;lt;&nbsp;f</article>", ["abc d", "e éA&lt; f"]),
        ("<article><p>a</p><script>never closed <p>b</p></article>", ["a"]),
        ("<article><p>a < b and <3</p><p>cut <a href='", ["a < b and <3", "cut"]),
        ("<article><div>" + "<div>" * 3000 + "deep" + P, ["deep", A]),
        ('<article><p class="x" title="a > b">one</p></article >', ["one"]),
        ("<article><pre>a\n  b</pre><h2>c</h2>tail</article>", ["a b", "c", "tail"]),
    ],
)
def test_pages(page, want):
    assert main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a ="' * 150_000, "<!--" * 100_000, "<div>" * 100_000, "<p><b>" * 50_000, "<b>" * 60_000 + "</i>" * 60_000, "<" * 300_000, "&" * 300_000, "</p>" * 60_000, "<script>" * 60_000])
def test_long_broken_pages(page):
    assert set(main_text(page)) <= set("<&")


def test_odd_tables_of_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(None, None, None, "x", 1), (5, "u", P, "x", 1), (5, "u", P, "x", 1), (2**63 - 1, "", f"<p>{'w ' * 300_000}</p>", "x", 1)]
    got = extract_html(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, None, "", 0), (5, "u", A, len(A)), (5, "u", A, len(A)), (2**63 - 1, "", ("w " * 300_000).strip(), 599_999)], key=repr)
    assert extract_html(spark.createDataFrame([], schema)).count() == 0
    assert entities.unescape("&amp;") == "&"


# -- divergence -----------------------------------------------------------------------------------


def plain_divergence(docs, least_docs):
    counts, held, places = {}, {}, {}
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        counts.setdefault((lang, source), Counter()).update(words)
        held.setdefault(lang, Counter()).update(set(words))
        places.setdefault(lang, set()).add(source)
    out = set()
    for lang, sources in places.items():
        kept = [w for w, n in held[lang].items() if n >= least_docs]

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(far(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources - {s}))
            terms = sorted((-far(p[s][w], q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w])[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


SMALL = [{}, {"depth": 1, "most": 5, "piece": 3, "held": 20}, {"depth": 2, "most": 40, "piece": 1, "held": 7}]


@pytest.mark.parametrize("small", SMALL)
def test_divergence_against_plain_counts(spark, monkeypatch, small):
    rng = random.Random(8)
    stems = ["a", "ab", "abc", "abcd", "abcdefghi", "é", "éa", "日本", "日本語", "z" * 300, "zz", "Ab", "ÄB"]
    docs = [(rng.choice(["x", "x", "x", "y", None]), rng.choice(["hot", "hot", "hot", "b", "é", None, ""]), " ".join(rng.choice(stems) + rng.choice(["", "", "q", "Q", "1b"]) for _ in range(rng.randrange(12)))) for _ in range(300)]
    docs += [("x", "none", None), ("x", "none", ""), ("only", "one", "abc " * 20), ("bare", "p", "1 2 3"), ("bare", "q", None), ("x", "long", "abc, " * 60_000), *[("x", "b", "abc ab")] * 30]
    table = spark.createDataFrame([(*r, 1, 2) for r in docs], "lang string, source string, text string, n int, value int").repartition(4)
    for salted in (False, True):
        if salted:
            monkeypatch.setattr(D, "SMALL", 0)
        got = source_divergence(table, least_docs=5, **small)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == plain_divergence(docs, 5)
        if not small:
            break


def test_divergence_of_nothing(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_sums_of_many_sources_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(D, "PAIRS", 4)
    monkeypatch.setattr(D, "CELLS", 8)
    docs = [("x", f"s{i % 7}", f"a b c{i % 3} d{i % 2}") for i in range(80)]
    got = source_divergence(spark.createDataFrame(docs, "lang string, source string, text string"), piece=2).collect()
    assert {tuple(r) for r in got} == plain_divergence(docs, 10)


def test_tries_fold_as_they_merge(monkeypatch):
    monkeypatch.setattr(D, "FOLD", 10)
    gathered, want = D.Gathered(), Counter()
    rng = random.Random(1)
    for k in range(60):
        counts = Counter(rng.choice(["a", "ab", "abc", "b", "bc", f"x{k % 9}"]).encode() for _ in range(6))
        words = list(counts)
        one = D.Trie(words, D.np.ones(len(words), int), D.np.arange(len(words)), D.np.zeros(len(words), int), D.np.array([counts[w] for w in words]), [f"s{k % 4}"])
        for row in one.subtrees("x", 1):
            gathered.add(dict(zip(D._FIELDS, row)))
        want += counts
    t = gathered.merged()
    assert t.words == sorted(want)
    got = Counter()
    for leaf, n in zip(t.leaf.tolist(), t.n.tolist()):
        got[t.words[leaf]] += n
    assert got == want


def test_shares_of_very_large_counts_are_exact():
    counts, total = D.np.array([0, 1, 10**12, 8 * 10**14]), D.np.array([9 * 10**14])
    assert D.smoothed(counts, total).tolist() == [1 + 10**9 * (c + 2) // (9 * 10**14) for c in counts.tolist()]
