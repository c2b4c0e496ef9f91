"""Main text of web pages by composite text density.

A page becomes a tree of elements in document order. Elements that are no article by their name,
role or class (menus, page headers, footers, sidebars, notices, adverts, forms, comments, what is
never shown) are taken out first. Every other node gets its composite text density: characters a
tag, adjusted by how many characters and tags belong to links. A container's density sum adds up
its children's densities, a run of its own text being a child too. The container of the largest sum
is the article; it becomes the <article> or <main> around it or the only <article> in it, or grows
to a parent whose other children are as dense as the thinnest node between the container and the
body.

Work and memory are linear in a page's length: one pass over its tags, sums from the last node to
the first, no recursion.
"""

from __future__ import annotations

import html
import re
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comment
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?P<close>>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",  # declarations and what no tag can be
    re.S,
)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden)(?![^\s=/])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements whose content is text up to their end tag.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style title textarea xmp iframe noembed noframes".split()}
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: Elements that begin and end a block of text.
_BLOCKS = _ENDS_P | frozenset("body caption legend optgroup option tbody td tfoot th thead tr".split())
#: What an element ends among its open neighbours, and where looking for them stops.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, **dict.fromkeys(("tr", "td", "th", "tbody", "tfoot"), {"table"})}
_CELLS = frozenset(("td", "th", "caption", "table", "button", "object"))
_BARE = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd figcaption summary legend caption".split())
_NEVER = frozenset("script style title textarea xmp iframe noembed noframes head template noscript svg object canvas audio video applet select datalist button map nav footer aside dialog menu search rp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in the class or id of an element that is no part of an article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion promoted "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead header topbar toolbar pagination pager "
    "comment comments commentlist disqus respond reply replies responses notice notices cookie cookies consent gdpr banner banners popup modal overlay alert "
    "newsletter subscribe subscription signup login share sharing social related recommended search".split()
)
#: Beside these a mark says something about another element.
_NOT_MARKS = frozenset("no has with without non hide show open opened closed enabled disabled layout".split())
_ARTICLE_HEADS = frozenset("post entry article content story".split())
#: Chrome's bound on the depth of a tree; deeper elements become siblings, their text stays.
DEEPEST = 512
#: A neighbour is part of the article if its density sum is at least this share of the container's.
PART = 0.2


def marked(attrs: str) -> tuple[bool, bool]:
    """(no part of an article, a comment) by role, class, id and style."""
    out = comment = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "style" and _HIDDEN.search(value)):
            return True, False
        if name == "role":
            out = out or value.strip().lower() in _ROLES
        elif name != "style":
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one)} | {one.lower()}
                hits = words & _MARKS
                if "header" in hits and words & _ARTICLE_HEADS:
                    hits.discard("header")
                if hits and not words & _NOT_MARKS:
                    out = True
                    comment = comment or bool(hits & {"comment", "comments", "commentlist", "disqus"})
    return out, comment


class Page:
    """The elements of a page in document order, each with its parent, and the runs of text in them."""

    def __init__(self, source: str):
        self.names, self.parents, self.marks, self.comments = ["body"], [-1], [False], [False]
        self.runs: list[tuple[int, str]] = []  # (element, text), and (element, None) where a block begins or ends
        self.stack, self.open = [0], {}
        at = 0
        while m := _TAG.search(source, at):
            self.text(source[at : m.start()])
            at, name = m.end(), (m["name"] or "").lower()
            if m["name"] is None or (not m["close"] and at == len(source)):  # comments; a tag that the end cuts off
                continue
            if m["end"]:
                self.end(name)
                continue
            self.start(name, m["attrs"])
            if name in _RAW:  # none of them is shown as text
                stop = _RAW[name].search(source, at)
                at = stop.start() if stop else len(source)
        self.text(source[at:])

    def text(self, t: str) -> None:
        if t:
            self.runs.append((self.stack[-1], html.unescape(t) if "&" in t else t))

    def pop(self) -> None:
        name = self.names[self.stack.pop()]
        self.open[name] -= 1
        if name in _BLOCKS:
            self.runs.append((self.stack[-1], None))

    def start(self, name: str, attrs: str) -> None:
        if name in ("html", "body"):
            return
        if name in _ENDS_P and self.open.get("p"):
            self.close({"p"}, _CELLS)
        if name in _ENDS and any(self.open.get(x) for x in _ENDS[name]):
            while self.close(_ENDS[name], _STOPS[name]):
                pass
        if name == "a" and self.open.get("a"):
            self.end("a")
        if name == "br":
            self.runs.append((self.stack[-1], " "))
        out, comment = marked(attrs) if attrs and name not in _INLINE else (False, False)
        self.names.append(name)
        self.parents.append(self.stack[-1])
        self.marks.append(out)
        self.comments.append(comment)
        if name in _BLOCKS:
            self.runs.append((self.stack[-1], None))
        if name in _VOID or name in _RAW or len(self.stack) >= DEEPEST:
            return
        self.stack.append(len(self.names) - 1)
        self.open[name] = self.open.get(name, 0) + 1

    def close(self, names: set[str], stops) -> bool:
        """End the innermost open element of these names, unless one of stops lies in between."""
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.names[self.stack[i]]
            if name in names:
                while len(self.stack) > i:
                    self.pop()
                return True
            if name in stops:
                return False
        return False

    def end(self, name: str) -> None:
        if name == "p" and not self.open.get("p"):
            self.runs.append((self.stack[-1], None))
        if not self.open.get(name):
            return
        if name not in _INLINE:
            self.close({name}, () if name in ("table", "td", "th", "tr", "caption") else ("table",))
            return
        for i in range(len(self.stack) - 1, 0, -1):  # an inline end tag ends nothing beyond its block
            other = self.names[self.stack[i]]
            if other == name or other not in _INLINE:
                if other == name:
                    while len(self.stack) > i:
                        self.pop()
                return

    def outside(self) -> list[bool]:
        """For each element whether it lies in something that is no part of an article."""
        n, names = len(self.names), self.names
        holds = [x in ("article", "main", "h1") for x in names]
        for i in range(n - 1, 0, -1):
            # a comment is no article, however it is made
            if holds[i] and not self.comments[i] and names[i] not in _NEVER and names[i] != "header":
                holds[self.parents[i]] = True
        out, inside = [False] * n, [False] * n
        for i in range(1, n):
            p, name = self.parents[i], names[i]
            inside[i] = inside[p] or name in ("article", "main")
            gone = name in _NEVER or (name == "header" and not inside[p]) or (name == "form" and not holds[i]) or (self.marks[i] and (self.comments[i] or not holds[i]))
            out[i] = out[p] or gone
        return out


def densities(page: Page, out: list[bool]) -> tuple[list[float], list[float]]:
    """(density, density sum) of each element; both are 0 outside of the article's reach."""
    n, names, parents = len(page.names), page.names, page.parents
    link = [False] * n
    for i in range(1, n):
        link[i] = names[i] == "a" or link[parents[i]]
    chars, of_links, tags, links, own = [0] * n, [0] * n, [0] * n, [0] * n, [[] for _ in range(n)]
    whole = whole_links = 0
    for i, t in page.runs:
        if not t:
            continue
        k = len("".join(t.split()))
        whole += k
        whole_links += k * link[i]
        if k and not out[i]:
            chars[i] += k
            of_links[i] += k * link[i]
            own[i].append(k)
    for i in range(n - 1, 0, -1):
        if not out[i]:
            p = parents[i]
            chars[p] += chars[i]
            of_links[p] += of_links[i]
            tags[p] += tags[i] + 1
            links[p] += links[i] + (names[i] == "a")
    ratio = whole_links / whole if whole else 0.0

    def density(c: int, t: int, lc: int, lt: int) -> float:
        t = t or 1
        base = log(c / max(1, c - lc) * lc + ratio * c + e)
        # without links on a page the base is 1 and the plain density remains
        return c / t * (max(0.0, log(c / (lc or 1) * t / (lt or 1))) / log(base) if base > 1 + 1e-9 else 1.0)

    found, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if out[i] or not chars[i]:
            continue
        found[i] = density(chars[i], tags[i], of_links[i], links[i])
        sums[i] += sum(density(k, 1, k * link[i], int(link[i])) for k in own[i])
        if i:
            sums[parents[i]] += found[i]
    return found, sums


def article_of(page: Page, out: list[bool]) -> tuple[int, int | None]:
    """(the article's element, a headline before it or None); marks in out what it holds beside the article."""
    found, sums = densities(page, out)
    names, parents = page.names, page.parents
    # of equal sums the outermost, which comes first
    best = max((i for i in range(len(names)) if not out[i] and (i == 0 or (names[i] not in _INLINE and names[i] not in _BARE))), key=lambda i: (sums[i], -i))
    path = [best]
    while path[-1]:
        path.append(parents[path[-1]])
    around = [i for i in path if names[i] == "article"] or [i for i in path if names[i] == "main"]
    if around and names[around[-1]] == "article":
        return around[-1], None
    below = {around[-1] if around else best}
    inner = []
    for i in range(min(below) + 1, len(names)):
        if parents[i] in below and not out[i]:
            if names[i] == "article" and found[i]:
                inner.append(i)
            else:
                below.add(i)
    if len(inner) == 1:  # the only article in what is chosen
        return inner[0], None
    if around:
        return around[-1], None
    children: dict[int, list[int]] = {}
    for i in range(1, len(names)):
        if not out[i]:
            children.setdefault(parents[i], []).append(i)
    least = min(found[i] for i in path)
    top = best
    if best == 0:  # several parts in the body: start from the largest that is more than a paragraph
        whole = [j for j in children.get(0, ()) if names[j] not in _INLINE and names[j] not in _BARE and any(found[k] for k in children.get(j, ()))]
        best = max(whole, key=lambda j: (sums[j], -j), default=0)
        path = [best, 0] if best else path
    for below, i in zip(path, path[1:]):
        part = {j for j in children.get(i, ()) if names[j] not in _INLINE and sums[j] >= PART * sums[best] and found[j] >= least}
        if part - {below}:
            top = i
            # its other containers are too thin for parts of the article, its own headings and paragraphs stay
            for j in children[i]:
                out[j] = names[j] not in _INLINE and names[j] not in _BARE and j not in part and j != below
    heads = [i for i in range(1, len(names)) if names[i] == "h1" and not out[i]]
    within = {top}
    for i in range(top + 1, len(names)):
        if parents[i] in within:
            within.add(i)
    return top, heads[0] if len(heads) == 1 and heads[0] < top and heads[0] not in within else None


def main_text(source: str | None) -> str:
    """The article's blocks, white space turned into single spaces, joined by two line ends."""
    page = Page(source or "")
    out = page.outside()
    top, head = article_of(page, out)
    n = len(page.names)
    chosen = [False] * n
    for i in range(n):
        chosen[i] = not out[i] and (i in (top, head) or (i > 0 and chosen[page.parents[i]]))
    blocks, held = [], []
    for i, t in (*page.runs, (0, None)):
        if t is None:
            if block := " ".join("".join(held).split()):
                blocks.append(block)
            held = []
        elif chosen[i]:
            held.append(t)
    return "\n\n".join(blocks)


def extract_html(pages: DataFrame) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars.

    text is the page's article: its blocks in page order, character references decoded, white space
    (Unicode's) inside a block turned into one space, trimmed, joined by two line ends; headings
    inside the article are blocks of it. A null or empty page, and one without an article, has ''.
    Text without any markup is one block. Broken markup is read as browsers do: open paragraphs,
    items and cells end where the next begins, what an unfinished tag or script swallows is gone,
    elements beyond depth 512 become siblings. Rows that repeat, and null or equal ids, each keep
    their row. More columns, under any name, are ignored. Pages are independent, so no row moves.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [main_text(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    bounded(pages.sparkSession)
    types = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    read = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    found = read.mapInArrow(lean(run), f"page_id {types[0]}, url {types[1]}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
