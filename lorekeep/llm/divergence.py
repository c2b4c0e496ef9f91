"""Source divergence audit: how far the sources of a language differ in their words.

Words are counted in byte tries. A trie is kept in preorder, as what a walk over a radix tree
meets: leaves in the order of their UTF-8 bytes, each with the length of the prefix that it shares
with the leaf before it (the depth of the node where its edge branches off), the bytes of that
edge, and counters by source. Such tries merge by one pass in byte order, and a subtree is a run
of leaves, so the tries of all tasks are cut at the same prefixes, each prefix range goes to one
task, and the task merges what it got. Ranges that hold many leaves are cut deeper first.

A second walk over the merged tries, now with each language's totals beside it, streams the sums
for pairs of sources and the best words of each source, ties in byte order.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded, lean

LEAST_DOCS, SCALE, BEST = 10, 1_000_000_000, 10
#: Words are runs of these bytes: ASCII letters and all bytes of other characters.
_LETTERS = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalpha())
_CLEAN = bytes(b if b in _LETTERS else 0x20 for b in range(256)).lower()
#: Counters that a task holds before it hands its tries on, and that a merge gathers before it folds them.
HELD, FOLD = 400_000, 400_000
#: Bytes of a prefix at first, leaves of a prefix range beyond which it is cut twice as deep, and leaves of a merged piece.
DEPTH, RANGE, PIECE = 2, 1_000_000, 4096
#: Cells of a block of words and sources, and sums by pair that a task holds.
CELLS, PAIRS = 1 << 20, 1 << 21
#: Bytes of the languages' table up to which it is broadcast, and keys for a language's pieces beyond.
SMALL, SALTS = 8 << 20, 32


class Trie:
    """Leaves in byte order: words, the documents that hold each, and counters (leaf, source, count).

    Counters are ordered by leaf; sources are numbers into names. Building one from the leaves of
    others merges them.
    """

    def __init__(self, words: list[bytes], docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, n: np.ndarray, names: list[str], least_docs: int = 1):
        self.words = sorted(set(words))  # runs that are sorted already are merged
        at = {w: i for i, w in enumerate(self.words)}
        own = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        self.docs = np.zeros(len(self.words), np.int64)
        np.add.at(self.docs, own, docs)
        if least_docs > 1:
            kept = self.docs >= least_docs
            self.words = [w for w, k in zip(self.words, kept.tolist()) if k]
            self.docs = self.docs[kept]
            there = kept[own[leaf]]
            leaf, source, n, own = leaf[there], source[there], n[there], (np.cumsum(kept) - 1)[own]
        key = own[leaf] * len(names) + source
        if len(key) and not (np.diff(key) > 0).all():
            key, back = np.unique(key, return_inverse=True)
            n, whole = np.zeros(len(key), np.int64), n
            np.add.at(n, back, whole)
        self.leaf, self.source, self.n, self.names = key // max(1, len(names)), key % max(1, len(names)), n, names

    def __len__(self) -> int:
        return len(self.words)

    def shared(self, least: int) -> np.ndarray:
        """How many bytes each word shares with the one before it, up to 32, or up to least where that is more."""
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        heads = np.array([w[:32] for w in self.words], "S32").view(np.uint8).reshape(-1, 32)
        same = np.minimum.accumulate(heads[1:] == heads[:-1], axis=1).sum(axis=1)
        same = np.concatenate([[0], np.minimum(same, np.minimum(size[1:], size[:-1]))]).astype(np.int64)
        for i in np.flatnonzero(same == 32).tolist() if least > 32 else ():
            a, b = self.words[i - 1][:least], self.words[i][:least]
            same[i] = len(commonprefix((a, b)))
        return same

    def subtrees(self, lang: str, depth: int, most: int | None = None):
        """Rows (_FIELDS), packed: a subtree for each prefix of depth bytes, of most leaves at most where that is given."""
        if not self.words:
            return
        size, inner = np.fromiter(map(len, self.words), np.int64, len(self.words)), self.shared(depth)
        first = inner < depth if depth else np.zeros(len(inner), bool)
        first[:: most or len(inner)] = True
        first[0] = True
        inner[first] = 0
        text = np.frombuffer(b"".join(self.words), np.uint8)
        cut = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) >= np.repeat(inner, size)
        edges, edge_ends = text[cut].tobytes(), np.concatenate([[0], np.cumsum(size - inner)])
        starts = np.flatnonzero(first)
        fan = np.bincount(self.leaf, minlength=len(self.words))
        counters = np.concatenate([[0], np.cumsum(fan)])
        columns = [x.astype(t) for x, t in ((inner, "<i4"), (size - inner, "<i4"), (self.docs, "<i8"), (fan, "<i4"), (self.n, "<i8"))]
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(self.words)]):
            c, d = int(counters[i]), int(counters[j])
            used, number = np.unique(self.source[c:d], return_inverse=True)
            yield (
                lang, self.words[i][:depth], columns[0][i:j].tobytes(), columns[1][i:j].tobytes(), edges[edge_ends[i] : edge_ends[j]], columns[2][i:j].tobytes(),
                columns[3][i:j].tobytes(), number.astype("<i4").tobytes(), columns[4][c:d].tobytes(), [self.names[u] for u in used.tolist()], j - i,
            )


_FIELDS = ("lang", "prefix", "depth", "size", "edges", "docs", "fan", "source", "n", "sources", "leaves")
PIECES = "lang string, prefix binary, depth binary, size binary, edges binary, docs binary, fan binary, source binary, n binary, sources array<string>, leaves long"
_ARROW = pa.schema([("lang", pa.string()), *[(c, pa.binary()) for c in _FIELDS[1:9]], ("sources", pa.list_(pa.string())), ("leaves", pa.int64())])


def leaves_of(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, docs, leaf, source, n) of a packed trie: a walk in byte order."""
    words, word, edges, at = [], b"", row["edges"], 0
    for d, size in zip(np.frombuffer(row["depth"], "<i4").tolist(), np.frombuffer(row["size"], "<i4").tolist()):
        word = word[:d] + edges[at : at + size]
        words.append(word)
        at += size
    fan = np.frombuffer(row["fan"], "<i4")
    return words, np.frombuffer(row["docs"], "<i8"), np.repeat(np.arange(len(fan)), fan), np.frombuffer(row["source"], "<i4").astype(np.int64), np.frombuffer(row["n"], "<i8")


class Gathered:
    """Packed tries to be merged: folded whenever as much came as is held, so that what they share is held once."""

    def __init__(self, least_docs: int = 1):
        self.least_docs, self.names, self.parts, self.folded, self.new = least_docs, {}, [], 0, 0

    def add(self, row: dict) -> None:
        words, docs, leaf, source, n = leaves_of(row)
        numbers = np.array([self.names.setdefault(s, len(self.names)) for s in row["sources"]], np.int64)
        self.parts.append((words, docs, leaf, numbers[source], n))
        self.new += len(n)
        if self.new > max(FOLD, self.folded) and len(self.parts) > 1:
            t = self.trie(1)
            self.parts, self.folded, self.new = [(t.words, t.docs, t.leaf, t.source, t.n)], len(t.n), 0

    def trie(self, least_docs: int) -> Trie:
        words = [w for p in self.parts for w in p[0]]
        shift = np.cumsum([0, *[len(p[0]) for p in self.parts]])
        docs, leaf, source, n = (np.concatenate([p[k] + (shift[i] if k == 2 else 0) for i, p in enumerate(self.parts)]) for k in (1, 2, 3, 4))
        return Trie(words, docs, leaf, source, n, list(self.names), least_docs)

    def merged(self) -> Trie:
        return self.trie(self.least_docs)


def in_batches(rows, most_rows: int = 4096, most_bytes: int = 4 << 20):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[4]) + 3 * len(r[8])
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_CLEAN).split()


def count_words(depth: int, most: int):
    """Task: rows (lang, source, text) to packed subtrees."""

    def out(lang: str, groups: dict[str, Counter], docs: Counter):
        words, names = list(docs), list(groups)
        at = {w: i for i, w in enumerate(words)}
        leaf = np.concatenate([np.fromiter(map(at.__getitem__, c), np.int64, len(c)) for c in groups.values()])
        n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in groups.values()])
        source = np.repeat(np.arange(len(names)), [len(c) for c in groups.values()])
        yield from Trie(words, np.fromiter(docs.values(), np.int64, len(words)), leaf, source, n, names).subtrees(lang, depth)

    def rows(batches):
        groups, in_docs, held = {}, {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                if not words:
                    continue
                counts, docs = groups.setdefault(lang, {}).setdefault(source, Counter()), in_docs.setdefault(lang, Counter())
                before = len(counts)
                counts.update(words)
                docs.update(set(words))
                held += len(counts) - before
                if held >= most:
                    for g in sorted(groups):
                        yield from out(g, groups.pop(g), in_docs.pop(g))
                    held = 0
        for g in sorted(groups):
            yield from out(g, groups.pop(g), in_docs.pop(g))

    return lean(lambda batches: in_batches(rows(batches)))


def rows_of(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            yield from batch.slice(i, 64).to_pylist()


def cut_deeper(depth: int):
    """Task: packed subtrees to the subtrees below them whose prefixes have depth bytes."""

    def rows(batches):
        for r in rows_of(batches):
            one = Gathered()
            one.add(r)
            yield from one.merged().subtrees(r["lang"], depth)

    return lean(lambda batches: in_batches(rows(batches)))


def merge_ranges(least_docs: int, piece: int):
    """Task: packed subtrees sorted by (lang, prefix) to pieces of merged leaves that enough documents hold.

    Neighbouring small ranges are merged together, so that pieces are few.
    """

    def rows(batches):
        held, lang = Gathered(least_docs), None
        for (g, _), same in groupby(rows_of(batches), lambda r: (r["lang"], r["prefix"])):
            if held.parts and (g != lang or held.folded + held.new > FOLD // 2):
                yield from held.merged().subtrees(lang, 0, piece)
                held = Gathered(least_docs)
            lang = g
            for r in same:
                held.add(r)
        if held.parts:
            yield from held.merged().subtrees(lang, 0, piece)

    return lean(lambda batches: in_batches(rows(batches)))


def word_tries(docs: DataFrame, scratch: Scratch, *, least_docs: int = LEAST_DOCS, held: int = HELD, depth: int = DEPTH, most: int = RANGE, piece: int = PIECE) -> DataFrame:
    """Merged pieces (PIECES) of docs (lang, source, text): words in at least least_docs documents of their language."""
    tries = scratch.table(docs.mapInArrow(count_words(depth, held), PIECES), "counted")
    for step in range(1, 1 << 20):
        at = depth << (step - 1)
        full = tries.groupBy("lang", "prefix").agg(F.sum("leaves").alias("all")).where((F.col("all") > most) & (F.length("prefix") == at))
        full = scratch.table(full.select("lang", "prefix"), f"full{step}")
        if full.isEmpty():
            break
        # only ranges of more than `most` leaves are cut again; the others stay as they are
        deep = tries.join(full, ["lang", "prefix"], "left_semi").select(*tries.columns).mapInArrow(cut_deeper(2 * at), PIECES)
        tries = scratch.table(tries.join(full, ["lang", "prefix"], "left_anti").select(*tries.columns).union(deep), f"cut{step}")
    ordered = tries.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    pieces = scratch.table(ordered.mapInArrow(merge_ranges(least_docs, piece), PIECES), "merged")
    scratch.drop("counted", *[f"cut{i}" for i in range(1, step)])
    return pieces


def piece_totals(batches):
    """Task: pieces to (lang, source, n, words): counts by source, and with a null source the number of leaves."""
    totals, words = Counter(), Counter()
    for r in rows_of(batches):
        words[r["lang"]] += r["leaves"]
        sums = np.zeros(len(r["sources"]), np.int64)
        np.add.at(sums, np.frombuffer(r["source"], "<i4"), np.frombuffer(r["n"], "<i8"))
        for s, n in zip(r["sources"], sums.tolist()):
            totals[r["lang"], s] += n
        if len(totals) > HELD:
            yield from _totals(totals, words)
            totals, words = Counter(), Counter()
    yield from _totals(totals, words)


def _totals(totals: Counter, words: Counter):
    rows = [(g, s, n, 0) for (g, s), n in totals.items()] + [(g, None, 0, n) for g, n in words.items()]
    if rows:
        g, s, n, w = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(s, pa.string()), pa.array(n, pa.int64()), pa.array(w, pa.int64())], ["lang", "source", "n", "words"])


def smoothed(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / totals), exactly: three decimal places of the quotient at a time."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64), counts + 2
    whole, rest = np.divmod(rest, totals)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so squares fit."""
    d = p - q
    return d * d // (p + q)


class Sums:
    """Sums for the pairs of one language's sources, first below second, handed on when there are many."""

    def __init__(self, lang: str, sources: list[str]):
        self.lang, self.sources, self.n = lang, sources, len(sources)
        self.whole = self.n * self.n <= PAIRS
        self.sums = np.zeros((self.n, self.n), np.int64) if self.whole else None

    def add(self, p: np.ndarray):
        """p: a row for each source, a column for each word."""
        for i in range(self.n - 1):
            row = distance(p[i + 1 :], p[i : i + 1]).sum(axis=1)
            if self.whole:
                self.sums[i, i + 1 :] += row
            else:
                yield self.batch(i, row)

    def rest(self):
        for i in range(self.n - 1 if self.whole else 0):
            yield self.batch(i, self.sums[i, i + 1 :])

    def batch(self, i: int, row: np.ndarray) -> pa.RecordBatch:
        return found_batch(self.lang, [self.sources[i]] * len(row), self.sources[i + 1 :], row, "pair")


def found_batch(lang, source, item, value, part) -> pa.RecordBatch:
    n = len(source)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


FOUND = "lang string, source string, part string, item string, value long"


def compare_sources(best: int):
    """Task: pieces with their language's sources and totals to sums by pair and candidate words by source.

    A piece without leaves (a language without words) gives each pair a sum of 0. A source's
    candidates are the best of what this task saw, so they are at most best a source and language.
    """

    def found(batches):
        sums, top = None, {}
        for r in rows_of(batches):
            lang, sources = r["lang"], [s["source"] for s in r["groups"]]
            if sums is None or sums.lang != lang:
                if sums:
                    yield from sums.rest()
                    yield from candidates(sums.lang, top)
                sums, top = Sums(lang, sources), {}
            if r["leaves"] is None:
                continue
            totals = np.array([s["n"] for s in r["groups"]], np.int64) + 2 * r["words"]
            of_lang = np.array([int(totals.sum()) - 2 * r["words"] * (len(sources) - 1)], np.int64)
            number = {s: i for i, s in enumerate(sources)}
            words, _, leaf, source, n = leaves_of(r)
            source, step = np.array([number[s] for s in r["sources"]], np.int64)[source], max(1, CELLS // max(1, len(sources)))
            for k in range(0, len(words), step):
                part, (lo, hi) = words[k : k + step], np.searchsorted(leaf, (k, k + step))
                counts = np.zeros((len(sources), len(part)), np.int64)
                counts[source[lo:hi], leaf[lo:hi] - k] = n[lo:hi]
                p, q = smoothed(counts, totals[:, None]), smoothed(counts.sum(axis=0), of_lang)
                yield from sums.add(p)
                f = np.where((counts > 0) & (p > q), distance(p, q), -1)
                for i in np.flatnonzero((f >= 0).any(axis=1)).tolist():
                    # leaves come in byte order, so a stable sort leaves ties in it
                    at = np.argsort(-f[i], kind="stable")[:best]
                    new = [(-int(f[i, j]), part[j]) for j in at.tolist() if f[i, j] >= 0]
                    top[sources[i]] = heapq.nsmallest(best, top.get(sources[i], []) + new)
        if sums:
            yield from sums.rest()
            yield from candidates(sums.lang, top)

    return lean(found)


def candidates(lang: str, top: dict[str, list[tuple[int, bytes]]]):
    rows = [(s, w.decode(), -v) for s, found in top.items() for v, w in found]
    if rows:
        source, item, value = zip(*rows)
        yield found_batch(lang, list(source), list(item), np.array(value, np.int64), "term")


def beside_languages(pieces: DataFrame, langs: DataFrame, size: int) -> DataFrame:
    """Each piece with its language's row (groups, words), and the languages that have no piece.

    languages are broadcast when their table's files have SMALL bytes at most; beyond that the
    pieces of a language are dealt over SALTS keys, each with a copy of the language's row.
    """
    if size <= SMALL:
        rows = pieces.join(F.broadcast(langs), "lang")
    else:
        salted = langs.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        rows = pieces.withColumn("salt", F.pmod(F.xxhash64("edges"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    rows = rows.select("lang", "groups", "words", *_FIELDS[2:])
    none = langs.where("words = 0").select("lang", "groups", "words", *[F.lit(None).cast(pieces.schema[c].dataType).alias(c) for c in _FIELDS[2:]])
    return rows.union(none).sortWithinPartitions("lang")


def source_divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, best: int = BEST, held: int = HELD, depth: int = DEPTH, most: int = RANGE, piece: int = PIECE) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): a source's distance from each other source of
    its language (part pair, all ranks) and its most telling words (part term, best ranks).

    Null text, lang and source are ''. Words are runs of ASCII letters and of characters beyond
    ASCII, A-Z lower-cased; a language keeps those in at least least_docs of its documents. All
    arithmetic is in whole numbers. A source without words has even shares; a language that keeps
    no word gives its pairs 0 and no terms; one with a single source has no pairs. No documents
    give no rows; repeated rows count as often as they are there, and ids play no part. More
    columns, under any name, are ignored. Invalid characters can't occur in Spark's strings.

    A language's sources go beside its pieces as one array: the result has a row for each pair of
    them anyway.
    """
    spark = bounded(docs.sparkSession)
    scratch = Scratch(spark, "divergence")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    read = docs.select(*text)
    pieces = word_tries(read, scratch, least_docs=least_docs, held=held, depth=depth, most=most, piece=piece)
    totals = pieces.mapInArrow(lean(piece_totals), "lang string, source string, n long, words long")
    all_groups = read.select("lang", "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("words")).distinct()
    by_source = totals.union(all_groups).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    each = F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n")))).alias("groups")
    langs = scratch.table(by_source.groupBy("lang").agg(each, F.sum("words").alias("words")), "langs")
    found = scratch.table(beside_languages(pieces, langs, scratch.sizes["langs"]).mapInArrow(compare_sources(best), FOUND), "found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("o")
    pairs = pairs.select("lang", both, "value").select("lang", "o.source", F.lit("pair").alias("part"), "o.item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value", rank.alias("rank")).where(F.col("rank") <= best)
    return pairs.withColumn("rank", rank).union(terms).withColumn("rank", F.col("rank").cast(T.IntegerType()))
