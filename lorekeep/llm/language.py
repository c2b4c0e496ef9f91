"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language yields longest-match lengths: a text is parsed
greedily into the longest phrases that occur in the language's text, and the language whose
phrases, weighted by the bits that name a place in its text, are fewest wins. The automata are
made total (a missing transition ends the phrase and starts the next), so thousands of texts step
through them together, one byte at a time, as array lookups.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, fresh, remainder

#: Bounds of the fit: documents a language, bytes a language, bytes over all languages (but 500 a language at least).
DOCUMENTS, BYTES, ALL_BYTES = 60, 24_000, 192_000
#: Bytes of a lane (a phrase ends with its lane), bytes of text parsed together.
LANE, TOGETHER, EXCERPT = 1_024, 6_000_000, 300
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes other than letters become spaces.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
ENDS = np.int32(-(2**31))


def normal(text: str) -> bytes:
    """Lower case, letters only, single spaces around words."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(FOLD).split()) + b" "


class Automaton:
    """Suffix automaton of one text as a total table over byte classes; the sign bit marks a phrase's first byte."""

    def __init__(self, text: bytes):
        self.bits = float(np.log2(max(2, len(text))))
        link, length, trans = [-1], [0], [{}]
        last = 0
        for c in text:
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            trans.append({})
            p = last
            while p >= 0 and c not in trans[p]:
                trans[p][c] = cur
                p = link[p]
            if p >= 0:
                q = trans[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    trans.append(dict(trans[q]))
                    while p >= 0 and trans[p].get(c) == q:
                        trans[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        used = sorted(set(text))
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        root = np.zeros(self.width, np.int32)  # class 0: bytes that the text lacks
        for c, s in trans[0].items():
            root[self.classes[c]] = s
        # a missing transition starts a phrase; in state 0 none is open: there a text starts, and goes on after a byte that this text lacks
        table = np.tile(root * self.width | ENDS, (len(link), 1))
        for s, t in enumerate(trans):
            if s and t:
                table[s, self.classes[list(t)]] = np.fromiter(t.values(), np.int32, len(t)) * self.width
        self.table = table.ravel()

    def phrases(self, lanes: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of each lane, a byte that the text lacks being one; lanes: (step, lane) bytes, longest lane first; active: lanes left at each step."""
        state = np.zeros(lanes.shape[1], np.int32)
        count = np.zeros(lanes.shape[1], np.int32)
        classed = self.classes[lanes]
        for step, n in enumerate(active):
            to = self.table[state[:n] + classed[step, :n]]
            count[:n] += to < 0
            state[:n] = to & ~ENDS
        return count


class CrossParser:
    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        self.automata = [Automaton(texts[k]) for k in self.languages]

    def cost(self, texts: list[bytes]) -> np.ndarray:
        """(text, language) bits a byte of normalised phrases; a text is parsed in stretches of LANE bytes."""
        sizes = np.array([len(t) for t in texts])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum(sizes) - sizes
        n_lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), n_lanes)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        begin = starts[owner] + k * LANE
        width = np.minimum(LANE, sizes[owner] - k * LANE)
        order = np.argsort(-width, kind="stable")
        owner, begin, width = owner[order], begin[order], width[order]
        steps = np.arange(int(width[0]))
        lanes = flat[np.minimum(begin[None, :] + steps[:, None], len(flat) - 1)]
        active = np.searchsorted(-width, -steps, side="left")  # lanes longer than the step
        out = np.zeros((len(texts), len(self.languages)))
        for j, a in enumerate(self.automata):
            out[:, j] = np.bincount(owner, a.phrases(lanes, active), minlength=len(texts)) * a.bits / sizes
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score from 0 to 1 for each text; `und`, 0 if it is null or has no letter."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        group: list[int] = []
        held: list[bytes] = []

        def close() -> None:
            cost = self.cost(held)
            best = cost.argmin(1)
            rank = np.sort(cost, 1)
            share = rank[:, 1] / (rank[:, 0] + rank[:, 1]) if cost.shape[1] > 1 else np.ones(len(held))
            for i, b, s in zip(group, best.tolist(), share.tolist()):
                langs[i], scores[i] = self.languages[b], s
            group.clear()
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            if not t or not self.languages or not LETTER.search(t):
                continue
            group.append(i)
            held.append(normal(t))
            size += len(held[-1])
            if size > TOGETHER:
                close()
                size = 0
        if group:
            close()
        return langs, scores


def split_shared(documents: list[list[bytes]], langs: list[str], k: int = 6) -> tuple[list[list[bytes]], bytes]:
    """The excerpts without stretches of k words that are filed under two languages, and those stretches.

    Boilerplate and copied passages are no evidence of the language they are filed under: they go
    into every language's text, where they cost each the same.
    """
    words = [[e.split() for e in x] for x in documents]
    under: dict[tuple, set[str]] = {}
    for x, lang in zip(words, langs):
        for w in x:
            for i in range(len(w) - k + 1):
                under.setdefault(tuple(w[i : i + k]), set()).add(lang)
    out, shared = [], {}
    for x in words:
        kept = []
        for w in x:
            gone = {j for i in range(len(w) - k + 1) if len(under[tuple(w[i : i + k])]) > 1 for j in range(i, i + k)}
            runs: list[list[bytes]] = []
            for j, t in enumerate(w):
                if j and ((j in gone) == (j - 1 in gone)):
                    runs[-1].append(t)
                else:
                    runs.append([t])
            at = 0
            for r in runs:
                stretch = b" " + b" ".join(r) + b" "
                if at in gone:
                    shared[stretch] = None
                else:
                    kept.append(stretch)
                at += len(r)
        out.append(kept)
    return out, b"".join(shared)


def fit(docs: DataFrame, *, folds: int = 4, held: int = 2, documents: int = DOCUMENTS, size: int = BYTES) -> CrossParser:
    """Learn from at most `documents` labelled documents a language outside the held-out fold.

    Which documents, and which excerpts of their whole texts, follows a hash, so that reruns agree.
    Every language of the other folds is learnt, however many and however rare.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(remainder(F.col("doc_id"), folds) != held)
    known = known.select("doc_id", "text", "lang", F.xxhash64("doc_id", F.lit("language")).alias("h"))
    size = max(500, min(size, ALL_BYTES // max(1, known.select("lang").distinct().count())))
    picked = known.select("doc_id", "lang", "h")
    picked = picked.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= documents)

    @F.pandas_udf("array<binary>")
    def excerpts(texts, ids):
        out = []
        for t, d in zip(texts, ids):
            raw = normal(t)
            pieces = [raw[i : i + EXCERPT] for i in range(0, max(1, len(raw) - EXCERPT // 2), EXCERPT)]
            take = np.random.default_rng(abs(int(d)) + 1).permutation(len(pieces))[: max(1, 4 * size // (documents * EXCERPT))]
            out.append([pieces[i] for i in sorted(take.tolist())])
        return pd.Series(out)

    rows = known.join(F.broadcast(picked.select("doc_id", F.col("lang").alias("l"), "k")), "doc_id").where("lang = l")
    rows = rows.select("lang", "k", excerpts("text", "doc_id").alias("x")).dropDuplicates(["lang", "k"]).toPandas().sort_values(["lang", "k"])
    rows["x"], shared = split_shared(list(rows["x"]), list(rows["lang"]))
    texts: dict[str, bytes] = {}
    for lang, part in rows.groupby("lang"):
        pools = [list(x) for x in part["x"]]
        text = b""
        for turn in range(max(map(len, pools), default=0)):  # an excerpt of each document in turn
            for p in pools:
                if turn < len(p) and len(text) < size:
                    text += p[turn]
        texts[lang] = text[:size] + shared[: size // 4]
    return CrossParser({k: t for k, t in texts.items() if t.strip()})


def identify_language(docs: DataFrame, labelled: DataFrame | None = None, *, folds: int = 4, held: int = 2) -> DataFrame:
    """The columns of docs plus lang_pred and score (0 to 1), for every whole text.

    labelled (docs, if not given) has doc_id, text and lang; lang, source and doc_id never enter a
    prediction. A null text or one without a letter is `und` with score 0, as is each text when
    nothing is labelled. Ties go to the language first in code-point order. Repeated rows are
    predicted alike. No shuffle of the documents.
    """
    bounded(docs.sparkSession)
    model = fit(docs if labelled is None else labelled, folds=folds, held=held)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        langs, scores = shared.value.predict(texts.where(texts.notna(), None).tolist())
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype="object"), "score": scores})

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (p,) = fresh(docs, "p")
    return docs.withColumn(p, predict("text")).select(*[F.col(f"`{c}`") for c in names], f"{p}.lang_pred", f"{p}.score")
