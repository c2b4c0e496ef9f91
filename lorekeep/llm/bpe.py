"""Byte-level BPE by speculation: propose greedily, verify pairs in bulk, merge exactly where that fails.

A word's BPE encoding is the only way to cut it into tokens in which each token encodes to itself
and so does each pair of neighbours. So a greedy longest-match proposal whose neighbours all are
compatible is the encoding; only words with an incompatible pair go through the merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, bounded, lean

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place where no match of PATTERN reaches across, in a text that is cut for length.
SEAM = regex.compile(r"(?<=\S) (?=\p{L})")
#: Characters in one pass over a text, words that a worker remembers, characters of texts taken together.
PIECE, REMEMBERED, TOGETHER = 1 << 20, 100_000, 2 << 20
#: Bytes of a word up to which scanning all pairs at each step is quickest; such words merged side by side.
SHORT, ASIDE = 48, 4096
#: Stands for the rank of a pair that never merges.
NEVER = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBPE:
    """Encoder and decoder for a `tokenizers` file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.id_of = {raw(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.steps = sorted((a * len(self.bytes_of) + b, rank, new) for (a, b), (rank, new) in self.merge.items())
        self.step_keys, self.step_rank = (np.array([s[i] for s in self.steps], t) for i, t in ((0, np.int64), (1, np.int32)))
        self.step_new = np.zeros(1 + max((s[1] for s in self.steps), default=0), np.int32)
        for _, rank, new in self.steps:
            self.step_new[rank] = new
        del self.steps
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.n = len(self.bytes_of)
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        #: Pairs of bytes that lie within some token.
        self.within = np.zeros(1 << 16, bool)
        for b in self.id_of:
            raw_b = np.frombuffer(b, np.uint8).astype(np.int32)
            self.within[raw_b[:-1] * 256 + raw_b[1:]] = True
        #: Tokens that the merges can't make of their own bytes are never proposed.
        self.sound = {b: i for (b, i), ids in zip(self.id_of.items(), self.merged_many(list(self.id_of))) if ids == [i]}
        #: The lengths of tokens by their first bytes (three, or all of a shorter token), longest first.
        lengths: dict[bytes, set[int]] = {}
        for b in self.sound:
            lengths.setdefault(b[:3], set()).add(len(b))
        self.lengths = {b: sorted(x, reverse=True) for b, x in lengths.items()}
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used = np.zeros(1 << 14, np.int64)
        self.start_of_free = self.known = 0

    def shed(self) -> None:
        """Forget words that came once since the last time, and the rarer ones if more than half of REMEMBERED stay."""
        used = self.used[: self.known]
        keep = np.flatnonzero(used > 1)
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(keep[np.argsort(-used[keep], kind="stable")[: REMEMBERED // 2]])
        words, begin, lens = list(self.index), self.start[keep], self.start[keep + 1] - self.start[keep]
        ends = np.cumsum(lens)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + lens, lens)]
        self.forget()
        self.remember([words[k] for k in keep.tolist()], lens, flat)

    def remember(self, words: list[str], lens: np.ndarray, flat: np.ndarray) -> None:
        """Take in distinct new words and their ids."""
        while self.start_of_free + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(words) + 1 > len(self.start):
            self.start, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.used))
        self.flat[self.start_of_free : self.start_of_free + len(flat)] = flat
        self.start[self.known + 1 : self.known + 1 + len(words)] = self.start_of_free + np.cumsum(lens)
        self.index.update(zip(words, range(self.known, self.known + len(words))))
        self.known += len(words)
        self.start_of_free += len(flat)

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and where each word's end."""
        if self.known > REMEMBERED:
            self.shed()
        at = list(map(self.index.get, words))
        if None in at:
            self.learn(list(dict.fromkeys(w for w, i in zip(words, at) if i is None)))
            at = list(map(self.index.__getitem__, words))
        at = np.array(at, np.int64)
        self.used += np.bincount(at, minlength=len(self.used))
        begin = self.start[at]
        lens = self.start[at + 1] - begin
        ends = np.cumsum(lens)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + lens, lens)], ends

    # -- one word ---------------------------------------------------------------------------

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding: the pair of lowest rank is joined, leftmost first, until none is left.

        A long word is cut where no token holds the two bytes at hand, so that no merge can reach
        across, and then merged through a heap: n log n steps, however the letters lie.
        """
        if len(word) <= SHORT:
            return self.joined([self.byte_id[b] for b in word])
        raw = np.frombuffer(word, np.uint8).astype(np.int32)
        ends = np.flatnonzero(~self.within[raw[:-1] * 256 + raw[1:]]) + 1
        out: list[int] = []
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(word)]):
            ids = [self.byte_id[x] for x in word[a:b]]
            out += self.joined(ids) if b - a <= SHORT else self.joined_by_heap(ids)
        return out

    def joined(self, ids: list[int]) -> list[int]:
        merge = self.merge
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = merge.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            left, right = ids[at], ids[at + 1]
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and ids[i] == left and ids[i + 1] == right:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def joined_by_heap(self, ids: list[int]) -> list[int]:
        """As joined(), over a linked list: a place is joined with its successor when its pair comes up."""
        merge, n = self.merge, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or (m := merge.get((ids[i], ids[j]))) is None or m != (rank, new):
                continue  # one of the pair is gone
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merge.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], new))) is not None:
                heapq.heappush(heap, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        sound, lengths, n, at, out = self.sound, self.lengths, len(word), 0, []
        if (i := sound.get(word)) is not None:
            return [i]
        while at < n:
            i, left = None, n - at
            for size in lengths.get(word[at : at + 3], ()):
                if size <= left and (i := sound.get(word[at : at + size])) is not None:
                    break
            if i is None:
                size = 2 if (i := sound.get(word[at : at + 2])) is not None else 1
                i = sound[word[at : at + size]] if i is None else i
            out.append(i)
            at += size
        return out

    # -- many words -------------------------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, NEVER for those that don't merge; -1 is no token."""
        if not len(self.step_keys):
            return np.full(left.shape, NEVER, np.int32)
        keys = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.step_keys, keys)
        at[at == len(self.step_keys)] = 0
        return np.where((self.step_keys[at] == keys) & (left >= 0) & (right >= 0), self.step_rank[at], NEVER)

    def merged_many(self, raws: list[bytes]) -> list[list[int]]:
        """As merged() for each: words of like length lie side by side as rows, each step joins one pair in every row."""
        out: list = [None] * len(raws)
        short = []
        for k, r in enumerate(raws):
            if len(r) > SHORT:
                out[k] = self.merged(r)
            else:
                short.append(k)
        short.sort(key=lambda k: len(raws[k]))
        byte_id = np.array(self.byte_id, np.int32)
        for first in range(0, len(short), ASIDE):
            rows = np.array(short[first : first + ASIDE])
            size = np.array([len(raws[k]) for k in rows.tolist()])
            ids = np.full((len(rows), size.max()), -1, np.int32)
            ids[np.arange(ids.shape[1]) < size[:, None]] = byte_id[np.frombuffer(b"".join(raws[k] for k in rows.tolist()), np.uint8)]
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                low = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NEVER, np.int32)
                done = low == NEVER
                if done.any():
                    for k, x, n in zip(rows[done].tolist(), ids[done].tolist(), (ids[done] >= 0).sum(1).tolist()):
                        out[k] = x[:n]
                    rows, ids, rank, best, low = (x[~done] for x in (rows, ids, rank, best, low))
                    if not len(rows):
                        break
                at, place = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
                ids = np.where(place <= best[:, None], ids[:, :-1], ids[:, 1:])
                ids[at, best] = self.step_new[low]
                rank = np.where(place[:-1] < best[:, None], rank[:, :-1], rank[:, 1:])
                for side in (best - 1, best):  # the pairs that hold the new token
                    of = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                    rank[of, side[of]] = self.ranks(ids[of, side[of]], ids[of, side[of] + 1])
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is its own encoding; pairs not yet known are merged exactly once."""
        keys = left.astype(np.int64) * self.n + right
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, distinct)
        held = at < len(self.pair_keys)
        held[held] = self.pair_keys[at[held]] == distinct[held]
        ok = np.zeros(len(distinct), bool)
        ok[held] = self.pair_ok[at[held]]
        new = np.flatnonzero(~held)
        if len(new):
            pairs = [divmod(k, self.n) for k in distinct[new].tolist()]
            ok[new] = [ids == [a, b] for (a, b), ids in zip(pairs, self.merged_many([self.bytes_of[a] + self.bytes_of[b] for a, b in pairs]))]
            if len(self.pair_keys) + len(new) > 4_000_000:
                self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
            keys_all = np.concatenate([self.pair_keys, distinct[new]])
            order = np.argsort(keys_all, kind="stable")
            self.pair_keys, self.pair_ok = keys_all[order], np.concatenate([self.pair_ok, ok[new]])[order]
        return ok[back]

    def learn(self, words: list[str]) -> None:
        """Encode distinct words that are not known yet and remember them."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = [self.proposed(r) for r in raws]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
        owner = np.repeat(np.arange(len(ids)), lens)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        if len(inner):
            ok = self.compatible(flat[inner], flat[inner + 1])
            failing = np.unique(owner[inner[~ok]])
            if len(failing):
                for w, exact in zip(failing.tolist(), self.merged_many([raws[w] for w in failing.tolist()])):
                    ids[w] = exact
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
        self.remember(words, lens, flat)

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text, or of a stretch of one, without special tokens."""
        words = self.words.findall(text)
        if not words:
            return np.zeros(0, np.uint32)
        return self.looked_up(words)[0]

    def pieces(self, text: str):
        """The text in stretches of bounded length that no word crosses."""
        at = 0
        while len(text) - at > PIECE and (m := SEAM.search(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a whole text; a null text is empty. A special token's string becomes its id."""
        text = text or ""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [self.plain(p) for p in self.pieces(text[at : m.start()])]
            out.append(np.array([self.special[m[0]]], np.uint32))
            at = m.end()
        out += [self.plain(p) for p in self.pieces(text[at:])]
        return out[0] if len(out) == 1 else np.concatenate(out)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """As encode() for each; short texts are looked up together, a few megabytes at a time."""
        out: list = [None] * len(texts)
        group: list[int] = []
        size = 0

        def close() -> None:
            nonlocal group, size
            words, ends = [], []
            for k in group:
                words += self.words.findall(texts[k])
                ends.append(len(words))
            ids, stop = self.looked_up(words)
            stop = np.concatenate([[0], stop])
            first = 0
            for k, end in zip(group, ends):
                out[k] = ids[stop[first] : stop[end]]
                first = end
            group, size = [], 0

        for k, t in enumerate(texts):
            if t and len(t) <= PIECE and not (self.cut and self.cut.search(t)):
                group.append(k)
                size += len(t)
                if size > TOGETHER // 4:
                    close()
            else:
                out[k] = self.encode(t)
        if group:
            close()
        return out

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


_MODELS: dict[str, SpeculativeBPE] = KEPT.setdefault("bpe", {})


def model(path: str) -> SpeculativeBPE:
    """One encoder per worker and file."""
    if path not in _MODELS:
        _MODELS[path] = SpeculativeBPE(path)
    return _MODELS[path]


def bpe_encode(docs: DataFrame, path: str, *, ids: bool = True, digests: bool = False, check: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode every whole `text`, without a shuffle; with digests or check, decode it again.

    Returns the columns named in keep, then n_tokens long, with ids: ids array<int>, with digests:
    ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of the decoded text in
    UTF-8). With check, a text that its ids don't give back is an error. A null or empty text has no tokens; repeated rows stay repeated; other columns go.
    path is a byte-level BPE file of the tokenizers library, readable on every executor.
    """
    bounded(docs.sparkSession)
    fields = {f.name: f for f in docs.schema.fields}
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))

    def run(batches):
        try:
            yield from encode(batches)
        finally:
            model(path).forget()  # workers outlive tasks, and the words of a partition are mostly its own

    def encode(batches):
        bpe = model(path)
        for batch in batches:
            column, n = batch.column(len(keep)), batch.num_rows
            step = 256  # ids of few texts are held beside the batch
            for at in range(0, n, step):
                out = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
                texts = column.slice(at, step).to_pylist()
                for t, x in zip(texts, bpe.encode_many(texts)):
                    if check and bpe.decode(x) != (t or ""):
                        raise ValueError(f"a text of {len(t or '')} characters does not come back from its {len(x)} tokens")
                    out["n_tokens"].append(len(x))
                    if ids:
                        out["ids"].append(pa.array(x.astype(np.int32)))
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(bpe.decode(x).encode()).hexdigest())
                arrays = [batch.column(i).slice(at, step) for i in range(len(keep))] + [pa.array(out["n_tokens"], pa.int64())]
                names = [f"k{i}" for i in range(len(keep))] + ["n_tokens"]
                if ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in out["ids"]])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(out["ids"])))
                    names.append("ids")
                if digests:
                    arrays += [pa.array(out[c], pa.string()) for c in ("ids_sha256", "decoded_sha256")]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join([f"k{i} {fields[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["n_tokens long"] + ["ids array<int>"] * ids + ["ids_sha256 string, decoded_sha256 string"] * digests)
    return rows.mapInArrow(lean(run, keeps="bpe"), schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def bpe_decode(tokens: DataFrame, path: str) -> DataFrame:
    """Replace column `ids` (array<int>; null as empty) by `text`, its decoding."""

    @F.pandas_udf("string")
    def text(ids):
        bpe = model(path)
        return ids.map(lambda x: bpe.decode(x if x is not None else []))

    return tokens.withColumn("text", text("ids")).drop("ids")
