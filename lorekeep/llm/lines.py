"""Line dedup over all documents with two Bloom filters, for keys seen once and keys seen twice.

1. Every partition hashes the keys of its lines and emits, per filter segment, the bits of its
   once-seen and twice-seen keys: at most two short numbers a line, however many partitions.
2. Segments are merged by streaming: a bit is "twice" if it was twice anywhere or once in two
   partitions. So each key of two documents is certainly found; chance hits only cost shuffling.
3. The twice filter, at most 128 MB whatever the corpus, is broadcast. Only lines that hit it are
   shuffled, as digests, for the exact count and the choice of the first document.
4. Of the texts, only those that lose lines are shuffled; a filter of their rows tells them apart.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, bounded, cut, fresh, lean, mix64, null_last, row_hash

SEGMENT_BITS = 19
LEAST_BITS, MOST_BITS, BITS_A_LINE = 20, 30, 16
#: Hashes that a task holds at a time.
FLUSH = 8_000_000


def line_key(line: str, least: int) -> bytes | None:
    """Stripped of ASCII white space at both ends, A-Z lower-cased; None if shorter than least."""
    key = line.strip(SPACE)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= least else None


def keys_of(text: str | None, least: int) -> set[bytes]:
    """The distinct keys of a whole text."""
    return {k for x in (text or "").split("\n") if (k := line_key(x, least)) is not None}


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions a hash."""
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate([hashes & mask, (hashes >> np.uint64(64 - bits)) & mask])


def packed(places: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << SEGMENT_BITS, bool)
    bits[places] = True
    return np.packbits(bits)


def unpack(blob: bytes) -> np.ndarray:
    """Segments travel as sorted positions while sparse, else as packed bits."""
    return np.frombuffer(blob, np.uint8) if len(blob) == 1 << (SEGMENT_BITS - 3) else packed(np.frombuffer(blob, np.uint32))


def travelling(places: np.ndarray) -> bytes:
    return packed(places).tobytes() if 4 * len(places) >= 1 << (SEGMENT_BITS - 3) else places.astype(np.uint32).tobytes()


def segments(hashes: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """The places of each segment that has any, ascending. In 32 bits and in place, as a task holds millions."""
    n = len(hashes)
    at = np.empty(2 * n, np.uint32)
    at[:n] = hashes & np.uint64((1 << bits) - 1)
    at[n:] = hashes >> np.uint64(64 - bits)
    at.sort()
    at = at[np.concatenate([at[:1] == at[:1], at[1:] != at[:-1]])]
    edges = np.searchsorted(at, np.arange(1 << SEGMENT_BITS, 1 << bits, 1 << SEGMENT_BITS, dtype=np.uint32))
    return {s: p & np.uint32((1 << SEGMENT_BITS) - 1) for s, p in enumerate(np.split(at, edges)) if len(p)}


def line_hashes(least: int):
    """For twice_filter(): the hashes of the keys in a column of texts, each once a document."""

    def hashes(column: pa.Array) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for t in column.to_pylist() for k in keys_of(t, least)), np.uint64)

    return hashes


def twice_filter(rows: DataFrame, hashes, bits: int, *, once: bool = False, first=None) -> np.ndarray:
    """The merged filter of 64-bit hashes that two rows (with once: one row) may hold, as packed bits.

    hashes gives those of a slice of the first column; first, a function over batches, makes that of
    rows, in the same worker. A task emits what it holds after every FLUSH
    hashes. The driver gets the 2**bits bits (128 MB at most), in one job.
    """

    def build(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            x = np.concatenate(held)
            held.clear()
            x.sort()
            again = segments(x[1:][x[1:] == x[:-1]], bits)
            seen = segments(x, bits)
            del x
            names, none = list(seen), np.zeros(0, np.uint32)
            for i in range(0, len(names), 64):
                yield pa.RecordBatch.from_pylist([{"seg": s, "once": travelling(seen[s]), "twice": travelling(again.get(s, none))} for s in names[i : i + 64]], pa.schema([("seg", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

        for batch in first(batches) if first else batches:
            for i in range(0, batch.num_rows, 4096):
                held.append(hashes(batch.column(0).slice(i, 4096)))
                size += len(held[-1])
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for s, a, b in zip(pdf["seg"], pdf["once"], pdf["twice"]):
                a, b = unpack(a), unpack(b)
                if s in held:
                    seen, twice = held[s]
                    twice |= b | (seen & a)
                    seen |= a
                else:
                    held[s] = (a.copy(), b.copy())
        for s, (seen, twice) in held.items():
            yield pd.DataFrame({"seg": [s], "twice": [zlib.compress((seen if once else twice).tobytes(), 1)]})

    parts = max(1, 1 << max(0, bits - SEGMENT_BITS))
    width = min(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = rows.mapInArrow(lean(build), "seg int, once binary, twice binary").repartition(width, "seg").mapInPandas(lean(merge), "seg int, twice binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    width_b = 1 << (SEGMENT_BITS - 3)
    for r in merged.collect():
        out[r.seg * width_b : (r.seg + 1) * width_b] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return out


def probe(twice: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes two rows may hold."""
    at = positions(hashes, bits)
    hit = ((twice[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
    return hit[: len(hashes)] & hit[len(hashes) :]


def line_dedup(docs: DataFrame, *, least: int = 10, filter_bits: int | None = None) -> DataFrame:
    r"""Drop repeated lines: each keeps only its lines in the smallest doc_id that holds its key.

    Texts are split at \n. A line's key is the line stripped of ASCII white space at both ends
    with A-Z lower-cased. Keys of at least `least` code points that two doc_ids or more hold lose
    all lines except in the smallest such doc_id. Returns the columns of docs with `text`
    replaced by the kept lines joined by \n, and n_lines and n_dropped (long; columns of these
    names are replaced). A null text stays null and counts as one empty line, an empty text too.
    Rows that repeat a doc_id are one document: none loses lines to another. A null doc_id comes
    after all others. filter_bits: log2 of the filters' size; from 2**20 to 2**30 bits, by the
    number of lines, if not given. A fuller filter costs shuffling, never correctness.
    """
    spark = bounded(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    texts = docs.select(F.col("text"))
    if filter_bits is None:
        n = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
        filter_bits = min(MOST_BITS, max(LEAST_BITS, int(n * BITS_A_LINE).bit_length()))
    shared = spark.sparkContext.broadcast(twice_filter(texts, line_hashes(least), filter_bits).tobytes())
    bits = filter_bits

    def suspects(batches):
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                rows, keys = [], []
                for j, t in enumerate(batch.column(1).slice(i, 4096).to_pylist(), i):
                    own = keys_of(t, least)
                    keys += own
                    rows += [j] * len(own)
                h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
                hit = np.flatnonzero(probe(twice, h, bits)).tolist()
                at = pa.array([rows[k] for k in hit], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 2, 3)), pa.array([digest(keys[k]) for k in hit], pa.binary())], ["d", "r", "r2", "key"])

    d, r, r2, k = fresh(docs, "d", "r", "r2", "k")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[h.alias(n) for h, n in zip(row_hash("doc_id", "text"), (r, r2))])
    held = cut(keyed.select(F.col("doc_id").cast("long").alias("d"), "text", r, r2).mapInArrow(lean(suspects), "d long, r long, r2 long, key binary"))
    # written out, so that Spark can split a very common key in the join
    order = null_last("d")
    repeated = cut(held.groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last").select("key", "first"))
    # by row and not by id, which may be null or repeat without end: what a row loses is no more than its own lines
    lost = cut(held.join(repeated, "key").where(order != F.col("first")).groupBy("r", "r2").agg(F.collect_set("key").alias("k")))
    # only rows that a filter says lose lines are shuffled; they meet a hash table of what they lose and are never sorted
    row_bits = min(MOST_BITS, max(LEAST_BITS, int(lost.count() * BITS_A_LINE).bit_length()))
    losing = spark.sparkContext.broadcast(twice_filter(lost.select("r"), lambda c: mix64(c.to_numpy(zero_copy_only=False).view(np.uint64)), row_bits, once=True).tobytes())

    @F.pandas_udf("boolean")
    def may_lose(column: pd.Series) -> pd.Series:
        return pd.Series(probe(np.frombuffer(losing.value, np.uint8), mix64(column.to_numpy(np.int64).view(np.uint64)), row_bits))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    losers = keyed.where(may_lose(r)).join(lost.toDF(r, r2, k).hint("shuffle_hash"), [r, r2], "left").select(*columns, k)
    # the others stay as they are and need no second worker
    n = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    whole = keyed.where(~may_lose(r)).select(*columns, n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    names = docs.columns
    at_text, at_lost = names.index("text"), len(names)

    def keep(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b = batch.slice(i, 4096)
                kept, n_lines, n_dropped = [], [], []
                for t, lost_keys in zip(b.column(at_text).to_pylist(), b.column(at_lost).to_pylist()):
                    n = (t or "").count("\n") + 1
                    gone = 0
                    if lost_keys:
                        lost_keys = set(lost_keys)
                        lines = [x for x in t.split("\n") if (k := line_key(x, least)) is None or digest(k) not in lost_keys]
                        gone = n - len(lines)
                        t = "\n".join(lines)
                    kept.append(t)
                    n_lines.append(n)
                    n_dropped.append(gone)
                arrays = [pa.array(kept, pa.string()) if j == at_text else b.column(j) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return losers.mapInArrow(lean(keep), schema).union(whole)
