"""N-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets become one set. Sets that share a token of their prefixes (the
rarest tokens, so many that two similar sets must have one in common) form groups: a set's group
is the one of these tokens that most sets share. A group of any size is dealt into blocks of bounded size, and the matrix
holds, for each block, the union of its members' prefix tokens with the least and largest set
size. Two blocks are opened only if their unions share enough tokens and sizes allow a link; opened, each member
must first reach its overlap bound against the other block's whole token union; only what is left
is intersected, as a product of bounded matrices. Blocks emit spanning links, never all pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, connected_components, fresh, lean, mix64, null_last, row_hash
from .lines import probe, twice_filter

#: Members and shingles of a block at most (but for a single larger document), tokens in a product.
MEMBERS, SHINGLES, WIDTH = 384, 600_000, 4096
#: A prefix has one token more for so many tokens of the set, and similar sets share as many more.
EXTRA = 40
#: Members opened by a task at least.
A_TASK = 128
#: Filters over what the one before has left.
ROUNDS = 2
#: Cells of the table of common shingles (one byte each when broadcast).
CELLS = 22
#: Shingles whose counts a task holds at a time.
FLUSH = 8_000_000
LEAST_BITS, MOST_BITS, BITS_A_TOKEN = 20, 30, 4


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.

    A-Z is lower-cased, words end at ASCII white space; fewer words than k are one shingle; a
    text that is null or has no word has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    s = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        s = mix64(s + h[j : j + len(s)])
    return np.unique(s)


def repeats(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur twice or more, ascending, and how often. Empties held, so that all lies in memory once or twice."""
    x = np.concatenate(held)
    held.clear()
    x.sort()
    again, n = np.unique(x[1:][x[1:] == x[:-1]], return_counts=True)
    return again, n + 1


def needed(n, percent: int):
    """The least overlap with any similar set: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def tree(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what mask (rows a, columns b) connects, at most one a row or column."""
    rows, cols = mask.any(1), mask.any(0)
    if not rows.any():
        return []
    m, a, b = mask[np.ix_(rows, cols)], a[rows], b[cols]
    top = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(m, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(m, na[:, None], top).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return [(int(x), int(y)) for x, y in [*zip(a, la), *zip(b, lb)] if x != y]


class Block:
    """Members with their sets: ids, sizes, and the tokens of each, grouped by token."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, owners: np.ndarray):
        order = np.argsort(tokens, kind="stable")
        self.ids, self.sizes, self.tokens, self.owners = ids, sizes, tokens[order], owners[order]

    @classmethod
    def of(cls, ids: list[int], sets: list[np.ndarray]) -> Block:
        sizes = np.array([len(s) for s in sets], np.int64)
        return cls(np.array(ids, np.int64), sizes, np.concatenate(sets), np.repeat(np.arange(len(ids), dtype=np.uint16), sizes))

    def pack(self) -> bytes:
        union, n = np.unique(self.tokens, return_counts=True)
        head = np.array([len(self.ids), len(union), len(self.tokens)], np.int64)
        return zlib.compress(b"".join(x.tobytes() for x in (head, self.ids, self.sizes, union, n.astype(np.uint16), self.owners)), 1)

    @classmethod
    def unpack(cls, blob: bytes) -> Block:
        raw = zlib.decompress(blob)
        m, u, t = np.frombuffer(raw, np.int64, 3)
        at, out = 24, []
        for kind, n in ((np.int64, m), (np.int64, m), (np.uint64, u), (np.uint16, u), (np.uint16, t)):
            out.append(np.frombuffer(raw, kind, n, at))
            at += out[-1].nbytes
        new = object.__new__(cls)
        new.ids, new.sizes, new.owners, new.tokens = out[0], out[1], out[4], np.repeat(out[2], out[3])
        return new

    def only(self, tokens: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column (a place in tokens) and member of each entry left."""
        at = np.searchsorted(tokens, self.tokens)
        at[at == len(tokens)] = 0
        keep = (tokens[at] == self.tokens) & members[self.owners] if len(tokens) else np.zeros(len(self.tokens), bool)
        return at[keep], self.owners[keep]


def links(x: Block, y: Block, percent: int) -> list[tuple[int, int]]:
    """Spanning links between members of two blocks, or within one (x is y), that are similar."""
    if x is y:
        union, n = np.unique(x.tokens, return_counts=True)
        common = union[n > 1]
    else:
        common = np.intersect1d(x.tokens, y.tokens)
    xs, ys = np.ones(len(x.ids), bool), np.ones(len(y.ids), bool)
    while True:  # bound each member's overlap with the other side's union, drop what can't reach it, bound again
        (xc, xo), (yc, yo) = x.only(common, xs), y.only(common, ys)
        nx = np.bincount(xo, minlength=len(xs)) >= needed(x.sizes, percent)
        ny = np.bincount(yo, minlength=len(ys)) >= needed(y.sizes, percent)
        nx, ny = nx & xs, ny & ys
        same = (nx == xs).all() and (ny == ys).all()
        xs, ys = nx, ny
        if not xs.any() or not ys.any():
            return []
        if same:
            break
        left = np.intersect1d(xc[xs[xo]], yc[ys[yo]])
        common = common[left]
    xi, yi = np.cumsum(xs) - 1, np.cumsum(ys) - 1
    inter = np.zeros((int(xs.sum()), int(ys.sum())), np.float32)
    for at in range(0, len(common), WIDTH):
        lo, hi = np.searchsorted(xc, (at, at + WIDTH)), np.searchsorted(yc, (at, at + WIDTH))
        a, b = np.zeros((inter.shape[0], min(WIDTH, len(common) - at)), np.float32), np.zeros((inter.shape[1], min(WIDTH, len(common) - at)), np.float32)
        a[xi[xo[lo[0] : lo[1]]], xc[lo[0] : lo[1]] - at] = 1
        b[yi[yo[hi[0] : hi[1]]], yc[hi[0] : hi[1]] - at] = 1
        inter += a @ b.T  # exact: counts stay below 2**24
    sizes = x.sizes[xs][:, None] + y.sizes[ys][None, :]
    inter = inter.astype(np.int64)
    mask = 100 * inter >= percent * (sizes - inter)
    if x is y:
        np.fill_diagonal(mask, False)
    return tree(mask, x.ids[xs], y.ids[ys])


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Byte table of how common shingles are: about log2 of the documents that hold one, by hash cell.

    Only the order of prefixes follows from it, so sharing a cell costs speed and never a link.
    """
    shift = np.uint64(64 - CELLS)

    def common(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            cells, n = repeats(held)
            cells, n = (cells >> shift).astype(np.int64), n.astype(np.int64)
            for i in range(0, len(cells), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(cells[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], ["cell", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                for t in batch.column(0).slice(i, 1024).to_pylist():
                    held.append(shingles(t, k))
                    size += len(held[-1])
                if size > FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def pack(batches):
        for batch in batches:
            level = np.log2(batch.column(1).to_numpy()).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype(np.uint32).tobytes()], pa.binary()), pa.array([level.tobytes()], pa.binary())], ["cells", "levels"])

    summed = docs.select("text").mapInArrow(lean(common), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << CELLS, np.uint8)
    for row in summed.mapInArrow(lean(pack), "cells binary, levels binary").collect():  # five bytes a cell at most, in one job
        out[np.frombuffer(row.cells, np.uint32)] = np.frombuffer(row.levels, np.uint8)
    return out


def ngram_jaccard(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard index of percent / 100 or more.

    Returns a row for each row of docs: doc_id, n_shingles long, component_id long (the smallest
    doc_id reachable by links, itself included), stands boolean (the row holds the first set of its
    component, under the component's id), row_1 and row_2 long (row_hash() of doc_id and text).
    Exact: no link is lost, none is added. Null and
    empty texts have no shingles and link with nothing. A null doc_id counts as larger than all
    others and is returned as null. Sets link, not ids: rows that repeat a doc_id (null too) with
    another text are nodes of their own. A set goes by 128 bits and its size, a
    row by 128 bits, a shingle by 64. Other columns are ignored.
    """
    spark = bounded(docs.sparkSession)
    sc, scratch = spark.sparkContext, Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    row, row_2 = row_hash("doc_id", "text")
    levels = sc.broadcast(sketch(docs, k).tobytes())
    shift = np.uint64(64 - CELLS)

    def describe(batches):
        level = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                n, s1, s2, prefixes = [], [], [], []
                for t in b.column(1).to_pylist():
                    s = shingles(t, k)
                    n.append(len(s))
                    m = mix64(s)
                    s1.append(int(m.sum(dtype=np.uint64).astype(np.int64)))
                    s2.append(int(mix64(m).sum(dtype=np.uint64).astype(np.int64)))
                    p = len(s) - needed(len(s), percent) + 1 + len(s) // EXTRA if len(s) else 0
                    order = (level[s >> shift].astype(np.uint64) << np.uint64(58)) | (m >> np.uint64(6))
                    prefixes.append(s[np.argpartition(order, p - 1)[:p]] if p < len(s) else s)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["d", "w", "w2", "n", "s1", "s2", "prefix"])

    sets = scratch.table(docs.select("doc_id", "text", row, row_2).mapInArrow(lean(describe), "d long, w long, w2 long, n long, s1 long, s2 long, prefix array<long>"), "sets", pack=None)
    # a node a set, numbered by where it lies: ids may repeat or be null. r is the row whose text will give the set
    own = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("w", "w2")).alias("r"), F.min(null_last("d")).alias("least"), F.first("prefix").alias("prefix"))
    own = scratch.table(own.select("s1", "s2", "n", F.col("r.w").alias("r"), F.col("r.w2").alias("r2"), "least", "prefix", F.monotonically_increasing_id().alias("node")), "own", pack=None, like="sets")
    # the prefixes go on in own only
    rows = scratch.table(sets.drop("prefix"), "rows", pack=None, like="sets")
    scratch.drop("sets")

    total = own.agg(F.sum(F.size("prefix"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(total * BITS_A_TOKEN).bit_length()))
    filters: list = []

    def left(batches):
        """The tokens that every filter so far says two sets hold, of sets with enough of them.

        Two similar sets share 1 + n // EXTRA tokens of their prefixes, n the smaller size: fewer rule a set out.
        """
        blooms = [np.frombuffer(f.value, np.uint8) for f in filters]
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b = batch.slice(i, 4096)
                flat, sizes = b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(2).to_numpy()
                owner = np.repeat(np.arange(b.num_rows), np.diff(b.column(0).offsets.to_numpy()))
                for bloom in blooms:
                    hit = probe(bloom, mix64(flat.view(np.uint64)), bits)
                    flat, owner = flat[hit], owner[hit]
                    hit = (np.bincount(owner, minlength=b.num_rows) > needed(sizes, percent) // EXTRA)[owner]
                    flat, owner = flat[hit], owner[hit]
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(b.column(1).to_numpy()[owner]), pa.array(sizes[owner])], ["tok", "node", "n"])

    prefixes = own.select("prefix", "node", "n")
    scramble = lambda column: mix64(column.to_numpy(zero_copy_only=False).view(np.uint64))
    for _ in range(ROUNDS):
        filters.append(sc.broadcast(twice_filter(prefixes, scramble, bits, first=left).tobytes()))
    held = scratch.table(prefixes.mapInArrow(lean(left), "tok long, node long, n long"), "held")
    # counts are written out before the join, so that Spark can split a token that very many sets hold
    both = scratch.table(held.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1"), "counts", like="held")
    tokens = scratch.table(held.join(both, "tok"), "tokens", like="held")
    own = scratch.table(own.drop("prefix"), "nodes", pack=None, like="own")
    scratch.drop("own", "counts")
    # the most shared token names the group: a family then falls into few groups, whose unions meet seldom
    member = tokens.groupBy("node").agg(F.max(F.struct("c", "tok")).alias("x"), F.first("n").alias("n"), F.count("*").alias("k"))
    member = scratch.table(member.where(f"k > ceil({percent} * n / 100) div {EXTRA}").select("node", "n", F.col("x.tok").alias("g")), "member", like="held")
    sizes = member.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    placed = member.join(scratch.table(sizes, "parts", like="member"), "g").select("node", "g", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    placed = scratch.table(placed, "placed", like="member")

    matrix = tokens.drop("c").join(placed, "node").groupBy("tok", "g", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    matrix = scratch.table(matrix, "matrix", like="held")
    scratch.drop("held", "tokens", "member", "parts")
    a, b = matrix.alias("a"), matrix.alias("b")
    pairs = a.join(b, F.expr(f"a.tok = b.tok and (a.g < b.g or a.g = b.g and a.part < b.part) and {percent} * a.lo <= 100 * b.hi and {percent} * b.lo <= 100 * a.hi"))
    pairs = pairs.groupBy(F.expr("a.g ag"), F.expr("a.part ap"), F.expr("b.g bg"), F.expr("b.part bp")).agg(F.count("*").alias("k"), F.min(F.least("a.lo", "b.lo")).alias("m"))
    pairs = scratch.table(pairs.where(f"k > ceil({percent} * m / 100) div {EXTRA}").select("ag", "ap", "bg", "bp"), "pairs", like="matrix")
    scratch.drop("matrix")
    # a block is opened if another one qualifies or if it has two members
    met = pairs.select(F.col("ag").alias("g"), F.col("ap").alias("part"), F.lit(True).alias("met")).union(pairs.select("bg", "bp", F.lit(True)))
    blocks = placed.groupBy("g", "part").agg(F.count("*").alias("c"), F.lit(False).alias("met"))
    blocks = blocks.union(met.select("g", "part", F.lit(0), "met")).groupBy("g", "part").agg(F.sum("c").alias("c"), F.max("met").alias("met")).where("c > 1 or met")
    wanted = placed.join(scratch.table(blocks, "blocks", like="member"), ["g", "part"]).select("node", "g", "part", "met")
    wanted = scratch.table(wanted.join(own.select("node", "r", "r2", "s1", "s2"), "node"), "wanted", like="held")

    # documents without a partner in sight, mostly the bulk, are not even shuffled
    id_bits = min(MOST_BITS, max(LEAST_BITS, int((asked := wanted.count()) * 16).bit_length()))
    ids = sc.broadcast(twice_filter(wanted.select("r"), scramble, id_bits, once=True).tobytes())

    @F.pandas_udf("boolean")
    def grouped(column):
        return pd.Series(probe(np.frombuffer(ids.value, np.uint8), mix64(column.to_numpy(np.int64).view(np.uint64)), id_bits))

    opened = docs.select(row.alias("r"), row_2.alias("r2"), "text").where(grouped("r")).groupBy("r", "r2").agg(F.first("text").alias("text")).join(wanted, ["r", "r2"])
    opened = opened.groupBy("g", "part").agg(F.collect_list(F.struct("node", "s1", "s2", "text")).alias("rows"), F.first("met").alias("met")).select("g", "part", "met", "rows")
    edge = pa.schema([("g", pa.int64()), ("part", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("blob", pa.binary())])

    def inside(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held: dict[int, np.ndarray] = {}
                for row in batch.column(3)[i].as_py():
                    m = mix64(s := shingles(row["text"], k))
                    if (int(m.sum(dtype=np.uint64).astype(np.int64)), int(mix64(m).sum(dtype=np.uint64).astype(np.int64))) != (row["s1"], row["s2"]):
                        raise ValueError("a row's text isn't the one that its set came from")
                    held[row["node"]] = s
                block = Block.of(list(held), list(held.values()))
                g, part = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found = [{"g": g, "part": part, "u": u, "v": v} for u, v in links(block, block, percent)] if len(held) > 1 else []
                if batch.column(2)[i].as_py():
                    found.append({"g": g, "part": part, "blob": block.pack()})
                if found:
                    yield pa.RecordBatch.from_pylist(found, edge)

    opened = scratch.table(opened.mapInArrow(lean(inside), "g long, part int, u long, v long, blob binary"), "opened", pack=None, tasks=asked // A_TASK + 1)
    blobs = opened.where("blob is not null")
    across = pairs.join(blobs.select(F.col("g").alias("ag"), F.col("part").alias("ap"), F.col("blob").alias("x")), ["ag", "ap"])
    across = across.join(blobs.select(F.col("g").alias("bg"), F.col("part").alias("bp"), F.col("blob").alias("y")), ["bg", "bp"]).select("x", "y")

    def between(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = links(Block.unpack(batch.column(0)[i].as_py()), Block.unpack(batch.column(1)[i].as_py()), percent)
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    # written out, so that no task compares blocks in one worker and joins their links in another
    edges = scratch.table(opened.where("blob is null").select("u", "v").union(across.mapInArrow(lean(between), "u long, v long")), "edges")
    components = connected_components(edges)
    # from the least node of a component to its first set: that of the least id
    linked = scratch.table(components.join(own.select("node", "least", "s1", "s2", "n"), "node"), "linked", like="nodes")
    low = linked.groupBy("component").agg(F.min(F.struct("least", "s1", "s2", "n")).alias("c"))
    # written out, so that Spark can split a text with very many copies in the join
    linked = scratch.table(linked.join(low, "component").select("s1", "s2", "n", F.col("c.least").alias("c"), (F.struct("least", "s1", "s2", "n") == F.col("c")).alias("first")), "named", like="nodes")
    alone = own.select("s1", "s2", "n", "least")
    named = alone.join(linked, ["s1", "s2", "n"], "left").select("s1", "s2", "n", F.coalesce("c", "least").alias("c"), F.coalesce("first", F.lit(True)).alias("first"))
    named = scratch.table(named, "components", pack=None, like="nodes")
    scratch.drop("nodes", "placed", "pairs", "blocks", "wanted", "opened", "edges", "linked", "named")
    out = rows.join(named, ["s1", "s2", "n"], "left")
    stands = F.col("c").isNull() | (F.col("first") & F.col("d").eqNullSafe(F.col("c.id")))  # without shingles a row stands for itself
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("d")).otherwise(F.col("c.id")).alias("component_id"), stands.alias("stands"), F.col("w").alias("row_1"), F.col("w2").alias("row_2"))


def without_near_copies(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their component, see ngram_jaccard(); all columns.

    Rows that equal the one that stays in doc_id and text stay with it. Rows are told apart by id
    and text, so a null or repeated id keeps no near copy. Only texts that a filter says have to go
    are shuffled.
    """
    spark = docs.sparkSession
    gone = Scratch(spark, "gone").table(ngram_jaccard(docs, k=k, percent=percent).where("not stands").select("row_1", "row_2").distinct(), "rows")
    bits = min(MOST_BITS, max(LEAST_BITS, int(gone.count() * 16).bit_length()))
    may_go = spark.sparkContext.broadcast(twice_filter(gone.select("row_1"), lambda c: mix64(c.to_numpy(zero_copy_only=False).view(np.uint64)), bits, once=True).tobytes())

    @F.pandas_udf("boolean")
    def suspected(column):
        return pd.Series(probe(np.frombuffer(may_go.value, np.uint8), mix64(column.to_numpy(np.int64).view(np.uint64)), bits))

    one, two = fresh(docs, "row_1", "row_2")
    typed = docs.withColumns({one: F.col("doc_id").cast("long"), two: F.col("text").cast("string")})
    keyed = typed.withColumns(dict(zip((one, two), row_hash(one, two))))
    left = keyed.where(suspected(one)).join(gone.toDF(one, two), [one, two], "left_anti")
    return left.select(docs.columns).union(keyed.where(~suspected(one)).select(docs.columns))
