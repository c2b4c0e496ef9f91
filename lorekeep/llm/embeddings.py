"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

1. Equal vectors of a label become one node with a count.
2. Spherical k-means is fitted on a bounded sample, at every size: k follows the largest label, and
   beyond FLAT cells the centroids form a tree of two levels. Every vector goes to its nearest
   centroid. A label's cell is dealt into blocks of bounded size, each with its mean direction
   and widest angle (its cap).
3. Caps are compared in bounded groups, group by group. Two blocks are compared if their caps come
   within the angle of the threshold: the triangle inequality on the sphere shows that no other
   blocks can hold a link, so none is lost. A pair of blocks is one matrix product in double
   precision; what leaves it is a count per vector and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, connected_components, null_last
from .jaccard import tree

#: Vectors a block, rows of a product, caps of a group.
BLOCK, TILE, CAPS = 2_048, 512, 512
#: Cells at least and at most, cells of one level, vectors a cell and bytes in all that centroids are fitted on.
LEAST_CELLS, MOST_CELLS, FLAT, A_CELL, SAMPLE_BYTES = 4, 16_384, 64, 64, 64 << 20


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow or underflow."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors: assign by cosine, move to the mean direction; empty cells stay."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        new = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c


class Cells:
    """Centroids in one level or, beyond FLAT of them, two: a vector descends to the nearest at each."""

    def __init__(self, x: np.ndarray, k: int):
        top = k if k <= FLAT else int(np.ceil(np.sqrt(k)))
        self.top = spherical_kmeans(x, top).astype(np.float32)
        self.below: list[np.ndarray] = []
        if k > FLAT:
            near = (x @ self.top.T).argmax(1)
            self.below = [spherical_kmeans(x[near == j], -(-k // top)).astype(np.float32) if (near == j).any() else c[None, :] for j, c in enumerate(self.top)]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        near = (x @ self.top.T).argmax(1)
        out = near.astype(np.int32) << 14
        for j in np.unique(near).tolist() if self.below else ():
            at = near == j
            out[at] += (x[at] @ self.below[j].T).argmax(1).astype(np.int32)
        return out


def fit_cells(distinct: DataFrame, largest: int) -> dict[int, Cells]:
    """Cells by dimension, fitted on the vectors that come first by a hash."""
    k = min(MOST_CELLS, max(LEAST_CELLS, -(-largest // BLOCK)))
    widest = distinct.agg(F.max(F.size("x"))).first()[0] or 1
    most = max(k, min(A_CELL * k, SAMPLE_BYTES // (8 * widest)))
    sample = distinct.select("x", "h1", "h2").orderBy("h1", "h2").limit(most).select("x").toArrow().column("x").combine_chunks()
    flat, ends = sample.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(sample.offsets.to_numpy()))])
    sizes = np.diff(ends)
    return {int(d): Cells(unit(np.stack([flat[ends[i] : ends[i + 1]] for i in np.flatnonzero(sizes == d)])), k) for d in np.unique(sizes)}


def embedding_neardup(vectors: DataFrame, *, threshold: float = 0.93) -> DataFrame:
    """Near-duplicates among vectors of equal label.

    vectors: vec_id, embedding (array of float or double), label. Returns one row per row:
    vec_id, n_links (other rows with a cosine >= threshold), component_id (the smallest vec_id
    reachable by links, itself included), kept (vec_id = component_id). A vector that is null,
    empty, zero or holds a null or a non-finite component, or whose label is null, links with
    nothing; vectors of different lengths don't link. A null vec_id stays null, is larger than
    all others and is counted by its neighbours. Vectors link, not ids: rows that repeat a vec_id
    (null too) with another vector are nodes of their own. Equal vectors go by a 128-bit hash.
    """
    spark = bounded(vectors.sparkSession)
    scratch = Scratch(spark, "embeddings")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    good = F.expr("label is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)")
    v = v.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("i", null_last("vec_id"))
    v = v.select("vec_id", "i", "label", *[F.when(F.col("ok"), c).alias(n) for n, c in (("x", F.col("e")), ("h1", F.xxhash64("label", "e")), ("h2", F.xxhash64(F.lit("again"), "e", "label")))])
    own = v.where("x is not null").groupBy("h1", "h2").agg(F.min("i").alias("least"), F.count("*").alias("c"), F.first("label").alias("label"), F.first("x").alias("x"))
    # nodes are numbered by where their rows lie, as an id may repeat or be null
    distinct = scratch.table(own.withColumn("node", F.monotonically_increasing_id()), "distinct", pack=None)
    largest = distinct.groupBy("label", F.size("x")).count().agg(F.max("count")).first()[0] or 0
    shared = spark.sparkContext.broadcast(fit_cells(distinct, largest) if largest else {})
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64

    @F.pandas_udf("int")
    def cell(xs: pd.Series) -> pd.Series:
        out = np.zeros(len(xs), np.int32)
        dims = xs.map(len)
        for dim in dims.unique():
            if int(dim) in shared.value:  # a dimension that the sample lacks is one cell
                at = np.flatnonzero((dims == dim).to_numpy())
                out[at] = shared.value[int(dim)].of(unit(np.stack(xs.iloc[at].to_list())))
        return pd.Series(out)

    placed = distinct.select("node", "c", "label", "x", F.size("x").alias("dim"), cell("x").alias("cell"))
    sizes = scratch.table(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "cells")
    placed = placed.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = np.stack(pdf["x"].to_list())
        u = unit(x)
        mean = u.mean(0)
        norm = np.linalg.norm(mean)
        mean = mean / norm if norm > 1e-12 else u[0]
        reach = float(np.arccos(np.clip(u @ mean, -1, 1)).max())
        label, dim, c, part = key
        return pd.DataFrame({"label": [label], "dim": [dim], "block": [int(c) * 2**32 + int(part)], "mean": [mean.tobytes()], "reach": [reach], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()], "counts": [pdf["c"].to_numpy(np.int64).tobytes()], "u": [x.astype(kind).tobytes()]})

    blocks = placed.select("label", "dim", "cell", "part", "node", "c", "x").groupBy("label", "dim", "cell", "part").applyInPandas(block, "label string, dim int, block long, mean binary, reach double, nodes binary, counts binary, u binary")
    blocks = scratch.table(blocks, "blocks", pack=None)

    # caps meet in groups of bounded size, so that no label is one task
    caps = blocks.select("label", "dim", "block", "mean", "reach")
    groups = scratch.table(caps.groupBy("label", "dim").agg(F.ceil(F.count("*") / CAPS).cast("int").alias("groups")), "groups")
    caps = caps.join(groups, ["label", "dim"]).withColumn("s", F.pmod(F.xxhash64("block"), "groups").cast("int"))
    caps = scratch.table(caps.groupBy("label", "dim", "groups", "s").agg(F.collect_list(F.struct("block", "mean", "reach")).alias("caps")), "caps")
    left = caps.select("label", "dim", "s", F.explode(F.expr("sequence(s, groups - 1)")).alias("t"), F.col("caps").alias("x"))
    met = left.join(caps.select("label", "dim", F.col("s").alias("t"), F.col("caps").alias("y")), ["label", "dim", "t"])
    limit = float(np.arccos(threshold)) + 1e-6

    def near(batches):
        for batch in batches:
            for label, dim, s, t, x, y in zip(*(batch.column(i).to_pylist() for i in range(6))):
                (p, xm, xr), (q, ym, yr) = ((np.array([c["block"] for c in z]), np.stack([np.frombuffer(c["mean"]) for c in z]), np.array([c["reach"] for c in z])) for z in (x, y))
                hit = np.arccos(np.clip(xm @ ym.T, -1, 1)) <= xr[:, None] + yr[None, :] + limit
                if s == t:
                    hit &= p[:, None] <= q[None, :]
                a, b = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(a), pa.string()), pa.array(np.full(len(a), dim, np.int32)), pa.array(p[a]), pa.array(q[b])], ["label", "dim", "p", "q"])

    pairs = scratch.table(met.select("label", "dim", "s", "t", "x", "y").mapInArrow(near, "label string, dim int, p long, q long"), "pairs")
    data = blocks.select("label", "dim", "block", "nodes", "counts", "u")
    side = lambda name, tag: data.select("label", "dim", F.col("block").alias(name), *[F.col(c).alias(f"{c}_{tag}") for c in ("nodes", "counts", "u")])
    # each pair is a task's work of its own, so they are dealt evenly first, while they are small
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(4 * width, "label", "dim", "p", "q")
    work = pairs.join(side("p", "a"), ["label", "dim", "p"]).join(side("q", "b"), ["label", "dim", "q"])
    schema = pa.schema([(c, pa.int64()) for c in ("node", "n", "u", "v")])

    def arrow(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in schema.names], schema=schema)

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim, same = r["dim"], r["p"] == r["q"]
                xi, xc, yi, yc = (np.frombuffer(r[c], np.int64) for c in ("nodes_a", "counts_a", "nodes_b", "counts_b"))
                x, y = (unit(np.frombuffer(r[c], kind).reshape(-1, dim)) for c in ("u_a", "u_b"))
                nx, ny, spans = np.zeros(len(xi), np.int64), np.zeros(len(yi), np.int64), []
                for at in range(0, len(x), TILE):
                    mask = x[at : at + TILE] @ y.T >= threshold
                    if same:
                        mask[np.arange(len(mask)), at + np.arange(len(mask))] = False
                    nx[at : at + TILE] = mask @ yc
                    ny += xc[at : at + TILE] @ mask
                    spans += tree(mask, xi[at : at + TILE], yi)
                for i, m in [(xi, nx)] if same else [(xi, nx), (yi, ny)]:
                    if m.any():
                        yield arrow(node=i[m > 0], n=m[m > 0])
                if spans:
                    u, v = zip(*spans)
                    yield arrow(u=u, v=v)

    found = work.select("dim", "p", "q", *[f"{c}_{t}" for t in "ab" for c in ("nodes", "counts", "u")]).mapInArrow(compare, "node long, n long, u long, v long")
    found = scratch.table(found, "found", pack=None)
    links = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("u is not null").select("u", "v")).join(distinct.select("node", "least"), "node")
    components = scratch.table(components, "components")
    roots = components.join(components.groupBy("component").agg(F.min("least").alias("root")), "component").select("node", "root")
    stands = distinct.select("h1", "h2", "node", "least", "c").join(links, "node", "left").join(roots, "node", "left")
    # written out, so that Spark can split a vector with very many copies in the join
    stands = scratch.table(stands.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("root", "least").alias("root")), "stands", pack=None)
    scratch.drop("distinct", "cells", "blocks", "groups", "caps", "pairs", "found", "components")
    out = v.select("vec_id", "i", "h1", "h2").join(stands, ["h1", "h2"], "left")
    root = F.coalesce("root", "i")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.getField("id").alias("component_id"), (F.col("i") == root).alias("kept"))
