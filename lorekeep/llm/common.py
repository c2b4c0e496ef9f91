"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the only characters that separate words or frame lines.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Edges of a graph that one task settles.
A_TASK = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path.

    It is spark.checkpoint.dir; only where that is unset and all runs in one process (tests) a
    temporary folder is set. On a cluster without the setting this is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[[\d*,]+\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lorekeep-checkpoint-")
        sc.setCheckpointDir(where)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A written copy of df in the shared folder, which cuts its lineage and survives lost executors."""
    return Scratch(df.sparkSession, "cut").table(df, "rows")


class Scratch:
    """Tables written below the shared folder: they cut lineage, survive lost executors and have sizes.

    A table is read back in about one partition for each PACK bytes of its files, however many
    tasks wrote it, so that what follows a small table needs neither many tasks nor a shuffle.
    """

    PACK = 1 << 20

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder = spark, new_folder(spark, what)
        self.sizes: dict[str, int] = {}
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self._conf), path

    def table(self, df: DataFrame, name: str, *, pack: int | None = PACK, like: str | None = None, tasks: int | None = None) -> DataFrame:
        """df, written once; pack: bytes a partition at least when it is read, None leaves it to Spark.

        like names a table that df is not much larger than: a task then writes PACK bytes of it or
        more. tasks: at most so many write. Neither adds tasks, so a large table keeps its own.
        """
        if like is not None:
            tasks = -(-self.sizes[like] // self.PACK)
        out = df if tasks is None else df.coalesce(max(1, tasks))
        out.write.option("parquet.block.size", 16 << 20).parquet(f"{self.folder}/{name}")
        back = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")
        fs, path = self._at(name)
        self.sizes[name] = fs.getContentSummary(path).getLength()
        return back if pack is None else back.coalesce(max(1, -(-self.sizes[name] // pack)))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            fs, path = self._at(name)
            fs.delete(path, True)


def bounded(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that a task's buffers stay bounded however long the texts are.

    A batch ends at 1,024 rows or 8 MB; a session with smaller values keeps them.
    """
    for name, most, start in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024, "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, str(64 << 20))):
        now = spark.conf.get(name, start)
        value = int(re.sub(r"\D", "", now) or 0) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("bB")[-1:].lower(), 1)
        if value <= 0 or value > most:
            spark.conf.set(name, str(most))
    return spark


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: What a Python worker keeps from task to task, by operator.
KEPT: dict[str, dict] = {}


def let_go(keeps: str | None) -> None:
    """Drop what other operators keep in this worker."""
    for name, held in KEPT.items():
        if name != keeps:
            held.clear()


def lean(run, keeps: str | None = None):
    """A task's function over batches that gives its memory back to the system when it ends.

    Python workers outlive tasks, and what their allocators keep would add up beside the JVM's heap.
    So would a second worker for a task: what feeds run in Python belongs into run, not before it.
    keeps: the operator whose KEPT stays.
    """

    def tidy(batches):
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def null_last(doc_id: str) -> Column:
    """An id as something ordered: null behind every value, without a value that stands for it."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))


def row_hash(doc_id: str, *rest: str) -> list[Column]:
    """128 bits for a row by its id and other columns, null unlike any value."""
    parts = [x for c in (doc_id, *rest) for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("again"), *reversed(parts))]


class Stars:
    """Union-find over edges: each node's least node so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def add(self, pdf: pd.DataFrame) -> None:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def edges(self) -> pd.DataFrame:
        pairs = [(x, self.root(x)) for x in list(self.parent)]
        return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["u", "v"], dtype="int64")


def star_edges(batches):
    """Replace stretches of a task's edges by stars that connect the same nodes: at most one edge a node."""
    stars = Stars()
    for pdf in batches:
        stars.add(pdf)
        if len(stars.parent) > A_TASK:
            yield stars.edges()
            stars = Stars()
    yield stars.edges()


def star_edges_of_all(batches):
    """One star a component, for edges that are all in this task."""
    stars = Stars()
    for pdf in batches:
        stars.add(pdf)
    yield stars.edges()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with edges (u, v): one row (node, component) per node.

    component is the smallest node reachable. Each task first replaces its edges by stars. At most
    A_TASK edges that are left are settled in one task; more of them alternate large and small
    stars until nothing changes: grouped minima (combined before the shuffle) and equi-joins, whose
    hot keys Spark can split. No part of the graph goes to the driver. An edge with a null end and
    a self-loop link nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v")
    e = scratch.table(e.mapInPandas(lean(star_edges), "u long, v long"), "stars")
    seen = None
    for step in range(most_rounds):
        n = e.count()
        if n <= A_TASK:
            e = scratch.table(e.coalesce(1).mapInPandas(lean(star_edges_of_all), "u long, v long"), "settled", tasks=1)
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.table(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"round{step}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"round{step - 1}" if step else "stars")
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (shift, xor and odd factors)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def int_blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
