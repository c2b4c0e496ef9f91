"""Versioned tables: immutable generations, a pointer, retention, backup, audit lines, objects."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds after which a lease whose holder died no longer counts.
LEASE = 86_400.0


class Store:
    """Generations of named tables below a root, on any file system that Spark reaches.

    A generation is written aside and becomes current by one rename of the pointer file; readers
    resolve the pointer once. A failed publication leaves the previous one current.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self._Path("/".join([self.root, *parts]))

    def read_text(self, *parts: str) -> str | None:
        if not self.fs.exists(self.path(*parts)):
            return None
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, text: str, *parts: str, replace: bool = False) -> None:
        """Written aside, then renamed in one step, over an existing file only with replace.

        Readers see the old text or the new one, never none (as far as the store renames atomically).
        """
        target, aside = self.path(*parts), self.path(*parts[:-1], f".{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop, kind = sc._jvm.org.apache.hadoop.fs, getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else getattr(kind, "NONE")
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), sc._jsc.hadoopConfiguration()).rename(aside, target, how)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise FileExistsError("/".join(parts)) from None
            raise

    # -- generations ------------------------------------------------------------------------------

    def publish(self, tables: dict[str, DataFrame], meta: dict | None = None, check=None) -> str:
        """Write all tables, validate them, then move the pointer; returns the generation's id.

        check(tables as read back) raises to refuse the generation, which is then removed.
        """
        gen = f"{int(time.time() * 1e6):017d}-{uuid.uuid4().hex[:8]}"
        try:
            counts = {}
            for name, df in tables.items():
                df.write.mode("errorifexists").parquet(f"{self.root}/gen/{gen}/{name}")
                counts[name] = self.table(gen, name).count()
            if check is not None:
                check({name: self.table(gen, name) for name in tables})
            self.write_text(json.dumps({"id": gen, "tables": counts, "meta": meta or {}}, sort_keys=True), "gen", gen, "manifest.json")
        except BaseException:
            self.fs.delete(self.path("gen", gen), True)
            raise
        self.write_text(gen, "current", replace=True)
        return gen

    def current(self) -> str | None:
        return self.read_text("current")

    def manifest(self, gen: str) -> dict:
        text = self.read_text("gen", gen, "manifest.json")
        if text is None or (m := json.loads(text))["id"] != gen:
            raise ValueError(f"generation {gen} has no valid manifest")
        return m

    def table(self, gen: str, name: str) -> DataFrame:
        if "/" in name or name.startswith("."):
            raise ValueError(f"table name {name!r}")
        return self.spark.read.parquet(f"{self.root}/gen/{gen}/{name}")

    def verified(self, gen: str) -> bool:
        """Whether all tables are there with the rows that the manifest says."""
        try:
            return all(self.table(gen, n).count() == k for n, k in self.manifest(gen)["tables"].items())
        except Exception:  # noqa: BLE001  any unreadable part makes it unfit
            return False

    def generations(self) -> list[str]:
        base = self.path("gen")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(base)) if self.fs.exists(base) else []

    @contextmanager
    def lease(self, gen: str | None = None, seconds: float = LEASE):
        """Pin a generation while it is read; retention keeps it, until the lease ends or its time is over."""
        gen, name = gen or self.current(), uuid.uuid4().hex
        self.write_text(json.dumps({"id": gen, "until": time.time() + seconds}), "leases", name)
        try:
            yield gen
        finally:
            self.fs.delete(self.path("leases", name), False)

    def leased(self) -> set[str]:
        base = self.path("leases")
        texts = [self.read_text("leases", s.getPath().getName()) for s in self.fs.listStatus(base) if not s.getPath().getName().startswith(".")] if self.fs.exists(base) else []
        return {x["id"] for x in map(json.loads, filter(None, texts)) if x["until"] > time.time()}

    def retain(self, keep: int) -> list[str]:
        """Remove generations other than the current, the newest keep - 1 verified ones and leased ones."""
        current, kept = self.current(), set()
        for g in reversed([g for g in self.generations() if g != current]):
            if len(kept) < keep - 1 and self.verified(g):
                kept.add(g)
        gone = [g for g in self.generations() if g not in kept | self.leased() | {current}]
        for g in gone:
            self.fs.delete(self.path("gen", g), True)
        return gone

    # -- backup -----------------------------------------------------------------------------------

    def backup(self, to: str) -> str:
        """Copy the current generation to a new place and verify the copy."""
        gen, target = self.current(), Store(self.spark, to)
        if target.generations():
            raise FileExistsError(to)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target.fs.mkdirs(target.path("gen"))
        jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path("gen", gen), target.fs, target.path("gen", gen), False, conf)
        if not target.verified(gen):
            raise OSError("the copy differs")
        target.write_text(gen, "current")
        return gen

    def restore(self, to: str) -> str:
        return self.backup(to)

    def health(self) -> dict:
        gen = self.current()
        ok = gen is not None and self.verified(gen)
        return {"generation": gen, "status": "ok" if ok else "missing" if gen is None else "damaged", "tables": self.manifest(gen)["tables"] if ok else {}}


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Files with their content address: path, sha256, size, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def damaged(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected objects (sha256) that are missing, or stored under a name that isn't their hash."""
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return expected.join(named.where("name = sha256").select("sha256"), "sha256", "left_anti")


def unreferenced(found: DataFrame, links: DataFrame) -> DataFrame:
    """Objects that no link names: those a redaction may quarantine."""
    return found.select("sha256").distinct().join(links.select("sha256"), "sha256", "left_anti")


def audit_line(stream: str, event: str, payload: dict) -> str:
    """A line for an audit log; texts that users wrote are only hashed."""
    import hashlib

    shown = {k: ({"sha256": hashlib.sha256(v.encode()).hexdigest(), "length": len(v)} if k in ("query", "text") and isinstance(v, str) else v) for k, v in payload.items()}
    return json.dumps({"stream": stream, "event": event, "at": time.time(), **shown}, sort_keys=True, ensure_ascii=False)


def append_audit(store: Store, stream: str, event: str, payload: dict) -> bool:
    """Add one line as a file of its own; never fails the caller."""
    try:
        store.write_text(audit_line(stream, event, payload) + "\n", "audit", stream, f"{int(time.time() * 1e6)}-{uuid.uuid4().hex[:6]}.jsonl")
        return True
    except Exception:  # noqa: BLE001
        return False
