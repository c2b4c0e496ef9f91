"""A full-text index in immutable segments: edits cost what they change, and top-k opens few blocks.

A segment holds the postings of the documents of one commit. They are dealt into shards by document,
so that no term is ever one group, ordered by impact within (term, shard) and cut into blocks, each
with its largest term frequency and smallest length: a bound on what a document in it can score.
Blocks lie in folders by a hash of the term. Beside them lie a forward table (document, length,
terms) and, for each commit, a deletion vector (segment, document) and signed changes of the document
frequencies. A manifest names what is live; it is published by one rename. Segments of like size are
merged as soon as there are `fanout` of them, which is when deletions are worked in.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lexical import B, K1, LexicalIndex, forward_rows, phrases, saturation, top, units, weight
from ..staging import discard, little_disk, written
from .store import Store

#: Postings in a block, documents in a shard, folders by term, segments of one size that are merged.
BLOCK, SHARD, BUCKETS, FANOUT = 128, 200_000, 16, 8
#: Blocks of a query that are opened for a first threshold.
FIRST = 12
#: Scores are compared after rounding to six decimals, so a bound must miss the threshold by more.
SLACK = 2e-6
EMPTY = {"segments": [], "docs": 0, "tokens": 0, "commits": []}


class SegmentedIndex:
    """Commits of documents (id, text columns), and searches over what is live.

    fields maps a text column to its weight. The root belongs to one writer at a time: a commit that
    finds another one published since it began is refused.
    """

    def __init__(self, store: Store, fields: dict[str, float], *, key: str = "id", fanout: int = FANOUT, shard: int = SHARD, block: int = BLOCK):
        self.store, self.spark, self.fields, self.key = store, store.spark, fields, key
        self.fanout, self.shard, self.block = fanout, shard, block

    # -- what is live -----------------------------------------------------------------------------

    def manifest(self) -> dict:
        name = self.store.current()
        return json.loads(self.store.read_text("manifests", name)) | {"name": name} if name else {**EMPTY, "name": None}

    def read(self, *parts: str) -> DataFrame:
        return self.spark.read.parquet("/".join([self.store.root, *parts]))

    def parts(self, m: dict, table: str) -> DataFrame | None:
        """A table of all live segments, with their names."""
        found = [self.read("segments", s["name"], table).withColumn("segment", F.lit(s["name"])) for s in m["segments"]]
        out = found[0] if found else None
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def deleted(self, m: dict) -> DataFrame | None:
        """(segment, id) of deleted documents of live segments."""
        live, found = [s["name"] for s in m["segments"] if s["deleted"]], [self.read("commits", c, "deleted") for c in m["commits"]]
        if not live or not found:
            return None
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.where(F.col("segment").isin(live)).select("segment", self.key)

    def alive(self, rows: DataFrame, m: dict) -> DataFrame:
        gone = self.deleted(m)
        return rows if gone is None else rows.join(gone, ["segment", self.key], "left_anti")

    def frequencies(self, m: dict) -> DataFrame:
        """(term, n): documents that hold a term, by the signed changes of all commits."""
        out = self.read("commits", m["commits"][0], "changes")
        for c in m["commits"][1:]:
            out = out.unionByName(self.read("commits", c, "changes"))
        return out.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")

    # -- writing ----------------------------------------------------------------------------------

    def postings(self, rows: DataFrame) -> DataFrame:
        """term, id, tf (weighted), n, places and the document's length, of forward_rows()."""
        x = F.explode(F.arrays_zip("terms", "tfs", "ns", "places")).alias("x")
        return rows.select(self.key, "len", x).select("x.terms", self.key, "x.tfs", "x.ns", "len", "x.places").toDF("term", self.key, "tf", "n", "len", "places")

    def write_segment(self, name: str, postings: DataFrame, forward: DataFrame) -> dict:
        """Write a segment of postings and forward rows (id, len, terms, tfs), which also have documents without tokens.

        Only the postings are shuffled, once. Both are read from written tables.
        """
        folder = f"{self.store.root}/segments/{name}"
        forward.select(self.key, F.col("len").cast("long").alias("len"), *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("terms", "tfs")]).write.parquet(f"{folder}/forward")
        docs, tokens, n = self.read("segments", name, "forward").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.coalesce(F.sum(F.greatest(F.size("terms"), F.lit(0))), F.lit(0))).first()
        shards, average = max(1, -(-docs // self.shard)), max(1.0, tokens / max(1, docs))
        p = postings.withColumn("bucket", F.pmod(F.hash("term"), F.lit(BUCKETS))).withColumn("shard", F.pmod(F.hash(self.key), F.lit(shards)))
        order = W.partitionBy("bucket", "shard", "term").orderBy(saturation(F.col("tf"), F.col("len"), F.lit(average)).desc(), self.key)
        p = p.repartition("bucket", "shard").withColumn("block", F.floor((F.row_number().over(order) - 1) / self.block).cast("int"))
        rows = F.array_sort(F.collect_list(F.struct(self.key, "tf", "n", "len", "places")))
        blocks = p.groupBy("bucket", "shard", "term", "block").agg(rows.alias("r"), F.max("tf").alias("top_tf"), F.min("len").alias("least_len"))
        columns = [F.col(f"r.{c}").alias(a) for c, a in ((self.key, "ids"), ("tf", "tfs"), ("n", "ns"), ("len", "lens"), ("places", "places"))]
        blocks = blocks.select("bucket", "shard", "term", "block", "top_tf", "least_len", F.size("r").alias("size"), *columns)
        blocks.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/blocks")
        return {"name": name, "docs": docs, "tokens": tokens, "postings": n, "deleted": 0}

    def commit(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> str:
        """Insert or replace documents (one row an id), remove others; returns the manifest's name.

        Only the new documents are tokenised; of the old ones only the forward rows are read. An id
        that isn't there is removed without effect; one that is both changed and removed is changed.
        """
        with little_disk(self.spark):
            name = self._commit(changed, removed)
            return self.merge() or name

    def _commit(self, changed: DataFrame | None, removed: DataFrame | None) -> str:
        m = self.manifest()
        name = f"{int(time.time() * 1e6):017d}-{uuid.uuid4().hex[:8]}"
        docs = None if changed is None else written(forward_rows(changed.select(self.key, *self.fields), self.fields, self.key))
        ids = [d.select(self.key) for d in (docs, removed) if d is not None]
        if docs is not None and docs.groupBy(self.key).count().where("count > 1").limit(1).count():
            discard(docs)
            raise ValueError("a commit has two rows of one id")
        old, segments, signed = None, [dict(s) for s in m["segments"]], []
        if ids and segments:
            touched = ids[0] if len(ids) == 1 else ids[0].union(ids[1])
            old = written(self.alive(self.parts(m, "forward").join(touched.distinct(), self.key, "left_semi"), m).select("segment", self.key, "len", "terms"))
            signed.append(old.select(F.explode("terms").alias("term"), F.lit(-1).alias("s")))
            for r in old.groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect():  # a row a segment
                s = next(s for s in segments if s["name"] == r.segment)
                s["deleted"] += r.n
                m["docs"], m["tokens"] = m["docs"] - r.n, m["tokens"] - r.len
        folder = f"{self.store.root}/commits/{name}"
        (old if old is not None else self.spark.createDataFrame([], f"segment string, {self.key} {self._id_type(docs, removed)}")).select("segment", self.key).write.parquet(f"{folder}/deleted")
        if docs is not None:
            signed.append(docs.select(F.explode("terms").alias("term"), F.lit(1).alias("s")))
        changes = self.spark.createDataFrame([], "term string, s int") if not signed else signed[0] if len(signed) == 1 else signed[0].union(signed[1])
        changes.groupBy("term").agg(F.sum("s").alias("n")).where("n <> 0").write.parquet(f"{folder}/changes")
        if old is not None:
            discard(old)
        if docs is not None:
            made = self.write_segment(name, self.postings(docs), docs)
            segments.append(made)
            m["docs"], m["tokens"] = m["docs"] + made["docs"], m["tokens"] + made["tokens"]
            discard(docs)
        state = {"segments": [s for s in segments if s["deleted"] < s["docs"]], "docs": m["docs"], "tokens": m["tokens"], "commits": [*m["commits"], name]}
        self._publish(name, state, m["name"])
        return name

    def _id_type(self, *tables: DataFrame | None) -> str:
        return next((t.schema[self.key].dataType.simpleString() for t in tables if t is not None), "long")

    def _publish(self, name: str, state: dict, seen: str | None) -> None:
        if self.store.current() != seen:
            raise RuntimeError("another commit was published since this one began")
        self.store.write_text(json.dumps(state, sort_keys=True), "manifests", name)
        self.store.write_text(name, "current", replace=True)

    def merge(self) -> str | None:
        """Merge segments of one size (in powers of fanout) where there are fanout of them; None if there are not.

        A segment of which more than half is deleted is written anew as well.
        """
        done = None
        while True:
            m = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in m["segments"]:
                tiers.setdefault(int(math.log(max(1, s["postings"]), self.fanout)), []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= self.fanout), None) or [s for s in m["segments"] if 2 * s["deleted"] > s["docs"]]
            if not full:
                return done
            part = m | {"segments": full}
            name = f"{int(time.time() * 1e6):017d}-{uuid.uuid4().hex[:8]}"
            made = self.write_segment(name, self._exploded(self.parts(part, "blocks"), part, positions=True).drop("segment"), self.alive(self.parts(part, "forward"), part))
            kept = [s for s in m["segments"] if s["name"] not in {x["name"] for x in full}]
            self._publish(name, {"segments": [*kept, made], "docs": m["docs"], "tokens": m["tokens"], "commits": m["commits"]}, m["name"])
            done = name

    def prune(self) -> list[str]:
        """Remove the files of segments that the current manifest doesn't name; who reads by an older one fails then."""
        live = {s["name"] for s in self.manifest()["segments"]}
        base = self.store.path("segments")
        names = [s.getPath().getName() for s in self.store.fs.listStatus(base)] if self.store.fs.exists(base) else []
        gone = sorted(n for n in names if n not in live)
        for n in gone:
            self.store.fs.delete(self.store.path("segments", n), True)
        return gone

    # -- reading ----------------------------------------------------------------------------------

    def _exploded(self, blocks: DataFrame, m: dict, positions: bool = False) -> DataFrame:
        """Live postings of blocks: the columns of blocks but for the arrays, and id, tf, n, len (and places)."""
        arrays = {"ids": self.key, "tfs": "tf", "ns": "n", "lens": "len"} | ({"places": "places"} if positions else {})
        rest = [c for c in blocks.columns if c not in ("ids", "tfs", "ns", "lens", "places", "bucket", "shard", "block", "top_tf", "least_len", "size")]
        x = blocks.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("x"))
        return self.alive(x.select(*rest, *[F.col(f"x.{a}").alias(c) for a, c in arrays.items()]), m)

    def blocks_of(self, m: dict, terms: DataFrame) -> DataFrame:
        """Blocks of live segments that hold one of the terms (a written table, so that its size is known); other folders aren't listed."""
        wanted = [r[0] for r in terms.select(F.pmod(F.hash("term"), F.lit(BUCKETS))).distinct().collect()]  # BUCKETS numbers at most
        return self.parts(m, "blocks").where(F.col("bucket").isin(wanted)).join(terms.select("term"), "term", "left_semi")

    def whole(self) -> LexicalIndex:
        """All that is live, as the index that lexical.bm25() takes."""
        m = self.manifest()
        postings = self._exploded(self.parts(m, "blocks"), m, positions=True).withColumnRenamed(self.key, "id")
        lengths = self.alive(self.parts(m, "forward"), m).select(F.col(self.key).alias("id"), "len")
        stats = self.spark.createDataFrame([(m["docs"], m["tokens"] / m["docs"])], "docs long, avglen double")
        return LexicalIndex(postings.select("term", "id", "tf", "n", "places"), lengths, self.frequencies(m), stats)

    def top(self, queries: DataFrame, k: int, text: str = "query") -> tuple[DataFrame, DataFrame]:
        """(query_id, id, bm25, rank) of the k best documents of each query, and what was read for them.

        Equal to scoring every posting: ranks by score rounded to six decimals, ties by id. The
        second table has query_id, terms, blocks, opened (blocks whose postings were scored) and
        threshold.

        1. A query's blocks of the largest bounds are opened, and the documents that lead there are
           scored in full by their forward rows: the k-th best is a threshold for all others.
        2. Terms whose bounds together stay below the threshold can't make a document a result.
           Of the other terms, blocks are opened whose bound with the best of all other terms
           reaches the threshold: every result lies in such blocks alone.
        3. Documents found there that can still reach the threshold are scored in full.
        """
        m = self.manifest()
        u = units(queries, text)
        sizes = u.groupBy("query_id", "unit").agg(F.count("*").alias("parts"), F.min("term").alias("term"))
        docs, average = F.lit(m["docs"]), F.lit(m["tokens"] / max(1, m["docs"]))
        asked = sizes.where("parts = 1").select("query_id", "term").join(self.frequencies(m), "term").select("query_id", "term", weight(docs, F.col("n")).alias("w"))
        asked = written(asked.groupBy("query_id", "term").agg(F.sum("w").alias("w")))  # a term that is asked for twice counts twice
        share: Column = F.col("w") * saturation(F.col("tf"), F.col("len"), average)
        held = self.blocks_of(m, written(asked.select("term").distinct().coalesce(1)))
        place = ["segment", "shard", "term", "block"]
        bounds = held.select(*place, (F.col("top_tf") * (K1 + 1) / (F.col("top_tf") + K1 * ((1 - B) + B * F.col("least_len") / average))).alias("most"))
        bounds = written(asked.join(bounds, "term").withColumn("bound", F.expr("w * most")).drop("most"))
        more = self._phrase_hits(m, u, sizes)

        best = written(top(bounds, [F.desc("bound"), *place], FIRST, "k").select("query_id", *place, "w"))
        seen = self._sums(held, best, share, m)
        if more is not None:
            seen = seen.unionByName(more)
        seen = seen.groupBy("query_id", "id").agg(F.sum("share").alias("s"))
        leading = written(top(seen, [F.desc("s"), F.asc("id")], 4 * k, "k").select("query_id", "id"))
        exact = top(self._scored(leading, asked, share, more, m), [F.desc("bm25"), F.asc("id")], k, "k")
        least = exact.groupBy("query_id").agg(F.when(F.max("k") == k, F.min("bm25")).alias("t"))
        terms = bounds.groupBy("query_id", "term").agg(F.max("bound").alias("best"), F.count("*").alias("blocks"))
        terms = terms.join(least, "query_id", "left").withColumn("t", F.coalesce("t", F.lit(0.0)) - SLACK)
        if more is not None:  # phrases are scored in full; they may add to any document
            every = more.groupBy("query_id", "unit").agg(F.max("share").alias("x")).groupBy("query_id").agg(F.sum("x").alias("extra"))
            terms = terms.join(every, "query_id", "left").na.fill(0.0, ["extra"])
        else:
            terms = terms.withColumn("extra", F.lit(0.0))
        up = W.partitionBy("query_id").orderBy("best", "term")
        terms = terms.withColumn("below", F.sum("best").over(up)).withColumn("all", F.sum("best").over(W.partitionBy("query_id")))
        terms = written(terms.withColumn("essential", F.col("below") + F.col("extra") >= F.col("t")))
        opened = bounds.join(terms.where("essential").select("query_id", "term", "best", "all", "extra", "t"), ["query_id", "term"]).where("bound + all - best + extra >= t")
        opened = written(opened.select("query_id", *place, "w"))
        found = self._sums(held, opened, share, m)
        if more is not None:
            found = found.unionByName(more)
        # what the other terms add is bounded by their sum
        reach = terms.groupBy("query_id").agg(F.first("t").alias("t"), F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("best"))).alias("rest"))
        alive = found.groupBy("query_id", "id").agg(F.sum("share").alias("s")).join(reach, "query_id", "left").where("s + coalesce(rest, 0) >= coalesce(t, 0)").select("query_id", "id")
        scored = self._scored(written(alive), asked, share, more, m)
        read = terms.groupBy("query_id").agg(F.count("*").alias("terms"), F.sum("blocks").alias("blocks"), F.first("t").alias("threshold"))
        read = read.join(opened.groupBy("query_id").agg(F.count("*").alias("opened")), "query_id", "left").select("query_id", "terms", "blocks", F.coalesce("opened", F.lit(0)).alias("opened"), "threshold")
        return top(scored, [F.desc("bm25"), F.asc("id")], k), read

    def _scored(self, pairs: DataFrame, asked: DataFrame, share: Column, more: DataFrame | None, m: dict) -> DataFrame:
        """(query_id, id, bm25) of the pairs (query_id, id), a written table, by the documents' forward rows."""
        rows = self.alive(self.parts(m, "forward").join(pairs.select(F.col("id").alias(self.key)), self.key, "left_semi"), m)
        x = rows.select(F.col(self.key).alias("id"), "len", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", "len", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
        hits = x.join(asked, "term").join(pairs, ["query_id", "id"], "left_semi").select("query_id", "id", share.alias("share"))
        if more is not None:
            hits = hits.union(more.join(pairs, ["query_id", "id"], "left_semi").select("query_id", "id", "share"))
        return hits.groupBy("query_id", "id").agg(F.round(F.sum("share"), 6).alias("bm25"))

    def _sums(self, held: DataFrame, wanted: DataFrame, share: Column, m: dict) -> DataFrame:
        """(query_id, id, share, unit) of the postings of the wanted blocks (query_id, place, w)."""
        place = ["segment", "shard", "term", "block"]
        needed = held.join(wanted.select(*place), place, "left_semi")
        x = needed.select(*place, F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("x")).select(*place, F.col("x.ids").alias(self.key), F.col("x.tfs").alias("tf"), F.col("x.lens").alias("len"))
        x = self.alive(x, m).withColumnRenamed(self.key, "id")
        return x.join(wanted, place).select("query_id", "id", share.alias("share"), F.lit(None).cast("string").alias("unit"))

    def _phrase_hits(self, m: dict, u: DataFrame, sizes: DataFrame) -> DataFrame | None:
        """What units of several terms add, scored in full: (query_id, id, share, unit)."""
        several = written(u.join(sizes.where("parts > 1").select("query_id", "unit", "parts"), ["query_id", "unit"]))
        if several.isEmpty():
            return None
        postings = self._exploded(self.blocks_of(m, written(several.select("term").distinct())), m, positions=True).withColumnRenamed(self.key, "id")
        lengths = postings.select("id", "len").distinct()
        index = LexicalIndex(postings.select("term", "id", "places"), lengths, self.frequencies(m), lengths)
        hits = phrases(index, several).join(lengths, "id")
        average = F.lit(m["tokens"] / max(1, m["docs"]))
        return written(hits.select("query_id", "id", (weight(F.lit(m["docs"]), F.col("n")) * saturation(F.col("tf"), F.col("len"), average)).alias("share"), "unit"))
