"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change to a document is a signed row: +tokens and +1 document for an insert, the negatives for a
delete, both for a revised count. Batches are summed before they are stored, totals are the sums
over all committed batches, and a batch that is committed again changes nothing.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import WORD_PATTERN, bounded, remainder

KEYS = ("source", "lang", "tokenizer")
#: Files of a batch.
FILES = 4


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns in keep and `tokens`, the BPE tokens of each whole text; a null text has none."""
    return bpe_encode(docs, path, ids=False, keep=keep).withColumnRenamed("n_tokens", "tokens")


def count_words(texts):
    return F.coalesce(F.regexp_count(texts, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """Deltas (source, lang, tokenizer, docs, tokens) of changes.

    changes: op ('insert', 'delete' or 'revise'), source, lang, tokenizer, tokens (the count in
    force after an insert or a revision, or the one a delete takes away), old_tokens (the count
    that a revision replaces). Null counts are 0; other ops are an error when a row is read.
    """
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    return changes.select(*KEYS, docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


class TokenRollup:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(self._place(batch_id)))

    def _place(self, batch_id: str) -> str:
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"batch id {batch_id!r}")
        return f"{self.folder}/batches/{batch_id}"

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Sum and store a batch of deltas; False, and no effect, if the id is committed.

        The files are written aside, in a folder of this call's own, and appear under the id by one
        rename that refuses an id in place. So a run that dies half-way leaves nothing that
        counts, and of two writers of one id one wins (where the store's rename is atomic).
        """
        place = self._place(batch_id)
        if self.committed(batch_id):
            return False
        aside = f"{self.folder}/pending/{batch_id}-{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.coalesce(FILES).write.parquet(aside)  # a row a group, so few files do
        self._fs.mkdirs(self._path(f"{self.folder}/batches"))
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        whole = hadoop.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            whole.rename(self._path(aside), self._path(place), sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), True)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all batches; groups that came to nothing are left out."""
        rows = self.spark.read.schema("source string, lang string, tokenizer string, docs long, tokens long").option("recursiveFileLookup", "true").parquet(f"{self.folder}/batches")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def corpus_counts(docs: DataFrame, rollup: TokenRollup, path: str) -> DataFrame:
    """Bring a corpus into a rollup and return its totals, under two tokenizer versions.

    Batch `load` inserts every document with its words and an estimate of its BPE tokens (a
    quarter of its bytes), batch `revise` replaces the estimate by the exact count. Batch
    `withdraw` deletes the word counts of documents whose crc32(doc_id) mod 16 is 0, batch
    `restore` inserts them again. Each is committed twice, which must count once. Null sources and
    languages are groups of their own, a null text has no tokens, repeated rows count each.
    """
    bounded(docs.sparkSession)
    estimate = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    none = F.lit(None).cast("long").alias("old_tokens")
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), n.alias("tokens")) for t, n in (("words-1", count_words(F.col("text"))), ("byte_bpe_50k-1", estimate))]))
    load = base.withColumn("x", both).select(F.lit("insert").alias("op"), "source", "lang", "x.tokenizer", "x.tokens", none)
    exact = count_tokens(base.withColumn("old_tokens", estimate), path, ("source", "lang", "old_tokens"))
    revise = exact.select(F.lit("revise").alias("op"), "source", "lang", F.lit("byte_bpe_50k-1").alias("tokenizer"), "tokens", "old_tokens")
    some = base.where(remainder(F.col("doc_id"), 16) == 0).select("source", "lang", F.lit("words-1").alias("tokenizer"), count_words(F.col("text")).alias("tokens"), none)
    for batch_id, changes in (("load", load), ("revise", revise), ("withdraw", some.withColumn("op", F.lit("delete"))), ("restore", some.withColumn("op", F.lit("insert")))):
        for _ in range(2):
            rollup.commit(batch_id, signed(changes))
    return rollup.totals()
