"""Registered queries of the segmented index, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import POSTINGS, SCORED, UNITS, best, passages, query, t
from .sources.segments import SegmentedIndex
from .sources.store import Store
from .staging import shared

FIELDS = {"text": 1.0}
_BUILT: dict[tuple, str] = {}


def new_root(spark: SparkSession, what: str) -> str:
    return f"{shared(spark)}/{what}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


def generation(spark: SparkSession, sf: str) -> SegmentedIndex:
    """The index of the documents as they are now: built once, then read by every query of the session."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    status = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(files)
    key = (spark.sparkContext.applicationId, sf, status.getModificationTime(), status.getLen())
    if key not in _BUILT:
        root = new_root(spark, "index")
        SegmentedIndex(Store(spark, root), FIELDS).commit(documents(spark, sf))
        _BUILT[key] = root
    return SegmentedIndex(Store(spark, _BUILT[key]), FIELDS)


TOP = f"with {UNITS}, {POSTINGS}, {SCORED} select query_id, id, round(s, 6) as score, row_number() over (partition by query_id order by round(s, 6) desc, id) as rank from scored qualify rank <= 5"


@query(TOP)
def bm25_block_max(spark, sf):
    """The five best documents by blocks that can hold one of them."""
    found, _ = generation(spark, sf).top(passages(spark, sf), 5)
    return found.select("query_id", "id", F.col("bm25").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(TOP)
def bm25_three_generations(spark, sf):
    """The same over an index that came to hold the documents by an insert, edits with removals, and an insert again."""
    index = SegmentedIndex(Store(spark, new_root(spark, "index")), FIELDS)
    docs = documents(spark, sf)
    index.commit(docs.withColumn("text", F.when(F.col("lang") == "en", F.reverse("text")).otherwise(F.col("text"))))
    index.commit(docs.where("lang = 'en'"), docs.where("lang = 'de'"))
    index.commit(docs.where("lang = 'de'"))
    index.prune()
    found, _ = index.top(passages(spark, sf), 5)
    return found.select("query_id", "id", F.col("bm25").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {POSTINGS} select term, cast(count(*) as bigint) as n from tf group by term")
def signed_frequencies(spark, sf):
    """Document frequencies as the sum of what three commits changed."""
    index = SegmentedIndex(Store(spark, new_root(spark, "index")), FIELDS)
    docs = documents(spark, sf)
    index.commit(docs.withColumn("text", F.concat_ws(" ", "text", F.lit("stale"))))
    index.commit(None, docs.where("lang = 'fr'"))
    index.commit(docs)
    index.prune()
    return index.frequencies(index.manifest()).select("term", F.col("n").cast("long").alias("n"))
