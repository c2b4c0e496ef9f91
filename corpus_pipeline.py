"""Corpus pipeline: quality, line dedup, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns
as Parquet in the shared folder and gives the rows read back to the next. All but the last return
the columns of documents. n_chars follows the text where a stage shortens it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.bpe import bpe_encode
from lorekeep.llm.common import new_folder
from lorekeep.llm.jaccard import without_near_copies
from lorekeep.llm.lines import line_dedup
from lorekeep.llm.mixing import mixed_copies
from lorekeep.llm.quality import quality_scores
from lorekeep.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels).where("predicted = 1").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds; a document left without any text goes."""
    kept = line_dedup(docs).where("n_dropped = 0 or length(text) > 0")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each component of five-word Jaccard 0.8.

    A null doc_id counts as larger than all others; rows that repeat the kept document, id and
    text, stay with it.
    """
    return without_near_copies(docs, k=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the source mix takes: none, one or two."""
    return mixed_copies(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, each decoded again and compared with its text."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), check=True, keep=("doc_id", "source", "lang"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", token_stage),
]

#: The classifier, the mix and the tokens aren't SQL: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; returns the last stage's rows."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
