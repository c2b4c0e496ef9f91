"""Retrieval evaluation: recall, reciprocal rank, no-answer accuracy, leakage, latency, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(column: str, fraction: float) -> Column:
    """Percentile by nearest rank."""
    return F.expr(f"percentile_disc({fraction}) within group (order by {column})")


def judge(cases: DataFrame, results: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a case: first_hit (rank of the first expected id, null if none), leaks, cited, passed.

    cases: query_id, expected (ids, any of which will do), forbidden, expected_path, no_answer;
    results: query_id, id, path, rank; answers: query_id, answered.
    """
    r = cases.join(results, "query_id", "left").groupBy("query_id").agg(
        F.min(F.when(F.array_contains("expected", F.col("id")), F.col("rank"))).alias("first_hit"),
        F.count_if(F.array_contains("forbidden", F.col("id"))).alias("leaks"),
        F.coalesce(F.max(F.when(F.col("expected_path").isNotNull(), (F.col("path") == F.col("expected_path")).cast("int"))), F.lit(1)).alias("cited"),
        F.count_distinct("id").alias("distinct_ids"), F.count("id").alias("returned"),
    )
    j = cases.select("query_id", "no_answer").join(r, "query_id").join(answers, "query_id", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    ok = F.when(F.col("no_answer"), ~F.col("answered")).otherwise(F.col("answered") & F.col("first_hit").isNotNull() & (F.col("cited") == 1))
    return j.withColumn("passed", ok & (F.col("leaks") == 0))


def summary(judged: DataFrame, at: int = 5) -> DataFrame:
    """One row: cases, passed, recall_at_1, recall_at_k, mrr, no_answer_accuracy, leakage, citation_failures, diversity."""
    asked = ~F.col("no_answer")
    hit = lambda k: F.avg(F.when(asked, F.coalesce((F.col("first_hit") <= k).cast("int"), F.lit(0))))
    return judged.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), hit(1).alias("recall_at_1"), hit(at).alias("recall_at_k"),
        F.avg(F.when(asked, F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)))).alias("mrr"), F.avg(F.when(~asked, (~F.col("answered")).cast("int"))).alias("no_answer_accuracy"),
        F.avg((F.col("leaks") > 0).cast("int")).alias("leakage"), F.count_if(asked & (F.col("cited") == 0)).alias("citation_failures"),
        F.coalesce(F.sum("distinct_ids") / F.sum("returned"), F.lit(1.0)).alias("diversity"),
    )
