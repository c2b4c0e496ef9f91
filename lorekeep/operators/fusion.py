"""Reciprocal rank fusion, bounded rerank signals, the answer gate and the merge with raw evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_tokens, identifiers, query_tokens, quoted_phrases
from .lexical import top

# Fusion constant, bonuses and their caps, half-lives in days, gates.
RRF_K = 60
FRESH, HALF_LIFE, OVERDUE = 0.03, 180.0, 0.03
RAW_HALF_LIFE = {"meeting": 90.0, "recording": 90.0, "transcript": 90.0, "transcript-cue": 90.0}
RAW_DEFAULT_HALF_LIFE = 30.0
MARGIN, COVERAGE, AGREED_SCORE, AGREED_COVERAGE, INTENT, INTENT_COSINE = 0.35, 0.20, 0.045, 0.34, 2, 0.4
START_WORDS, START_ADDS = ["start", "starts", "started", "starting", "launch", "launched"], ["startup", "launch"]
HIDE_WORDS, HIDE_CUES, HIDE_ADDS = ["background", "hidden", "terminal", "window", "windowless"], ["background", "hidden", "no", "not", "terminal", "without", "windowless"], ["background", "hidden", "windowless"]


def fuse(producers: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """One row per (query_id, id) with rrf, ranks and signals by producer.

    Each producer has query_id, id, rank, score, and one vote an id: its best rank; the signal is
    its best score.
    """
    rows = None
    for name, df in producers.items():
        one = df.select("query_id", "id", F.lit(name).alias("producer"), "rank", "score")
        rows = one if rows is None else rows.unionByName(one)
    votes = rows.groupBy("query_id", "id", "producer").agg(F.min("rank").alias("rank"), F.max("score").alias("signal"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("producer", c))))
    return votes.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), entries("rank").alias("ranks"), entries("signal").alias("signals"))


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def intent_words(tokens: Column) -> Column:
    """Words that the query's intent adds, other than its own."""
    start = F.when(F.arrays_overlap(tokens, literals(START_WORDS)), literals(START_ADDS)).otherwise(F.array().cast("array<string>"))
    hide = F.when(F.arrays_overlap(tokens, literals(HIDE_WORDS)) & F.arrays_overlap(tokens, literals(HIDE_CUES)), literals(HIDE_ADDS)).otherwise(F.array().cast("array<string>"))
    return F.array_except(F.array_union(start, hide), tokens)


def freshness(updated: Column, now: Column, cap: float = FRESH, half_life: Column | float = HALF_LIFE) -> Column:
    """cap halved with every half-life of age; null for an unreadable date, no more than cap for a future one."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(updated)) / F.lit(86_400e6))
    half = F.lit(half_life) if isinstance(half_life, float) else half_life
    return F.lit(cap) * F.pow(F.lit(0.5), days / half)


def rerank(fused: DataFrame, limit: int) -> DataFrame:
    """Add bounded bonuses and keep the first rows of each query.

    fused: as fuse() gives, with query, now, memory_id, path, title, heading, text, updated,
    review_after. Returns it with score, reasons, coverage, intent_overlap and rank.
    """
    q = F.lower("query")
    searchable = F.lower(F.concat_ws(" ", "memory_id", "path", "title", "heading", "text"))
    title = F.lower("title")
    found = F.filter(F.transform(identifiers(F.col("query")), F.lower), lambda i: F.contains(F.col("__s"), i))
    h = fused.withColumn("__s", searchable).withColumn("__ids", found).withColumn("__q", F.array_distinct(query_tokens(F.col("query"))))
    has_id = F.size("__ids") > 0
    prominent = F.exists("__ids", lambda i: F.contains(title, i) | F.contains(F.lower("path"), i))
    phrase = (F.length("query") >= 4) & F.contains(F.col("__s"), q)
    overlap = F.size(F.array_intersect("__q", query_tokens(title)))
    agree = F.map_contains_key("ranks", "lexical") & F.map_contains_key("ranks", "semantic")
    content = content_tokens(F.col("query"))
    coverage = F.when(F.size(content) > 0, F.size(F.array_intersect(content, query_tokens(F.col("__s")))) / F.size(content)).otherwise(0.0)
    intent = F.size(F.array_intersect(intent_words(F.col("__q")), query_tokens(F.col("title"))))
    semantic = F.coalesce(F.element_at("signals", "semantic"), F.lit(0.0))
    fresh = freshness(F.try_to_timestamp("updated"), F.col("now"))
    overdue = F.coalesce(F.try_to_timestamp("review_after") < F.col("now"), F.lit(False))
    h = h.withColumn("coverage", coverage).withColumn("intent_overlap", intent).withColumn("fresh", fresh)
    cond = lambda c, v: F.when(c, v).otherwise(0.0)
    score = (
        F.col("rrf") + cond(has_id, 0.12) + cond(has_id & prominent, 0.08) + cond(phrase, 0.08) + F.least(F.lit(0.06), overlap * 0.015) + cond(agree, 0.025)
        + F.least(F.lit(0.05), semantic * 0.08) + F.least(F.lit(0.06), F.col("coverage") * 0.09) + F.least(F.lit(0.08), F.col("intent_overlap") * 0.04)
        + F.coalesce("fresh", F.lit(0.0)) - cond(overdue, OVERDUE)
    )
    reasons = F.array_compact(
        F.array(
            F.when(has_id, F.concat(F.lit("exact identifier: "), F.array_join("__ids", ", "))), F.when(has_id & prominent, F.lit("identifier in title or path")), F.when(phrase, F.lit("exact phrase")),
            F.when(overlap > 0, F.lit("title match")), F.when(agree, F.lit("lexical-semantic agreement")), F.when(F.map_contains_key("ranks", "graph"), F.lit("relationship signal")),
            F.when(F.col("fresh") > 0.02, F.lit("recently updated")), F.when(overdue, F.lit("review overdue")),
        )
    )
    h = h.withColumn("score", score).withColumn("reasons", reasons).drop("__s", "__ids", "__q")
    return top(h, [F.desc("score"), F.asc("best_rank"), F.desc(F.lower("title")), F.asc("id")], limit)


def answer_gate(ranked: DataFrame) -> DataFrame:
    """query_id, answered: whether the first row has exact, intent, semantic or corroborated evidence.

    A semantic lead counts only with a clear margin over the other rows and some shared words.
    """
    semantic = F.coalesce(F.element_at("signals", "semantic"), F.lit(0.0))
    w = W.partitionBy("query_id")
    r = ranked.withColumn("__sem", semantic).withColumn("__next", F.max(F.when(F.col("rank") > 1, F.col("__sem"))).over(w)).where("rank = 1")
    margin = F.when(F.col("__sem") > 0, (F.col("__sem") - F.coalesce("__next", F.lit(0.0))) / F.col("__sem")).otherwise(0.0)
    exact = F.exists("reasons", lambda x: x.startswith("exact identifier") | x.startswith("exact phrase"))
    agree = F.map_contains_key("ranks", "lexical") & F.map_contains_key("ranks", "semantic")
    answered = exact | ((F.col("intent_overlap") >= INTENT) & (F.col("__sem") >= INTENT_COSINE)) | ((margin >= MARGIN) & (F.col("coverage") >= COVERAGE)) | (agree & (F.col("score") >= AGREED_SCORE) & (F.col("coverage") >= AGREED_COVERAGE))
    return r.select("query_id", answered.alias("answered"), margin.alias("margin"))


def raw_reason(query: Column, external_id: Column, artifact: Column, uri: Column, title: Column, text: Column) -> Column:
    """'exact identifier' if the whole query names the record, 'exact phrase' if a quoted phrase occurs, else null."""
    wanted = F.lower(F.btrim(F.trim(query), F.lit('"')))
    named = (wanted != "") & ((wanted == F.lower(external_id)) | (wanted == F.lower(artifact)) | (wanted == F.lower(uri)))
    body = F.lower(F.concat(title, F.lit("\n"), text))
    return F.when(named, "exact identifier").when(F.exists(quoted_phrases(query), lambda p: F.contains(body, F.lower(p))), "exact phrase")


def raw_decay(entity: Column, occurred: Column, now: Column, exact: Column) -> Column:
    """Freshness of raw evidence: the whole cap when exact, else halved by the entity's half-life; null time: 0."""
    half = F.when(entity.isin(*RAW_HALF_LIFE), 90.0).otherwise(RAW_DEFAULT_HALF_LIFE)
    return F.coalesce(F.when(exact & occurred.isNotNull(), F.lit(FRESH)).otherwise(freshness(occurred, now, FRESH, half)), F.lit(0.0))


def merge_raw(distilled: DataFrame, gate: DataFrame, raw: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Fuse distilled and raw rankings; each keeps its own gate.

    distilled: query_id, id, title, score, rank. raw: query_id, query, now, producer ('artifact-fts'
    or 'artifact-vector'), uri, artifact_id, external_id, entity, title, text, occurred_at, score,
    rank (within its producer). Records of one URI add up their votes; the full-text row stands for
    both. Returns query_id, id, evidence ('distilled', 'raw', 'burst'), title, score, rank, answered.
    """
    d = distilled.select("query_id", F.col("id").cast("string").alias("id"), F.lit("distilled").alias("evidence"), "title", (F.col("score") + 1.0 / (k + F.col("rank"))).alias("score"), F.lit(None).cast("string").alias("reason"))
    vote_ = 1.0 / (k + F.col("rank")) + F.least(F.lit(0.04), F.col("score") * 0.04)
    first = F.struct(F.when(F.col("producer") == "artifact-fts", 0).otherwise(1).alias("o"), "rank")
    pick = lambda c: F.min_by(c, first).alias(c)
    r = raw.withColumn("__v", vote_).groupBy("query_id", "uri").agg(F.sum("__v").alias("__v"), *[pick(c) for c in ("query", "now", "producer", "artifact_id", "external_id", "entity", "title", "text", "occurred_at")])
    r = r.withColumn("reason", F.when(F.col("producer") == "artifact-fts", raw_reason(*map(F.col, ("query", "external_id", "artifact_id", "uri", "title", "text")))))
    bonus = F.when(F.col("reason").isNotNull(), 0.20).otherwise(0.0) + raw_decay(F.col("entity"), F.col("occurred_at"), F.col("now"), F.col("reason").isNotNull())
    r = r.select("query_id", F.col("uri").alias("id"), F.when(F.col("producer") == "artifact-fts", "raw").otherwise("burst").alias("evidence"), "title", (F.col("__v") + bonus).alias("score"), "reason")
    ranked = top(d.unionByName(r), [F.desc("score"), F.desc(F.col("evidence") == "distilled"), F.desc(F.lower("title")), F.asc("id")], limit)
    lead = ranked.where("rank = 1").join(gate.select("query_id", F.col("answered").alias("__g")), "query_id", "left")
    lead = lead.select("query_id", F.when(F.col("evidence") == "distilled", F.coalesce("__g", F.lit(False))).otherwise(F.col("reason").isNotNull()).alias("answered"))
    return ranked.join(lead, "query_id")
