"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r between 0 and 2. Among all rates that meet a source's word target,
sum(r * size) = target, those nearest to 1 in relative entropy are exponentially tilted:
r = min(2, exp(lambda * size / mean size)). The multiplier solves a convex dual in one variable a
source, by Newton steps kept inside a bracket. Rates depend only on (source, size), so the steps
run over counts by (source, size), all sources at once, and not over documents.

Rates become whole copies: the integer part always, one more for the documents with the lowest
keys (a hash of the id less the fractional part) as far as the target goes; more passes fill what
is left with documents that still fit. Where a cut lies is read off two levels of histograms
by source, so no source is ever sorted or gathered. Last, some documents of each source, all of
them if it has few, trade copies until the words taken come as close to the target as these
documents allow (a bounded subset sum).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Source weights by rank in code-point order, repeating, and the mix's size against the input's.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
STEPS, STEPS_A_CUT, BINS, PASSES = 60, 6, 2048, 5
#: Share of a target that passes may leave open.
NEAR = 0.002
#: Documents of a source that trade copies, words up to which their sums are exact, and moves that are broadcast.
POOL, EXACT, MOVES = 512, 1 << 21, 500_000
#: Relative misses of a target: one to stop at, and one that is an error if it is left.
TOLERANCE, ENOUGH = 1e-9, 1e-6
#: Bins of sources whose sums the driver gets at a time.
LEVELS = 1024
#: Sources whose figures are broadcast.
SOURCES = 50_000
#: Counts by (source, size) in a partition.
A_PARTITION = 200_000


def beside(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows left-joined to a table with a row a source (key s2, null included).

    Up to SOURCES sources, which is counted, that table is broadcast and no source's rows are
    moved; beyond that the join shuffles, and Spark splits a source that is large.
    """
    small = per_source.limit(SOURCES + 1).count() <= SOURCES
    return rows.join(F.broadcast(per_source) if small else per_source, F.expr("source <=> s2"), "left").drop("s2")


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes (a row a source) plus rank from 0, in code-point order with null last.

    Sources are range-partitioned and numbered within their partition; what precedes a partition
    is a count per partition.
    """
    rows = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()))
    counts, before, first = sorted((r["p"], r["count"]) for r in rows.groupBy("p").count().collect()), 0, []
    for p, n in counts:
        first += [F.lit(p), F.lit(before)]
        before += n
    within = F.row_number().over(W.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    return rows.withColumn("rank", within + (F.element_at(F.create_map(*first), F.col("p")) if first else 0)).drop("p")


def water_level(goals: DataFrame, share: float) -> float | None:
    """tau with sum(min(cap, tau * w)) = share * all words, from goals (cap, w, total); None if all fill up.

    Sources at a level cap / w below tau are full. The level is enclosed ever more closely by sums
    over at most LEVELS bins, until no source's level lies between the ends.
    """
    level = F.col("cap") / F.col("w")
    left, caps, lo, hi, weight = goals.agg(F.sum("total") * float(share), F.sum("cap"), F.min(level), F.max(level), F.sum("w")).first()
    if left is None or left >= caps:
        return None
    if left <= lo * weight:
        return left / weight
    while True:  # sources up to lo are full and taken off left and weight; none is known above hi
        full, w_full = goals.where(level <= lo).agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        inner = goals.where((level > lo) & (level <= hi))
        bins = F.least(F.lit(LEVELS - 1), F.floor((level - lo) / (hi - lo) * LEVELS))
        found = inner.groupBy(bins.alias("b")).agg(F.min(level).alias("least"), F.max(level).alias("most"), F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.count_distinct(level).alias("n")).orderBy("b").collect()
        for r in found:
            tau = (left - full) / (weight - w_full)
            if tau <= r["least"]:
                return tau
            after = (left - full - r["cap"]) / (weight - w_full - r["w"]) if weight > w_full + r["w"] else None
            if after is not None and after > r["most"]:  # all of this bin fill up
                full, w_full = full + r["cap"], w_full + r["w"]
            elif r["n"] == 1:
                return tau if tau <= r["most"] else after
            else:
                lo, hi = max(lo, float(np.nextafter(r["least"], -np.inf))), r["most"]
                break
        else:
            return (left - full) / (weight - w_full) if weight > w_full else None


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, total) to (source, total, target), one row a source.

    share times all words is dealt by weight; a target stops at most times its source's words and
    the excess is dealt anew by weight until none is above: target = min(most * total, tau * w).
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = cut(ranked(sizes).withColumn("w", w).withColumn("cap", F.col("total") * F.lit(float(most))))
    tau = water_level(t, share)
    return t.select("source", "total", (F.col("cap") if tau is None else F.least(F.col("cap"), F.lit(tau) * F.col("w"))).alias("target"))


def whole_sum(x: Column) -> Column:
    """The sum of x in billionths: the same in whatever order tasks add up."""
    return F.sum(x.cast("decimal(29,9)")).cast("double")


def multipliers(histogram: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(source, lam, mean) that solve the duals; histogram: (source, size, c), sizes above 0.

    A target of most * total, which only rates of most reach, has lam null.
    """
    counts = histogram.groupBy(F.col("source").alias("s2")).agg(F.sum("c").alias("docs"))
    state = goals.where("total > 0").join(counts, F.expr("source <=> s2")).withColumn("mean", F.expr("total / docs"))
    free = F.col("target") < F.col("total") * F.lit(most * (1 - 1e-12))
    start = F.when(free, F.log(F.col("target") / F.col("total")))
    state = cut(state.select("s2", "target", "mean", start.alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(1.0).alias("off")))
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean"))))
    full, state = state.where("lam is null"), state.where("lam is not null")
    for step in range(1, STEPS + 1):
        weight = F.col("c") * F.col("r") * F.col("size")
        s = histogram.join(state, F.expr("source <=> s2")).withColumn("r", rate).groupBy("source").agg(
            (whole_sum(weight) - F.first("target")).alias("miss"),
            whole_sum(F.when(F.col("r") < most, weight * F.col("size") / F.col("mean"))).alias("slope"),
            *[F.first(c).alias(c) for c in ("target", "mean", "lam", "lo", "hi")],
        )
        s = s.withColumn("lo", F.when(F.col("miss") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("miss") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("miss") / F.col("slope")
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        # outside the bracket: halve it, or double away from 0 while it is open
        half = F.when((F.col("lo") > -1e4) & (F.col("hi") < 1e4), (F.col("lo") + F.col("hi")) / 2).when(F.col("miss") > 0, -F.abs(F.col("lam")) * 2 - 0.1).otherwise(F.abs(F.col("lam")) * 2 + 0.1)
        lam = F.when(F.col("miss") == 0, F.col("lam")).when(inside, newton).otherwise(half)
        state = s.select(F.col("source").alias("s2"), "target", "mean", lam.alias("lam"), "lo", "hi", (F.abs("miss") / F.col("target")).alias("off"))
        if step % STEPS_A_CUT == 0:
            state = cut(state)
            off = state.agg(F.max("off")).first()[0] or 0.0
            if off < TOLERANCE:
                break
    else:
        if off > ENOUGH:
            raise RuntimeError(f"a source's rates miss its target by {off:.2g} after {STEPS} steps")
    return state.union(full).select(F.col("s2").alias("source"), "lam", "mean")


def threshold(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, b1, b2): documents below bin b1, or in it and below its inner bin b2, get one more copy.

    rows: (source, size, base, key), key in [0, 1), for those with a fractional part.
    """
    first = F.floor(F.col("key") * BINS).cast("int")
    second = F.floor((F.col("key") * BINS - first) * BINS).cast("int")
    binned = rows.withColumn("b1", first).withColumn("b2", second)
    one = binned.groupBy("source", "b1").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(W.partitionBy("source").orderBy("b1").rowsBetween(W.unboundedPreceding, 0))
    one = one.withColumn("run", run).join(goals, F.expr("source <=> s2"))
    at = one.where("run > gap").groupBy("source").agg(F.min("b1").alias("b1"), F.min(F.expr("run - words")).alias("below"), F.first("gap").alias("gap"))
    two = binned.withColumnRenamed("source", "s2").join(at.select("source", F.col("b1").alias("c1"), "below", "gap"), F.expr("s2 <=> source and b1 = c1"))
    two = two.groupBy("source", "b1", "b2").agg(F.sum("size").alias("words"), F.first("below").alias("below"), F.first("gap").alias("gap"))
    run = F.col("below") + F.sum("words").over(W.partitionBy("source").orderBy("b2").rowsBetween(W.unboundedPreceding, 0))
    return two.withColumn("run", run).groupBy("source").agg(F.first("b1").alias("t1"), F.max(F.when(F.expr("run <= gap"), F.col("b2"))).alias("t2"))


def row_key() -> Column:
    """A hash of a row's id, source and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def measured(*keep: Column) -> list[Column]:
    """keep, then source, size and row of a document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return [*keep, F.col("source").cast("string").alias("source"), size.alias("size"), row_key().alias("row")]


def rated(rows: DataFrame, per_source: DataFrame, most: float) -> DataFrame:
    """rows with rate, its whole part as copies, and what the cuts go by."""
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean")))))
    rows = beside(rows, per_source).withColumn("rate", rate)
    rows = rows.withColumn("base", F.floor("rate").cast("long")).withColumn("frac", F.col("rate") - F.col("base"))
    u = F.pmod(F.xxhash64(F.lit("copies"), "row"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.withColumn("key", (u - F.col("frac") + 1.0) / 2.0).withColumn("copies", F.col("base"))


def still_open() -> Column:
    return (F.col("copies") == F.col("base")) & (F.col("frac") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))


def topped_up(rows: DataFrame, gaps: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows after a pass: those that are open and lie below their source's cut get one more copy."""
    b1 = F.floor(F.col("key") * BINS).cast("int")
    b2 = F.floor((F.col("key") * BINS - b1) * BINS).cast("int")
    below = (b1 < F.col("t1")) | ((b1 == F.col("t1")) & (b2 <= F.coalesce(F.col("t2"), F.lit(-1))))
    # a source without a cut takes all that is open
    more = F.when(still_open() & F.coalesce(below, F.lit(True)), 1).otherwise(0)
    return beside(beside(rows, gaps), cuts).withColumn("copies", F.col("copies") + more).drop("t1", "t2", "gap")


def traded(weights: list[int], copies: list[int], least: list[int], most: list[int], aim: float) -> list[int]:
    """Copies between least and most with sum(copies * weights) as near to aim as these documents allow.

    All sums are found one document after another, each with the document that first reached it,
    until one meets the aim; so few documents change. Weights that would need more than EXACT sums
    are counted in larger units, and the result is taken only where it is nearer than before.
    """
    now = sum(w * c for w, c in zip(weights, copies))
    unit = -(-sum(w * m for w, m in zip(weights, most)) // EXACT) or 1
    small = [w // unit for w in weights]
    best = sum(w * c for w, c in zip(small, copies))
    goal = best + (aim - now) / unit
    by = np.full(sum(w * m for w, m in zip(small, most)) + 1, -1, np.int16)  # the document that first reached a sum, from 1
    by[best] = 0
    steps = [[d for d in range(lo - c, hi - c + 1) if d] for c, lo, hi in zip(copies, least, most)]
    for i, w in enumerate(small):
        if abs(best - goal) <= 0.5:
            break
        before = np.flatnonzero(by >= 0)
        for d in steps[i] if w else ():
            to = before + d * w
            to = to[by[to] < 0]
            by[to] = i + 1
            if len(to):
                near = int(to[np.abs(to - goal).argmin()])
                best = near if abs(near - goal) < abs(best - goal) else best
    out, at = list(copies), best
    while by[at] > 0:
        i = int(by[at]) - 1
        d = next(d for d in steps[i] if 0 <= at - d * small[i] < len(by) and 0 <= by[at - d * small[i]] <= i)
        out[i] += d
        at -= d * small[i]
    return out if abs(sum(w * c for w, c in zip(weights, out)) - aim) < abs(now - aim) else list(copies)


def trades(rows: DataFrame, most: float) -> DataFrame:
    """(s3, row3, trade): copies to add to all rows of a source with that hash.

    Only POOL documents of a source are weighed, those whose hashes come first; a source of no more
    documents is weighed whole. They first trade between a rate rounded down and up, and between
    none and most copies where that doesn't meet the target.
    """
    gaps = cut(rows.groupBy("source").agg((F.first("target") - F.sum(F.expr("copies * size"))).alias("gap"), F.count("*").alias("docs")).withColumnRenamed("source", "s2"))
    u = F.pmod(F.xxhash64(F.lit("trades"), "row"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    pool = beside(rows.where("size > 0"), gaps).where("abs(gap) > 0.5").withColumn("u", u).where(F.col("u") * F.col("docs") <= 2.0 * POOL)
    pool = pool.groupBy("source", "row").agg(F.count("*").alias("m"), F.max("size").alias("size"), F.max("copies").alias("copies"), F.max("base").alias("least"), F.max(F.ceil("rate")).alias("most"), F.first("u").alias("u"), F.first("gap").alias("gap"))
    pool = pool.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("u", "row"))).where(F.col("k") <= POOL)

    def trade(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        weights, copies = [int(a) * int(b) for a, b in zip(pdf["m"], pdf["size"])], [int(c) for c in pdf["copies"]]
        aim = sum(w * c for w, c in zip(weights, copies)) + float(pdf["gap"].iloc[0])
        new = traded(weights, copies, pdf["least"].astype(int).tolist(), pdf["most"].astype(int).tolist(), aim)
        if abs(sum(w * c for w, c in zip(weights, new)) - aim) > 0.5:
            new = traded(weights, new, [0] * len(new), [int(most)] * len(new), aim)
        moved = pdf.assign(trade=[b - a for a, b in zip(copies, new)])
        return moved.loc[moved["trade"] != 0, ["source", "row", "trade"]].rename(columns={"source": "s3", "row": "row3"})

    return pool.groupBy("source").applyInPandas(trade, "s3 string, row3 long, trade int")


def after_trades(rows: DataFrame, moves: DataFrame) -> DataFrame:
    small = moves.limit(MOVES + 1).count() <= MOVES
    rows = rows.join(F.broadcast(moves) if small else moves, F.expr("source <=> s3 and row = row3"), "left")
    return rows.withColumn("copies", F.col("copies") + F.coalesce("trade", F.lit(0))).drop("s3", "row3", "trade")


def _mixed(docs: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, DataFrame]], DataFrame]:
    """(documents with copies, figures by source, what each pass went by, trades)."""
    d = cut(docs.select(*measured(F.col("doc_id").cast("long").alias("doc_id"))))
    histogram = cut(d.groupBy("source", "size").agg(F.count("*").alias("c")))
    # as many partitions as its rows ask for: the steps over a small one then shuffle nothing
    histogram = histogram.coalesce(max(1, -(-histogram.count() // A_PARTITION)))
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("total"))
    goals = cut(targets(totals, weights, share, most))
    lams = cut(multipliers(histogram.where("size > 0"), goals, most))
    per_source = cut(goals.join(lams.withColumnRenamed("source", "s2"), F.expr("source <=> s2"), "left").drop("s2").withColumnRenamed("source", "s2"))
    out, passes, before = rated(d, per_source, most), [], None
    for step in range(PASSES):  # what a cut leaves open is filled with documents that still fit
        gaps = cut(out.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"), F.first("target").alias("goal")).withColumnRenamed("source", "s2"))
        worst, left = gaps.agg(F.max(F.try_divide("gap", "goal")), F.sum("gap")).first()
        if step and ((worst or 0.0) <= NEAR or left == before):
            break
        gaps, before = gaps.drop("goal"), left
        cuts = cut(threshold(beside(out, gaps).where(still_open()).select("source", "size", "base", "key"), gaps)).withColumnRenamed("source", "s2")
        passes.append((gaps, cuts))
        out = cut(topped_up(out, gaps, cuts))
    moves = cut(trades(out, most))
    return after_trades(out, moves), per_source, passes, moves


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, rate, copies, taken, row.

    size counts the runs of characters other than ASCII white space in the whole text (null: 0);
    source_size and target are its source's, a null source being one of its own, last in order.
    copies is 0, 1 or 2 and taken = copies * size. Documents of size 0 have rate and copies 1.
    row is row_key(): rows of equal id, source and text are treated alike, all others are rows of
    their own. Reruns agree.

    Each source's taken words come as near to its target as the documents weighed at the end allow
    (POOL of a source, or all): exactly, unless it has very few.
    """
    out, *_ = _mixed(docs, weights, share, most)
    return out.select("doc_id", "size", "source", F.col("total").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row")


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs, each row as often as mix_sources() says: none, once or twice.

    What decides is a row's own hash and figures by source, so texts are neither joined by row nor shuffled.
    """
    _, per_source, passes, moves = _mixed(docs, weights, share, most)
    rows = rated(docs.select(*measured(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))), per_source, most)
    for gaps, cuts in passes:
        rows = topped_up(rows, gaps, cuts)
    rows = after_trades(rows, moves)
    rows = rows.where("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
