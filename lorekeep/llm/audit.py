"""Filter interaction audit: what each of five filters removes in every order of all five.

A row's failures are a mask of five bits, built by built-in functions while the texts are scanned;
only the mask, the id, the part and the text's SHA-256 go on. Copies are counted by (text, part)
before the smallest id of a text is looked for, so a text held by a third of all rows is one row
for each part by then. What is left are at most 32 cells a part, from which the 120 orders follow:
what a filter removes depends only on which filters came before it, not on their order, so 80
(filter, set before it) pairs hold all 600 steps.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def bits(letters) -> int:
    return sum(bit(x) for x in letters)


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the four filters that look at one text; words: its words as an array."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT,
        capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        text.rlike(SYMBOLS),
    )
    return sum((F.when(f, bit(x)).otherwise(0) for f, x in zip(fails, FILTERS)), F.lit(0)).cast("int")


def label_flags(labels: DataFrame) -> DataFrame:
    """(label_id, good, toxic), one row an id: whether any of its rows says quality = 1, or toxic = 1."""
    flagged = labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
    any_of = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    return flagged.groupBy(F.col("doc_id").alias("label_id")).agg(*any_of)


def masked_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells (part, mask, n, good, toxic): rows of a part that fail exactly the filters of mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0).alias("words"))
    rows = read.select("doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("held"))
    # one row for each id, text and part: rows that repeat are counted before anything meets
    rows = rows.groupBy("doc_id", "part", "mask", "held").agg(F.count("*").alias("n"))
    rows = rows.join(label_flags(labels), F.expr("doc_id = label_id"), "left").na.fill(0, ["good", "toxic"])
    # null ids come last, behind every id, without a value that stands for them
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    copies = rows.groupBy("held", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(first.alias("first"), "n")).alias("least"))
    copies = copies.withColumn("first", F.min("least.first").over(W.partitionBy("held")))
    ahead = F.when(F.col("least.first") == F.col("first"), F.col("least.n")).otherwise(0)  # rows of the text's smallest id
    split = F.explode(F.array(F.struct(F.col("mask"), ahead.alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - ahead).alias("n"))))
    cells = copies.select("part", "good", "toxic", split.alias("c")).select("part", "c.mask", "c.n", "good", "toxic").where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic"))


def after_sets() -> list[tuple[str, int]]:
    """All (letter, bits of the filters applied before it)."""
    return [(x, bits(before)) for x in FILTERS for k in range(len(FILTERS)) for before in combinations(FILTERS.replace(x, ""), k)]


def orders() -> list[tuple[str, int, str, int]]:
    """All (filter_order, step, letter, bits before it)."""
    return [("".join(p), i + 1, x, bits(p[:i])) for p in permutations(FILTERS) for i, x in enumerate(p)]


def literal_rows(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step: what the step keeps and removes.

    A: under 50 words; B: under 65 % of the words distinct; C: over 5 % of the code points A-Z;
    D: holds one of #$%&*|; E: a smaller doc_id holds the same text, in any part. part is the
    source, '' where it is null. Null texts are empty (A only, and E from the second on). A null
    doc_id is larger than any other, and rows of one id aren't copies of each other. An id with
    several labels counts as good or toxic if one of them says so; a null label says nothing. No
    documents give no rows. More columns, under any name, are ignored.
    """
    n, good, toxic, mask, own, before = (F.col(c) for c in ("n", "good", "toxic", "mask", "own", "before"))
    cells = masked_counts(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))
    sets = literal_rows([(x, bit(x), b, factorial(b.bit_count()) * factorial(4 - b.bit_count())) for x, b in after_sets()], ("letter", "own", "before", "times"))
    each = cells.select("*", F.explode(sets).alias("s")).select(*cells.columns, "s.*")
    fails, clear = mask.bitwiseAND(own) > 0, mask.bitwiseAND(before) == 0
    sums = {
        "kept": (n, ~fails & clear),
        "removed": (n, fails & clear),
        "redundant": (n, fails & ~clear),
        "unique_fails": (n, mask == own),
        "good_lost": (good, fails & clear),
        "toxic_lost": (toxic, fails & clear),
    }
    found = each.groupBy("part", "letter", "before", "times").agg(*[F.sum(F.when(c, v).otherwise(0)).alias(k) for k, (v, c) in sums.items()])
    # each set before a filter stands at its step in so many of the 120 orders
    found = found.withColumn("shapley", F.sum(F.expr("removed * times")).over(W.partitionBy("part", "letter")))
    places = {(x, b): [(o, i) for o, i, y, c in orders() if (y, c) == (x, b)] for x, b in after_sets()}
    at = F.create_map(*[v for (x, b), rows in places.items() for v in (F.lit(f"{x}{b}"), literal_rows(rows, ("filter_order", "step")))])
    out = found.select("part", *COUNTS, "shapley", F.explode(at[F.concat("letter", F.col("before").cast("string"))]).alias("o"))
    return out.select("part", "o.filter_order", "o.step", *[F.col(c).cast("long").alias(c) for c in (*COUNTS, "shapley")])
