"""Filter interaction audit: what each order of filters removes, and what each filter alone is worth.

1. A document's failures are bits. Four come from its own text. The fifth is existential: a
   left-semi join on hash, exact text and smaller ``doc_id`` marks a document whose text an earlier one has.
   The inner side is one row a repeated text, its smallest id, combined before the shuffle.
2. The marked documents are united with all others as signed rows: a marked one leaves its bit combination (-1)
   and joins the one with the fifth bit (+1). Rows are summed by document, meet the labels, and are
   summed by part and bit combination: at most ``2 ** len(filters)`` rows a part.
3. Every order and step is read off these combinations: what falls at a step fails its filter and
   none before. A filter's Shapley sum is exact: of all orders of a document's ``k`` failures, one in ``k``
   has it first.

A text with more than ``rows / (2 * partitions)`` copies is salted: its copies go to several tasks, to each of
which the inner row is sent. There are at most twice as many such texts as shuffle partitions, so
their hashes are broadcast. Whole texts are shuffled once for the copies and once, combined, for the
inner side.

Rules: null text is empty, null lang the part ''. A null ``doc_id`` is no smaller than any and no id is smaller
than it; it meets no label. Rows repeated under one id are documents of their own, none with a smaller id than
the other. A document is good (toxic) if any label row of its id says 1. Without documents there are
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import written

# Fixed values of the contract: the filters, their conditions' words, and their limits.
FILTERS = "ABCDE"
_SPACES = r"[\x20\x09-\x0D]+"
_CAPITALS, _MARKS = "[^A-Z]+", r"[#$%&*|]"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: few words, few distinct words, many capitals, marks."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, _CAPITALS, ""))
    conditions = [
        n < MIN_WORDS,
        100 * distinct.cast("long") < MIN_DISTINCT_PERCENT * n.cast("long"),
        100 * capitals.cast("long") > MAX_CAPITALS_PERCENT * F.length(text).cast("long"),
        text.rlike(_MARKS),
    ]
    bits = F.lit(0)
    for i, failed in enumerate(conditions):
        bits = bits + F.when(failed, 1 << i).otherwise(0)
    return bits


def repeated(docs: DataFrame, rows_per_part: int | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, hash, ...) whose text a smaller ``doc_id`` has: a left-semi join.

    ``rows_per_part``: copies of a text that one task takes; by default half a partition's share of all rows."""
    if rows_per_part is None:
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows_per_part = max(docs.count() // (2 * partitions), 1)
    known = docs.where("doc_id is not null")
    firsts = written(
        known.groupBy("hash", "text")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .where("first < last")
        .withColumn("parts", F.ceil(F.col("n") / rows_per_part).cast("int")),
        "firsts",
    )
    # Texts may share a hash: the most parts any of them needs.
    hot = firsts.where("parts > 1").groupBy("hash").agg(F.max("parts").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part_of_hash")
    # Broadcast: at most rows / rows_per_part hashes.
    outer = known.join(F.broadcast(hot), "hash", "left").select(*docs.columns, part)
    inner = (
        firsts.drop("parts")
        .join(F.broadcast(hot), "hash", "left")
        .select("hash", "text", "first", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part_of_hash"))
    )
    a, b = outer.alias("a"), inner.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("hash", "part_of_hash", "text")]
    return a.join(b, [*same, F.col("a.doc_id") > F.col("b.first")], "left_semi").select(*docs.columns)


def combinations(docs: DataFrame, labels: DataFrame, rows_per_part: int | None = None) -> DataFrame:
    """Per ``part`` and ``bits`` (the failed filters): ``n`` documents, ``good`` and ``toxic`` ones among them."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        text.alias("text"),
        F.xxhash64(text).alias("hash"),
    )
    own = ("doc_id", "part", text_failures(F.col("text")).alias("bits"))
    every = base.select(*own, F.lit(1).alias("sign"))
    copy = F.lit(1 << (len(FILTERS) - 1))
    moved = repeated(base, rows_per_part).select(*own).select(
        "doc_id",
        "part",
        F.inline(
            F.array(
                F.struct(F.col("bits"), F.lit(-1).alias("sign")),
                F.struct((F.col("bits") + copy).alias("bits"), F.lit(1).alias("sign")),
            )
        ),
    )
    signed = every.union(moved).groupBy("doc_id", "part", "bits").agg(F.sum("sign").alias("n"))
    # No label counts as 0.
    of_doc = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    )
    met = signed.where("n <> 0").join(of_doc, "doc_id", "left")
    sums = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return met.groupBy("part", "bits").agg(F.sum("n").alias("n"), *sums)


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of filters and step, from the counts of bit combinations."""
    steps = [
        (o, s, sum(1 << filters.index(x) for x in o[: s - 1]), 1 << filters.index(o[s - 1]))
        for o in map("".join, permutations(filters))
        for s in range(1, len(filters) + 1)
    ]
    names = ("filter_order", "step", "before", "bit")
    lists = [F.lit(list(x)).alias(n) for x, n in zip(zip(*steps), names)]
    # A fixed number of rows for each combination: every order and step.
    rows = counts.select("*", F.inline(F.arrays_zip(*lists)))
    fails, earlier = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier
    of = lambda condition, n="n": F.sum(F.when(condition, F.col(n)).otherwise(0))
    share = F.lit(math.factorial(len(filters))) / F.bit_count("bits")
    return rows.groupBy("part", "filter_order", "step").agg(
        of(~fails & ~earlier).alias("kept"),
        of(removed).alias("removed"),
        of(fails & earlier).alias("redundant"),
        of(F.col("bits") == F.col("bit")).alias("unique_fails"),
        of(removed, "good").alias("good_lost"),
        of(removed, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(0)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, rows_per_part: int | None = None) -> DataFrame:
    """Per ``part``, ``filter_order`` and ``step``: see the module's head."""
    return orders(combinations(docs, labels, rows_per_part))
