"""Quality rules: base statistics of whole texts, and a decision list learned from labels.

Everything that touches documents is a Spark expression. Statistics of labelled documents, at most
``MAX_PER_LABEL`` of each label (of the ids that documents have, those with the smallest hash), come to the driver,
where sequential covering learns rules that reject: each rule grows by the condition with the
highest gain (FOIL), is pruned from its end on rows kept apart, and takes the rows it covers out
before the next rule is sought. The list goes back as one ordered conditional expression.

Rules: a null text has no words, lines or symbols, and fails the base. A statistic whose
denominator is zero is zero. Without labels of both kinds the list is empty, and the base alone
decides. Labels of a document that contradict each other, and null labels, are not learned from.
Repeated rows get one result each. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WINDOW = 3
MAX_PER_LABEL = 5_000
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVERED = 16, 4, 0.9, 8
THRESHOLDS = 64
FOLDS = 5

# The separators of words, and the symbols that count.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

FEATURES = (
    "n_words",
    "mean_word",
    "symbol_share",
    "upper_share",
    "digit_share",
    "mark_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
)


def _sorted_windows(size: int) -> Column:
    """Hashes of all windows of ``size`` words, each with its place in the low bits, in order."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - size),
        lambda i: F.call_function(
            "shiftleft", F.xxhash64(*(F.get("words", i + k) for k in range(size))), F.col("bits")
        ).bitwiseOR(i.cast("long")),
    )
    return F.when(F.col("n_words") >= size, F.sort_array(hashed))


def _same_window(a: Column, b: Column, size: int) -> Column:
    at = lambda x, k: F.get("words", x + k)
    return reduce(lambda x, y: x & y, [at(a, k) == at(b, k) for k in range(size)])


def statistics(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs``, as a struct) and ``stats``, a struct of counts and shares;
    narrow, without a shuffle."""
    text = F.coalesce("row.text", F.lit(""))
    # Windows with one hash head are neighbours; their words decide whether they are equal.
    place = lambda x: x.bitwiseAND(F.col("mask")).cast("int")
    head = lambda x: x.bitwiseAND(F.bitwise_not("mask"))

    def is_repeat(x: Column, i: Column) -> Column:
        def equal(y: Column) -> Column:
            return F.coalesce((head(x) == head(y)) & _same_window(place(x), place(y), WINDOW), F.lit(False))

        return equal(F.get("sorted", i - 1)) | equal(F.get("sorted", i + 1))

    numbered = F.transform("sorted", lambda x, i: F.when(is_repeat(x, i), place(x)))
    covered = F.flatten(
        F.transform(F.filter(numbered, lambda p: p.isNotNull()), lambda p: F.array(*(p + k for k in range(WINDOW))))
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    counted = (
        docs.select(F.struct(*docs.columns).alias("row"))
        .withColumn("words", F.filter(F.split(text, SPACE), lambda w: w != ""))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("bits", F.length(F.bin("n_words")))
        .withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)
        .withColumn("sorted", _sorted_windows(WINDOW))
        .withColumn("lines", lines)
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", left(SYMBOLS))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long"))
        .withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long")))
    )

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)).cast("double")

    n, chars = F.col("n_words"), F.col("word_chars")
    stats = F.struct(
        n,
        chars,
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share(chars, n).alias("mean_word"),
        share(F.col("n_symbols"), chars).alias("symbol_share"),
        share(left(r"[^\p{Lu}]+"), chars).alias("upper_share"),
        share(left(r"[^0-9]+"), chars).alias("digit_share"),
        share(left(r"[\p{L}0-9.,\x20\x09-\x0D]+"), chars).alias("mark_share"),
        share(F.col("n_dup_lines"), F.size("lines")).alias("dup_line_share"),
        share(F.col("n_repeat_words"), n).alias("repeat_share"),
        share(F.size(F.array_distinct("words")), n).alias("distinct_share"),
    )
    # Through a generator, which filters on statistics don't pass: moved below, they would compute
    # whole arrays again for every element.
    return counted.select("row", F.explode(F.array(stats)).alias("stats"))


def base_failed() -> Column:
    n, repeat = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"stats.{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, rows: np.ndarray) -> np.ndarray:
        value = rows[:, FEATURES.index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: np.ndarray) -> np.ndarray:
    return reduce(lambda a, c: a & c.holds(rows), rule, np.ones(len(rows), bool))


def _grow(rows: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition of highest gain until no good row is covered."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS and bad.any() and not bad.all():
        before, best = np.log2(bad.mean()), (1e-9, None)
        for f, feature in enumerate(FEATURES):
            value = rows[:, f]
            cuts = np.unique(np.quantile(value, np.linspace(0, 1, THRESHOLDS)))
            cuts = np.unique(np.concatenate(((cuts[1:] + cuts[:-1]) / 2, np.quantile(value[bad], [0.02, 0.05, 0.95, 0.98]))))
            for cut in cuts:
                for above in (True, False):
                    covered = value > cut if above else value <= cut
                    p, all_ = int((covered & bad).sum()), int(covered.sum())
                    if p:
                        gain = p * (np.log2(p / all_) - before)
                        if gain > best[0]:
                            best = (gain, Condition(feature, above, float(cut)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        covered = best[1].holds(rows)
        rows, bad = rows[covered], bad[covered]
    return rule


def _prune(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop conditions from the end while that is no worse on rows not grown from."""

    def worth(some: Rule) -> float:
        covered = _covers(some, rows)
        p = int((covered & bad).sum())
        n = int(covered.sum()) - p
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn_rules(rows: np.ndarray, bad: np.ndarray, importance: np.ndarray, seed: int = 5) -> list[Rule]:
    """Sequential covering of the rows labelled bad; ``importance`` weighs precision to the
    shares that the labels have outside the sample."""
    rng = np.random.default_rng(seed)
    grow = rng.random(len(rows)) < 2 / 3
    rules: list[Rule] = []
    left = np.ones(len(rows), bool)
    while len(rules) < MAX_RULES and (left & grow & bad).sum() >= MIN_COVERED:
        rule = _grow(rows[left & grow], bad[left & grow])
        rule = _prune(rule, rows[left & ~grow], bad[left & ~grow])
        if not rule:
            break
        covered = _covers(rule, rows) & left
        weight = importance[covered].sum()
        if (covered & bad).sum() < MIN_COVERED or importance[covered & bad].sum() < MIN_PRECISION * weight:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> list[Rule]:
    """A decision list from ``labels`` (doc_id, label: 1 good, 0 bad) of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    clean = (
        labels.where("doc_id is not null and label in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("label").cast("int").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
        # Labels of absent documents take no place in the sample and no part in its weights.
        .join(narrow.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    counts = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = (
        clean.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_label) for x in (1, 0)
    )
    # Broadcast: at most 2 * max_per_label narrow rows. An id may have many rows: at most so many of a label go on.
    rows = narrow.join(F.broadcast(good.union(bad)), "doc_id").dropDuplicates(["doc_id", "text"])
    order = [F.xxhash64("doc_id"), F.xxhash64("text")]
    some = [rows.where(F.col("label") == x).orderBy(*order).limit(max_per_label) for x in (1, 0)]
    met = statistics(some[0].union(some[1]))
    fields = [F.col(f"stats.{f}").cast("double").alias(f) for f in FEATURES]
    found = sorted(tuple(r) for r in met.where(~base_failed()).select("row.label", *fields).collect())
    if not found or len(counts) < 2:
        return []
    label = np.array([r[0] for r in found])
    importance = np.array([counts[int(y)] for y in label]) / max_per_label
    return learn_rules(np.array([r[1:] for r in found]), label == 0, np.maximum(importance, 1.0))


def fired_rule(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    made = F.lit(None).cast("string")
    for rule in reversed(rules):
        made = F.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(" and ".join(map(str, rule)))).otherwise(made)
    return made


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``row`` (the columns of ``docs``), ``stats``, ``base_failed``, ``rule`` (the one that rejects), ``kept``."""
    return (
        statistics(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(~F.col("base_failed"), fired_rule(rules)))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def quality_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the fold that accuracy is measured on."""
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != 0
    return labels.where(learn).select("doc_id", F.col("quality").alias("label"))
