"""Spelling variants: pairs of words one edit apart, by pivotal bigrams.

1. Words are counted over all texts, combined before the shuffle. Bigrams are ordered by the number of
   words that have them, rare first (their number is bounded by the square of the alphabet).
2. A word's *prefix* is its three rarest bigrams, with all others of the third one's rank. Of these a dynamic
   program chooses two *pivots*: disjoint, and of the least total count. One edit spoils one pivot at
   most; the other stands in the neighbour. If the word's third rank is not above the neighbour's, it is in the
   neighbour's prefix.
3. Words are indexed by their prefix bigrams. Where the edit is decides what else must agree (position
   limits): behind the second pivot, all up to it; before the first, all from it on; else one pivot with the text
   on its outer side, and some letters of the outer side of the other pivot. Each is one equality on a
   hash of (side, text, length, letters), so a join by key finds the candidates, and each pair is
   verified by edit distance. Keys that very many words share are cut into parts.
4. A word's form is its near word of largest count, if that is at least twice its own. Counts double
   along a chain of forms, so its end is found by a number of doubling joins known beforehand.

Two keys with one 64-bit hash only make a candidate more.

Rules: null or empty texts have no words. A null ``doc_id`` gives no spelling errors. Rows repeated
under one id count each. Words without near words have no form and are their own root. Texts may be of any
length. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import written

# Fixed values of the contract.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ERROR_EVERY = 97
MIN_LENGTH, MIN_COUNT, TIMES = 5, 3, 2

GRAM, PREFIX, PIVOTS = 2, 3, 2
# Letters of the far side that keys hold.
FAR = (0, 1, 2, 4)
ROWS_PER_PART = 20_000


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n``: lower-cased runs of letters, some with a letter left out as the contract says."""
    runs = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.explode(F.expr(f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{RUN}', 0)")).alias("run"),
    ).where(F.length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    left_out = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.pmod(h, F.lit(ERROR_EVERY)) == 0, left_out).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def choose_pivots(grams: list[tuple[int, int]], pivots: int = PIVOTS, size: int = GRAM) -> list[int]:
    """Positions of ``pivots`` disjoint grams of the least total count; ``grams`` are (position, count) by
    position. ``best[k]`` holds, after each gram, the cheapest choice of ``k`` grams up to it."""
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * pivots]
    for i, (at, count) in enumerate(grams):
        row = list(best[-1])
        # Choices that end before this gram begins.
        free = i
        while free and grams[free - 1][0] + size > at:
            free -= 1
        for k in range(1, pivots + 1):
            before = best[free][k - 1]
            if before is not None and (row[k] is None or before[0] + count < row[k][0]):
                row[k] = (before[0] + count, before[1] + [at])
        best.append(row)
    found = best[-1][pivots]
    assert found is not None
    return found[1]


def _prefixes(batches: Iterator[pa.RecordBatch], counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    for batch in batches:
        last, pivots, prefix = [], [], []
        for word in batch["word"].to_pylist():
            grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
            third = sorted(rank[g] for g in grams)[PREFIX - 1]
            places = [i for i, g in enumerate(grams) if rank[g] <= third]
            last.append(third)
            prefix.append(places)
            pivots.append(choose_pivots([(i, counts[grams[i]]) for i in places]))
        made = [batch["word"], pa.array(last, pa.int32()), pa.array(pivots, pa.list_(pa.int32())), pa.array(prefix, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(made, names=["word", "last", "pivots", "prefix"])


def _key(side: str, text: Column, length: Column, far: Column) -> Column:
    return F.xxhash64(F.lit(side), text, length, far)


def _widest(room: Column) -> Column:
    """The most far letters that ``room`` holds."""
    out = F.lit(FAR[0])
    for n in FAR[1:]:
        out = F.when(room >= n, n).otherwise(out)
    return out


def _keys(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that find a word, by its prefix, and keys that a word asks for, by its pivots."""
    word, size = F.col("word"), F.length("word")
    upto = lambda end: word.substr(F.lit(1), end)
    start = lambda at: word.substr(at + 1, size)
    tail = lambda n: word.substr(size - n + 1, n)

    at = F.col("at")
    places = words.select("word", "last", F.explode("prefix").alias("at")).select(
        "*", F.explode(F.lit(list(FAR))).alias("far")
    )
    far = F.col("far")
    left = F.when(size - at - GRAM >= far, _key("L", upto(at + GRAM), size, tail(far)))
    right = F.when(at >= far, _key("R", start(at), size, upto(far)))
    index = places.select("word", "last", F.explode(F.array(left, right)).alias("key")).where("key is not null")

    a, b, other = F.col("pivots")[0], F.col("pivots")[1], F.col("other")
    room_right, room_left = _widest(size - b - GRAM), _widest(a)
    ways = [
        _key("L", upto(b + GRAM), other, F.lit("")),
        _key("R", start(a), other, F.lit("")),
        _key("L", upto(a + GRAM), other, tail(room_right)),
        _key("R", start(b), other, upto(room_left)),
    ]
    lengths = words.select("word", "last", "pivots", F.explode(F.array(size - 1, size, size + 1)).alias("other"))
    asked = lengths.select("word", "last", F.explode(F.array_distinct(F.array(*ways))).alias("key"))
    return index, asked


def near_words(words: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Pairs (``word``, ``near``), both ways, of words (at least five letters, distinct) one edit apart."""
    gram = F.expr(f"transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM}))")
    # At most the square of the alphabet.
    grams = words.select(F.explode(gram).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    counts = {r["gram"]: r["n"] for r in grams}
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.select("word").repartition(partitions, "word")
    placed = written(
        dealt.mapInArrow(lambda x: _prefixes(x, counts), "word string, last int, pivots array<int>, prefix array<int>"),
        "prefixes",
    )
    index, asked = _keys(placed)
    sizes = index.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > rows_per_part)
    # Broadcast: a key for each rows_per_part index rows at most.
    large = F.broadcast(written(sizes.select("key", F.ceil(F.col("m") / rows_per_part).cast("int").alias("parts")), "large-keys"))
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(large, "key", "left").select(
        "key", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.col("word").alias("near"), F.col("last").alias("near_last")
    )
    asked = asked.join(large, "key", "left").select(
        "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "word", "last"
    )
    verified = (F.col("last") <= F.col("near_last")) & (F.levenshtein("word", "near", 1) == 1)
    found = asked.join(index, ["key", "part"]).where(verified).select("word", "near")
    return found.union(found.select("near", "word")).distinct()


def spelling_forms(counts: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Per word of ``counts`` (word, n): ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    words = written(counts, "words")
    pairs = near_words(words, rows_per_part)
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The largest count, then the smallest word: of negative counts and words the smallest.
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    met = pairs.join(other, "near").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = words.join(met, "word", "left")
    has = -F.col("best.minus") >= TIMES * F.col("n")
    formed = written(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has, F.col("best.near")).alias("form"),
            F.when(has, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    chain = math.ceil(math.log(most, TIMES)) + 1
    ends = formed.where("form is not null").select("word", F.col("form").alias("end"))
    for _ in range(math.ceil(math.log2(chain))):
        further = ends.select(F.col("word").alias("end"), F.col("end").alias("further"))
        ends = written(
            ends.join(further, "end", "left").select("word", F.coalesce("further", "end").alias("end")), "ends"
        )
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Forms of all words of ``docs``; see the module's head."""
    return spelling_forms(word_counts(docs), rows_per_part)
