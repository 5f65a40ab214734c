import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm.katz import K, Discount, katz_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, BEGIN = 0, 1  # not strings


def tokens(text):
    return [*(w.translate(LOWER) for w in WORD.findall(text or "")), END]


def ratios(counts):
    """Ratio of each count 1, 2, ... to what it is lowered to."""
    times = Counter(counts.values())
    n = [times[r] for r in range(1, K + 2)]
    for k in range(K, 1, -1):
        if min(n[: k + 1]) > 0 and (k + 1) * n[k] < n[0]:
            rest = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return lambda c: c * d[c - 1] if c <= len(d) else c
    return lambda c: c - 0.5


class Plain:
    """The same model on dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            made = tokens(t)
            self.words.update(made)
            self.pairs.update(zip([BEGIN, *made[:-1]], made))
        self.n = sum(self.words.values())
        self.follow = {}
        for (v, w), c in self.pairs.items():
            self.follow.setdefault(v, {})[w] = c
        self.low_words, self.low_pairs = ratios(self.words), ratios(self.pairs)

    def spread(self, counts, low):
        """Lowered probabilities and what is left."""
        total = sum(counts.values())
        lost = sum(c - low(c) for c in counts.values())
        if not any(low(c) != c for c in counts.values()):
            total, lost = total + 1, 1
        return {w: low(c) / total for w, c in counts.items()}, lost / total

    def word(self, w):
        if not self.n:
            return 1.0
        if not hasattr(self, "own"):
            self.own = self.spread(self.words, self.low_words)
        return self.own[0].get(w, self.own[1])

    def pair(self, v, w):
        if v not in self.follow:
            return self.word(w)
        seen, left = self.spread(self.follow[v], self.low_pairs)
        return seen[w] if w in seen else left / (1 - sum(map(self.word, seen))) * self.word(w)

    def score(self, text):
        made = tokens(text)
        return sum(math.log10(self.pair(v, w)) for v, w in zip([BEGIN, *made[:-1]], made))

    def base(self, text):
        return sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))) for w in tokens(text))


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


def check(made, rows):
    plain = Plain([t for i, t in rows if not held(i)])
    got = sorted(
        ((r["doc_id"] or -1, r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in made.collect())
    )
    want = sorted(
        (i or -1, len(tokens(t)), held(i), sum(w in plain.words for w in tokens(t)), plain.n, round(plain.base(t), 6), round(plain.score(t), 6))
        for i, t in rows
    )
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-5)
    return plain


@pytest.mark.parametrize(
    "limits", [{}, {"block_bytes": 2000, "words_per_bucket": 50, "pairs_per_bucket": 100}, {"context_tokens": 5, "block_bytes": 9000}]
)
def test_equals_plain(spark, docs, rows, limits):
    check(katz_scores(docs, **limits), rows)


def test_probabilities_add_up_to_one(rows):
    plain = Plain([t for i, t in rows if not held(i)])
    for v in [BEGIN, "word", "one", *list(plain.words)[:20]]:
        if v != END:
            assert sum(plain.pair(v, w) for w in plain.words) + plain.pair(v, "never met") == pytest.approx(1)


def test_good_turing_and_its_limits():
    assert Discount.of([100, 40, 20, 12, 8, 5]).ratios is not None
    assert Discount.of([0] * 6).ratios is None and Discount.of([1, 5, 9, 9, 9, 9]).ratios is None
    made = Discount.of([100, 40, 20, 0, 0, 0])
    assert len(made.ratios) == 2


def test_a_word_and_a_pair_in_a_third_of_all_tokens(spark):
    rows = [(i, "hot pair " * (i % 7 * 10) + f"w{i} w{i % 5}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(katz_scores(frame, block_bytes=3000), rows)


def test_nothing_to_learn_from(spark, empty):
    assert katz_scores(empty).collect() == []
    rows = [(None, "a b"), (None, None)]
    made = katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["score"], r["n_known"], r["train_tokens"]) for r in made] == [(0, 0, 0)] * 2
    assert sorted(r["base_score"] for r in made) == [0, 0, 0][:2]


def test_held_out_pairs_help(spark):
    rows = [(i, "the model learns that this sentence follows itself " * 3 + f"n{i % 9}") for i in range(300)]
    made = katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert made and all(r["score"] > r["base_score"] for r in made)
