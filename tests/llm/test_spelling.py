import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling
from tidemark.llm.spelling import choose_pivots, near_words, spelling_forms, spelling_variants, word_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts):
    out = {}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, counts[w], len(near[w]), counts.get(forms[w]))
    return out


def found(made):
    rows = made.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abé", k=rng.randint(4, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "abababab", "ÀÿÞþé", "Àÿþþé"]
    made = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=200))) for i in range(150)]
    made += [(None, "aaaaab aaaaab aaaaab Aaaaab"), (3, None), (4, ""), (5, "x " * 10), (6, "ABABA" * 30_000), (7, "abcde × fghij÷klmno 'abcde'")]
    return made + made[:2]


def test_equals_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in texts], "doc_id long, text string, word string, n int, key int")
    counts = plain_counts(texts)
    assert {r["word"]: r["n"] for r in word_counts(docs).collect()} == counts
    want = plain_forms(counts)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] and v[0] for v in want.values())
    assert found(spelling_variants(docs)) == want


def test_keys_of_many_words_are_cut(spark, texts):
    counts = plain_counts(texts)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling_forms(frame, rows_per_part=2)) == plain_forms(counts)


def test_every_kind_of_edit_at_every_place(spark):
    rng = random.Random(9)
    words = set()
    for _ in range(60):
        w = "".join(rng.choices("abcdeé", k=rng.randint(5, 10)))
        i = rng.randrange(len(w) + 1)
        words |= {w, w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :], w[:i] + w[i + 1 :]}
    words = {w for w in words if len(w) >= 5}
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
    made = [(r["word"], r["near"]) for r in near_words(frame).collect()]
    assert set(made) == want and len(made) == len(want)


def test_chains_of_forms(spark):
    chain = [("aaaaaaaa"[: k + 5] if k < 4 else "aaaaaaaa" + "b" * (k - 3), 3 * 2**k) for k in range(9)]
    made = found(spelling_forms(spark.createDataFrame(chain, "word string, n long")))
    assert {v[1] for v in made.values()} == {chain[-1][0]}


def test_empty(spark, empty):
    assert spelling_variants(empty).collect() == []


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.randint(3, 6)))
        grams = [(p, rng.randint(1, 9)) for p in places]
        cost = dict(grams)
        want = min(cost[a] + cost[b] for a in places for b in places if b - a >= 2)
        a, b = choose_pivots(grams)
        assert b - a >= 2 and cost[a] + cost[b] == want
