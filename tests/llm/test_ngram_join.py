import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.components import components
from tidemark.llm.ngram_join import _pivots, ngram_jaccard_components


def shingles(text, size=5):
    words = bytes(text or "", "utf8")
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def expected(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * len(a & b) >= percent * len(a | b):
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)]


def got_of(frame, **options):
    found = ngram_jaccard_components(frame, **options).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str)


@pytest.mark.parametrize("keys_per_part", [300, 1_000_000])
def test_components_are_those_of_brute_force(docs, rows, keys_per_part):
    assert got_of(docs, chars_per_bucket=5_000, keys_per_part=keys_per_part) == sorted(expected(rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_near_copies(spark, seed):
    """Copies of copies, so that many pairs of a component are below the bound themselves."""
    rng = random.Random(seed)
    texts = []
    for _ in range(4):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(6, 60))]
        for _ in range(15):
            texts.append(" ".join(text))
            text = list(texts[rng.randrange(max(len(texts) - 6, 0), len(texts))].split(" "))
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_of(frame, keys_per_part=100) == sorted(expected(rows), key=str)
    assert len({c for _, _, c in expected(rows)}) < len(rows)


def test_a_block_tells_all_its_components():
    rng = np.random.default_rng(1)
    sets = [set(rng.integers(0, 12, 8).tolist()) for _ in range(60)]
    known = [i % 50 for i in range(60)]
    block = pa.table(
        {
            "class": list(range(60)),
            "component": known,
            "place": [0] * 60,
            "pivot": [True] * 60,
            "n": [len(s) for s in sets],
            "keys": pa.array([sorted(s) for s in sets], pa.list_(pa.int64())),
        }
    )

    def labels(links):
        label = list(range(60))
        for _ in range(60):
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        return label

    same = [(i, j) for i in range(60) for j in range(i) if known[i] == known[j]]
    linked = [
        (i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    # A common n-gram that comes first in all.
    block = block.set_column(4, "n", pa.array([len(s) + 1 for s in sets]))
    block = block.set_column(5, "keys", pa.array([[99, *sorted(s)] for s in sets], pa.list_(pa.int64())))
    sets = [s | {99} for s in sets]
    linked = [
        (i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    got = _pivots(block, 80)
    got = list(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in linked}
    assert labels(got + same) == labels(linked + same)


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(420)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(1000):
        before = dict(label)
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert got == label


def test_stars_need_no_step_and_hubs_are_out_of_them(spark, monkeypatch):
    from tidemark.llm import components as of

    sent, step = [], of._to_smallest
    monkeypatch.setattr(of, "_to_smallest", lambda links, large: sent.append(links.count()) or step(links, large))
    stars = [(10 * i + k, 10 * i) for i in range(20) for k in range(1, 10)]
    made = components(spark.createDataFrame(stars, "a long, b long"))
    assert sent == [] and {r["node"]: r["component"] for r in made.collect()} == {i: i // 10 * 10 for i in range(200)}
    hub = [(i, 0) for i in range(1, 500)] + [(2000, 499), (2000, 1999), (1999, 1998), (1000, -5), (1000, 0)]
    made = components(spark.createDataFrame(hub, "a long, b long"))
    want = {i: -5 for i in [*range(500), 1000, 1998, 1999, 2000, -5]}
    assert {r["node"]: r["component"] for r in made.collect()} == want
    assert sent and max(sent) < 10


def test_a_block_sends_links_between_components_to_the_smallest():
    from tidemark.llm.ngram_join import _stars

    keys = [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 4, 5, 6], [7, 8, 9], [7, 8, 9], [20, 21]]
    block = pa.table(
        {
            "class": [10, 11, 12, 13, 14, 15],
            "component": [10, 5, 12, 13, 4, 15],
            "place": [0] * 6,
            "pivot": [True] * 6,
            "n": [len(k) for k in keys],
            "keys": pa.array(keys, pa.list_(pa.int64())),
        }
    )
    made = _stars(block, 80)
    assert sorted(zip(made["a"].to_pylist(), made["b"].to_pylist())) == [(10, 5), (12, 5), (13, 4)]


def test_empty_tables(empty, spark):
    assert ngram_jaccard_components(empty).collect() == []
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_block_of_many_short_near_copies_is_cut(spark, monkeypatch):
    from tidemark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CLASSES_PER_PART", 10)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(40)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([*base[:6], *(f"y{i}z{k}" for k in range(20))])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_of(frame) == sorted(expected(rows), key=str)


def test_later_rounds_read_the_classes_of_cut_blocks_alone(spark, monkeypatch):
    from tidemark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CLASSES_PER_PART", 10)
    read, compared = [], ngram_join._compared
    monkeypatch.setattr(ngram_join, "_compared", lambda found, *x: read.append(found.count()) or compared(found, *x))
    base = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join([*base[:20], f"x{i}", *base[21:]])) for i in range(60)]
    for i in range(100):
        own = [f"y{i}z{k}" for k in range(30)]
        rows += [(1000 + 2 * i, " ".join(own)), (1001 + 2 * i, " ".join([*own, "more"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_of(frame) == sorted(expected(rows), key=str)
    assert read[0] == 260 and len(read) > 1 and set(read[1:]) == {60}


def test_places_are_sent_in_a_byte_or_two():
    from tidemark.llm.ngram_join import _pack_places, _unpack_places

    rng = np.random.default_rng(3)
    for size, most in ((0, 9), (1, 1), (500, 40), (500, 2_000), (500, 10**6)):
        places = np.sort(rng.integers(0, most, size))
        packed = _pack_places(places)
        assert _unpack_places(*packed).tolist() == places.tolist()
        assert most > 2_000 or sum(map(len, packed)) <= size


def test_sets_of_a_block_take_few_arrays():
    import tracemalloc

    from tidemark.llm.ngram_join import _by_bucket

    rng = random.Random(5)
    word = ["".join(rng.choices("abcdefgh", k=rng.randint(4, 9))) for _ in range(5_000)]
    texts = [" ".join(rng.choices(word, k=400)) for _ in range(1_300)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    tracemalloc.start()
    try:
        made = sum(b.num_rows for b in _by_bucket(iter([batch]), 5, 50))
        assert made and tracemalloc.get_traced_memory()[1] < 11 * batch.nbytes
    finally:
        tracemalloc.stop()
