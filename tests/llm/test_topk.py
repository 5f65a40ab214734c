import math
import random

import pytest

from tidemark.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, block int, v int"


def expected(rows, k, every):
    import numpy as np

    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    made = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        vector = min(v for i, v in usable if i == q)
        alike = [(i, v) for i, v in usable if i != q and len(v) == len(vector)]
        scored = [(-sum(a * b for a, b in zip(vector, v)), i) for i, v in alike]
        made += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return made


@pytest.mark.parametrize("block_rows, query_rows", [(16, 3), (8192, 512)])
def test_top_k_is_that_of_brute_force(spark, block_rows, query_rows):
    rng = random.Random(5)
    vector = lambda s=1.0: [s * rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, vector(rng.choice([0.01, 0.3, 1, 5]))) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]
    rows += [(300, [0.0] * 6), (310, [0.0] * 6), (-20, vector()), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(303, [math.nan] * 6), (304, [math.inf] * 6), (None, vector()), rows[5], rows[10], (305, [])]
    frame = spark.createDataFrame([(i, v, "s", 1, 2) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in top_k(frame, 5, 10, block_rows=block_rows, query_rows=query_rows).collect())
    assert got == expected(rows, 5, 10)


def test_each_width_is_searched_by_itself(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4 + 2 * (i >= 120))]) for i in range(300)]
    # A query in rows of two widths: its first row in component order counts.
    rows += [(50, [-9.0] + [0.5] * 5), (2, [9.0]), (200, [-8.0] * 4)]
    frame = spark.createDataFrame([(i, v, "s", 1, 2) for i, v in rows], SCHEMA)
    for block_rows in (16, 8192):
        got = sorted(tuple(r) for r in top_k(frame, 5, 50, block_rows=block_rows).collect())
        assert got == expected(rows, 5, 50)
        assert {r[0] for r in got} == {0, 50, 100, 150, 200, 250}


def test_rounds_end_when_no_block_is_left(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * (8 if i % 20 == 0 else 0.01) for _ in range(6)]) for i in range(600)]
    frame = spark.createDataFrame([(i, v, "s", 1, 2) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in top_k(frame, 2, 100, block_rows=20, query_rows=2).collect())
    assert got == expected(rows, 2, 100)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert top_k(frame).collect() == []
    frame = spark.createDataFrame([(1, [1.0], "s", 1, 2)], SCHEMA)
    assert top_k(frame).collect() == []
    frame = spark.createDataFrame([(0, [1.0], "s", 1, 2)], SCHEMA)
    assert top_k(frame).collect() == []
