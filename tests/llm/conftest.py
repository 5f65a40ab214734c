import random

import pytest

SCHEMA = "doc_id long, text string, words int, row string, score string, stats string, part int, cell int, bucket int"


def prose(rng: random.Random, n: int) -> str:
    made = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]
    return " ".join(made)


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward kind: nulls, empty and very long texts, ties, repeated rows,
    near copies, shared passages, and columns whose names operators use themselves."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(40)]
    passage = prose(rng, 30)
    texts += [f"{prose(rng, 20)} {passage}\n{prose(rng, 15)}" for _ in range(6)]
    base = prose(rng, 200).split(" ")
    for _ in range(12):
        near = list(base)
        near[rng.randrange(200)] = "other"
        texts.append(" ".join(near))
    texts += [" ".join(base), " ".join(base).upper(), texts[0], texts[0], texts[0], "one two", "one two", "x"]
    texts += [None, "", " \t\n ", "word " * 400, "ä ö ü　ß\u0085x \x1c y", "a\r\nb\r\nb\r\nc\x0bd\x0ce"]
    texts.append(" ".join(prose(rng, 1000) for _ in range(25)))
    texts.append("z" * 150_000)
    made = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(made)
    made += [(None, passage + " " + passage), (None, None), made[0], made[0], (7, "another text under the same id " + passage)]
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "r", "s", "t", 2, 3, 4) for i, t in rows], SCHEMA)
    return frame.repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
