import numpy as np
import pytest

from tidemark.llm import mil_quality as M
from tidemark.llm.words import text_blocks


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    per_text = np.array([1, 4, 2])
    x = rng.normal(size=(7, 5))
    label, importance = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    shapes = [(5, 3), (3,), (3, 2), (3, 2), (2,), (3,), (1,)]
    weights = [rng.normal(size=s) for s in shapes]

    def loss():
        p = M._forward(weights, x, per_text)["score"]
        return -(importance * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / importance.sum()

    found = M._gradients(weights, x, per_text, label, importance)
    for w, g in zip(weights, found):
        for i in np.ndindex(*w.shape):
            old = w[i]
            w[i] = old + 1e-6
            up = loss()
            w[i] = old - 1e-6
            down = loss()
            w[i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_passages_do_not_depend_on_the_block():
    import pyarrow as pa

    texts = ["a b c " * 50, None, "", "X!! Y", " \n ", "é 12 " * 70, "q " * 64]
    column = pa.array(texts)
    parts = [M.passages(d, o) for _, _, d, o in text_blocks(column, 1)]
    whole = [M.passages(d, o) for _, _, d, o in text_blocks(column)]
    assert np.allclose(np.concatenate([p[0] for p in parts]), whole[0][0])
    assert whole[0][1].tolist() == [3, 1, 1, 1, 1, 3, 1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = M.fit(docs, M.quality_labels(labels))
    scored = M.score_quality(docs, model).select("row.doc_id", "score").join(labels, "doc_id").where(M.held_out())
    rows = scored.collect()
    right = np.mean([(r["score"] >= M.THRESHOLD) == (r["quality"] == 1) for r in rows])
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert len(rows) > 50 and right > 0.93
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_awkward_rows_get_a_score_each(docs, rows, spark):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (4, 1), (10_000, 0)], "doc_id long, label int"
    )
    scored = M.score_quality(docs, M.fit(docs, labels))
    got = scored.select("row.*", "n_passages", F_score()).collect()
    assert len(got) == len(rows) and all(0 <= r["made"] <= 1 and r["score"] == "s" for r in got)
    of = {}
    for r in got:
        assert of.setdefault(r["text"], r["made"]) == pytest.approx(r["made"])


def F_score():
    from pyspark.sql import functions as F

    return F.col("score").alias("made")


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_without_two_labels_scores_are_the_share(docs, spark, labels, share):
    model = M.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    assert {r["score"] for r in M.score_quality(docs.select("doc_id", "text"), model).collect()} == {share}


def test_empty_table(empty, spark):
    model = M.fit(empty, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    assert M.score_quality(empty, model).collect() == []


def test_whole_bags_absent_labels_and_repeated_ids(spark):
    """Labels of no document take no place, a long document is learned from whole, and many rows of one id
    don't all come to the driver."""
    long = " ".join(f"word{k}" for k in range(64 * 300)) + " ### $$$ %%%" * 30
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(80))) for i in range(100)]
    rows += [(100 + i, " ".join(f"#w{i} $x{k}" for k in range(80))) for i in range(100)]
    rows += [(300, long)] + [(301, f"text {k} under one id") for k in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, 1) for i in range(100)] + [(100 + i, 0) for i in range(100)] + [(300, 0), (301, 1)]
    labels += [(1000 + i, i % 2) for i in range(20_000)]
    labelled = spark.createDataFrame(labels, "doc_id long, label int")
    seen = []

    def train(x, per_text, label, importance, seed=7):
        seen.append((per_text, label))
        return plain(x, per_text, label, importance, seed)

    plain, M.train = M.train, train
    try:
        model = M.fit(frame, labelled, max_per_label=60)
        M.fit(frame, labelled, max_per_label=400)
        M.fit(frame, labelled, max_per_label=400, max_passages=100)
    finally:
        M.train = plain
    assert model.weights
    assert all((label == y).sum() <= 60 for y in (0, 1) for label in [seen[0][1]])
    assert max(seen[1][0]) > 300 and seen[2][0].sum() <= 100
