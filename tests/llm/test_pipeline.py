"""Each stage of the pipeline against a plain version of it, on its own input."""

import re
from collections import Counter

import numpy as np
import pytest
from test_ngram_join import expected
from test_quality_rules import base

import corpus_pipeline as P
from tidemark.llm import mil_quality, quality_rules
from tidemark.llm.words import text_blocks

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def plain_score(model, text):
    """The forward pass of one document, passage by passage."""
    import pyarrow as pa

    ((_, _, data, offs),) = list(text_blocks(pa.array([text])))
    x, _ = mil_quality.passages(data, offs)
    if not model.weights:
        return model.share
    w1, b1, v, u, a, c, b = model.weights
    hidden = [np.tanh(((row - model.mean) / model.scale) @ w1 + b1) for row in x]
    gates = [float((np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ a) for h in hidden]
    share = np.exp(np.array(gates) - max(gates))
    bag = sum(h * s for h, s in zip(hidden, share / share.sum()))
    return float(1 / (1 + np.exp(-(bag @ c + b[0]))))


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Awkward rows and documents to learn from, as a folder of tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    good = [(5000 + i, " ".join(f"word{i}x{k}" for k in range(60 + i % 50))) for i in range(160)]
    bad = [(6000 + i, " ".join(f"#%& w{i}x{k} $" for k in range(60 + i % 50))) for i in range(160)]
    learn = spark.createDataFrame([(i, t, 1, "r", "s") for i, t in good + bad], "doc_id long, text string, words int, row string, score string")
    docs.select("doc_id", "text", "words", "row", "score").union(learn).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def given(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_classifier_keeps_what_a_plain_forward_pass_scores_high(spark, given, folder):
    labels = mil_quality.quality_labels(spark.read.parquet(f"{folder}/labels.parquet"))
    model = mil_quality.fit(given, labels)
    scores = {r["doc_id"]: plain_score(model, r["text"]) for r in given.where("doc_id >= 5000").collect()}
    made = {r["row"]["doc_id"]: r["score"] for r in mil_quality.score_quality(given, model).where("row.doc_id >= 5000").collect()}
    assert all(made[i] == pytest.approx(s, abs=1e-4) for i, s in scores.items()) and len(made) == 320
    want = [r for r in given.collect() if plain_score(model, r["text"]) >= mil_quality.THRESHOLD]
    assert rows_of(P.classify(spark, given, folder)) == sorted(map(tuple, want), key=repr)
    assert 0 < len(want) < given.count()


def test_rules_keep_what_the_plain_list_keeps(spark, given, folder):
    labels = quality_rules.quality_labels(spark.read.parquet(f"{folder}/labels.parquet"))
    rules = quality_rules.fit_rules(given, labels)
    assert rules
    stats = {r["text"]: r["stats"] for r in quality_rules.statistics(given).select("row.text", "stats").collect()}

    def kept(text):
        n, _, _, _, again = base(text)
        if n < 50 or 100 * again > 50 * n:
            return False
        return not any(all((stats[text][c.feature] > c.threshold) == c.above for c in rule) for rule in rules)

    want = [r for r in given.collect() if kept(r["text"])]
    assert rows_of(P.apply_rules(spark, given, folder)) == sorted(map(tuple, want), key=repr)
    # It learns from the folder's documents, whatever is left of them.
    left = given.where("doc_id < 6000")
    assert rows_of(P.apply_rules(spark, left, folder)) == sorted((tuple(r) for r in want if r["doc_id"] and r["doc_id"] < 6000), key=repr)


def test_one_row_of_each_group_of_near_copies_stays(spark, given, folder):
    before = given.collect()
    after = P.drop_near_copies(spark, given, folder).collect()
    of = {}
    for row, (i, n, component) in zip(before, expected([(r["doc_id"], r["text"]) for r in before])):
        of.setdefault((i, row["text"]), (component, n))
    left = Counter((r["doc_id"], r["text"]) for r in after)
    groups = {}
    for (i, text), (component, n) in of.items():
        if i is None:
            assert left[i, text] == sum(r["doc_id"] is None and r["text"] == text for r in before)
        elif n == 0:
            assert left[i, text] == 1
        else:
            groups.setdefault(component, []).append((i, text))
    # Rows without id are no one's copies; of each group one row, with the smallest id.
    for component, members in groups.items():
        kept = [m for m in members if left[m]]
        assert len(kept) == 1 and left[kept[0]] == 1 and kept[0][0] == component, (component, kept)


def test_near_copies_are_chosen_in_one_pass_of_python(spark, given, folder):
    """Two Python nodes in a task are two workers, which keep their memory; each also hashes all texts again."""
    plan = P.drop_near_copies(spark, given, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_second_text_under_a_kept_id(spark, folder):
    long = [f"w{k}" for k in range(100)]
    near = " ".join(["other", *long[1:]])
    rows = [(1, " ".join(long)), (2, "a b c d e f g"), (2, near), (3, near), (2, "a b c d e f g"), (2, "A b c  d e f g")]
    frame = spark.createDataFrame([(i, t, 1, "r", "s") for i, t in rows], "doc_id long, text string, words int, row string, score string")
    made = [(r["doc_id"], r["text"].split()[0].lower()) for r in P.drop_near_copies(spark, frame, folder).collect()]
    assert sorted(made) == [(1, "w0"), (2, "a")]


def test_passages_that_an_earlier_document_has_are_removed(spark, given, folder):
    before = [r for r in given.dropDuplicates(["doc_id"]).where("doc_id is not null").collect()]
    frame = spark.createDataFrame(before, given.schema)
    first = {}
    for r in before:
        words = WORD.findall(r["text"] or "")
        for i in range(len(words) - 12):
            window = tuple(words[i : i + 13])
            first[window] = min(first.get(window, r["doc_id"]), r["doc_id"])
    want = {}
    for r in before:
        words = WORD.findall(r["text"] or "")
        gone = {i + k for i in range(len(words) - 12) if first[tuple(words[i : i + 13])] < r["doc_id"] for k in range(13)}
        want[r["doc_id"]] = [w for i, w in enumerate(words) if i not in gone]
    made = {r["doc_id"]: r for r in P.remove_repeats(spark, frame, folder).collect()}
    assert {i: WORD.findall(r["text"] or "") for i, r in made.items()} == want
    assert all(len(want[r["doc_id"]]) != len(WORD.findall(r["text"] or "")) or made[r["doc_id"]]["text"] == r["text"] or not r["text"] for r in before)


def test_packing_places_every_id_once(spark, given, folder):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    frame = given.where("doc_id is not null and length(text) < 5000").dropDuplicates(["doc_id"])
    pieces = P.pack(spark, frame, folder).collect()
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in frame.collect()}
    assert {p["doc_id"] for p in pieces} == set(ids)
    for i, whole in ids.items():
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(p["length"] for p in own) == len(whole) == own[0]["doc_tokens"]
        for p in own:
            part = np.array(whole[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048


def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.collect()}
        kept = stage(spark, kept, SF)
        after = [r["doc_id"] for r in kept.collect()]
        assert kept.columns == docs.columns and len(set(after)) == len(after) and set(after) <= before
        assert [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in after) <= 2
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == set(after)


def test_stages_on_awkward_rows_and_none(spark, given, empty, folder):
    for name, stage in P.STAGES:
        assert stage(spark, empty.select(*given.columns), folder).collect() == []
        made = stage(spark, given, folder)
        assert made.collect() and (name == "packing" or made.columns == given.columns)
