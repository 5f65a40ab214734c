import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as R


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_base_statistics_are_those_of_brute_force(docs, rows, spark):
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [(900, "a b c a b c a b"), (901, "#a *b $ % & | < > ##\n#a\n#a\n \n \n"), (902, "u v u v u v w"), (903, "ï𝒳 ï𝒳 ï𝒳 ï𝒳")]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = R.statistics(frame).select("row.text", *(f"stats.{c}" for c in counts)).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        assert tuple(r[c] for c in counts) == base(r["text"]), r["text"]


def test_statistics_of_test_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in R.statistics(frame).select("row.text", "stats.*").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(r["text"])


def test_rows_keep_their_columns(docs, rows):
    got = R.apply_rules(docs, [(R.Condition("n_words", True, 100.0),)])
    assert got.select("row.*").columns == docs.columns
    for r in got.select("row.text", "row.stats", "base_failed", "rule", "kept", "stats.n_words").collect():
        n, repeat = base(r["text"])[0], base(r["text"])[4]
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert r["kept"] == (not r["base_failed"] and n <= 100)
        assert (r["rule"] == "n_words > 100") == (not r["base_failed"] and n > 100)


def test_learns_conjunctions_in_order():
    rng = np.random.default_rng(0)
    rows = rng.random((4000, len(R.FEATURES)))
    bad = (rows[:, 2] > 0.8) & (rows[:, 3] <= 0.4) | (rows[:, 5] > 0.95)
    rules = R.learn_rules(rows, bad, np.ones(len(rows)))
    found = np.any([R._covers(r, rows) for r in rules], axis=0)
    assert (found == bad).mean() > 0.98
    assert all(1 <= len(r) <= R.MAX_CONDITIONS for r in rules)
    assert R.learn_rules(rows, np.zeros(len(rows), bool), np.ones(len(rows))) == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = R.fit_rules(docs, R.quality_labels(labels))
    assert rules
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    rows = (
        R.apply_rules(docs, rules)
        .where(~F.col("base_failed"))
        .select("row.doc_id", "kept")
        .join(labels, "doc_id")
        .where(out)
        .collect()
    )
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.93
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.97


def test_no_python_in_the_plan(docs):
    plan = R.apply_rules(docs, [(R.Condition("n_words", True, 1.0),)])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


def test_empty_tables(empty, docs, spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert R.fit_rules(docs, none) == []
    assert R.fit_rules(empty, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")) == []
    assert R.apply_rules(empty, []).collect() == []


def test_labels_of_absent_documents_take_no_place_in_the_sample(spark):
    made = [(i, ("#%& " if i % 2 else "") + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(200)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as label")
    rules = R.fit_rules(frame, labels, max_per_label=100)
    assert rules
    assert {r[0] % 2 for r in R.apply_rules(frame, rules).where("kept").select("row.doc_id").collect()} == {0}
