import re
from collections import Counter
from itertools import permutations

import pytest

from tidemark.llm.filter_audit import filter_audit, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, bits string, part string, hash int, n int"


def plain(rows, labels):
    """Every order run on the documents one filter after the other."""
    made = []
    of = lambda i, at: i is not None and any(x[0] == i and x[at] == 1 for x in labels)
    has_label = lambda i: (of(i, 1), of(i, 2))
    for i, text, lang in rows:
        t = text or ""
        words = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        made.append((lang or "", fails, *has_label(i)))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {m[0] for m in made}:
            left, gone = [m for m in made if m[0] == part], []
            for step, f in enumerate(order, 1):
                removed = [m for m in left if f in m[1]]
                redundant = sum(f in m[1] for m in gone)
                left, gone = [m for m in left if f not in m[1]], gone + removed
                shapley[part, f] += len(removed)
                alone = sum(m[1] == {f} for m in made if m[0] == part)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, alone, sum(m[2] for m in removed), sum(m[3] for m in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def found(made):
    rows = made.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "b", "p", 1, 2) for r in rows], SCHEMA)
    return docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def given(rows):
    long = " ".join(f"word{k}" for k in range(300))
    texts = [*((i, t, ["en", "de", None, ""][(i or 0) % 4]) for i, t in rows)]
    texts += [(1000 + i, long + " #" * (i % 2), "en") for i in range(30)] + [(1000, long, "en"), (2000, long.upper(), "de")]
    ids = [t[0] for t in texts if t[0] is not None]
    labels = [(i, i % 2, i % 3 == 0) for i in ids[::2]] + [(ids[0], 1, 1), (ids[0], 0, None), (None, 1, 1), (99_999, 1, 1)]
    return texts, [(i, q, None if t is None else int(t)) for i, q, t in labels]


@pytest.mark.parametrize("rows_per_part", [None, 3])
def test_equals_running_every_order(spark, given, rows_per_part):
    texts, labels = given
    assert found(filter_audit(*frames(spark, texts, labels), rows_per_part)) == plain(texts, labels)


def test_no_documents_and_no_labels(spark, given):
    docs, labels = frames(spark, given[0], given[1])
    assert filter_audit(docs.limit(0), labels).collect() == []
    assert found(filter_audit(docs, labels.limit(0))) == plain(given[0], [])


def test_a_large_group_of_copies_goes_to_several_tasks(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text").selectExpr("*", "xxhash64(text) as hash")
    made = repeated(docs)
    assert {r[0] for r in made.select("doc_id").collect()} == set(range(3, 4000, 3))
    share = made.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(share) > 2 and max(r["count"] for r in share) < 1000
