import hashlib

import pytest

from tidemark.llm.substring_dedup import substring_dedup


def expected(rows, size):
    first = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - size + 1):
            if doc_id is not None:
                key = tuple(words[i : i + size])
                first[key] = min(first.get(key, doc_id), doc_id)
    made = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - size + 1):
            if doc_id is not None and first[tuple(words[i : i + size])] < doc_id:
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(words) if i not in gone]
        made.append((doc_id, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), kept))
    return made


@pytest.mark.parametrize("size", [5, 13])
def test_removes_what_brute_force_removes(docs, rows, size):
    got = substring_dedup(docs, size=size, carry=("words", "row"), chars_per_bucket=5_000).collect()
    want = expected(rows, size)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got), key=key) == sorted(
        (w[:4] for w in want), key=key
    )
    texts = dict(zip([(w[0], w[3]) for w in want], [w[4] for w in want]))
    for r in got:
        assert (r["cleaned"] or "").encode().split() == texts[r["doc_id"], r["kept_sha256"]]
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))
        assert r["carried"]["row"] == "r"
    assert any(r["n_removed"] for r in got)


def test_untouched_texts_keep_their_white_space(spark):
    rows = [(1, "a b  c\n\nd"), (2, "x a b  c y\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["cleaned"] for r in substring_dedup(frame, size=3).collect()}
    assert got == {1: "a b  c\n\nd", 2: "x y\n"}


def test_empty_table(empty):
    assert substring_dedup(empty).collect() == []
