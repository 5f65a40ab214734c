import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.sentencepiece_scan import (
    _END,
    _START,
    Chunk,
    crc32_combine,
    max_plus,
    pieces,
    public_path,
    sentencepiece_digests,
)


def model():
    return pieces(public_path())


def chunks_of(text, size):
    normal, margin = model().normal(text), model().longest
    n = -(-len(normal) // size)
    return [
        Chunk(
            model(),
            normal[max(i * size - margin, 0) : i * size],
            normal[i * size : (i + 1) * size],
            normal[(i + 1) * size : (i + 1) * size + margin],
            i == 0,
            i == n - 1,
        )
        for i in range(n)
    ]


def scanned(text, size):
    """Ids by matrices, product by product, and each chunk for itself."""
    chunks = chunks_of(text, size)
    matrices = [c.matrix() for c in chunks]
    ids = []
    for i, chunk in enumerate(chunks):
        left, right = np.zeros((1, 1)), np.zeros((1, 1))
        for m in matrices[:i]:
            left = max_plus(left, m)
        for m in reversed(matrices[i + 1 :]):
            right = max_plus(m, right)
        total = left.T + matrices[i] + right.T
        assert np.isfinite(total).sum() == 1
        a, b = np.unravel_index(total.argmax(), total.shape)
        ids += [x for t in chunk.between(chunk.entries[a], chunk.exits[b]) for x in t[2]]
    return ids


@settings(deadline=None, max_examples=150)
@given(
    st.one_of(
        st.text(alphabet="abeinrst ", min_size=1, max_size=200),
        st.text(alphabet="a .=-", min_size=1, max_size=200),
        st.text(min_size=1, max_size=120),
        st.text(alphabet="the ingtion\n漢字é", min_size=1, max_size=200),
    ),
    st.integers(32, 70),
)
def test_scan_gives_the_library_s_ids(text, size):
    assert scanned(text, size) == model().whole.encode(text)


def test_long_runs_and_windows_that_double():
    rng = random.Random(1)
    for text in ("a" * 3000, "=" * 2500, " " * 900, "ab" * 900, "".join(rng.choices("ethanior", k=4000))):
        assert scanned(text, 300) == model().whole.encode(text)


@settings(deadline=None)
@given(st.lists(st.text(alphabet="ab \n▁\t\ré漢x", max_size=25), max_size=8))
def test_words_give_the_library_s_ids(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in model().encode(texts)]
    assert got == [model().whole.encode(t) for t in texts]


def test_max_plus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, -np.inf, rng.integers(0, 9, (4, 4))) for _ in range(3))
    assert (max_plus(max_plus(a, b), c) == max_plus(a, max_plus(b, c))).all()
    assert _START != _END


@given(st.binary(max_size=50), st.binary(max_size=500))
def test_checksums_combine(a, b):
    assert crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("giant, chunk, segment", [(60, 40, 3), (2_000, 700, 4), (10**6, 16_384, 64)])
def test_documents_whole_and_in_chunks(docs, rows, giant, chunk, segment):
    got = sentencepiece_digests(docs, giant_chars=giant, chunk_chars=chunk, segment_chunks=segment).collect()
    want = []
    for doc_id, text in rows:
        ids = np.array(model().whole.encode(text or ""), "<u4").tobytes()
        want.append((doc_id, len(ids) // 4, zlib.crc32(ids), True))
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert any(r["n_chunks"] > 1 for r in got) == (giant < 10**6)


def test_empty_table_and_small_chunks(empty, docs):
    assert sentencepiece_digests(empty).collect() == []
    with pytest.raises(ValueError):
        sentencepiece_digests(docs, chunk_chars=8)
