import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.huffman import (
    Decoder,
    canonical_codes,
    code_lengths,
    encode_bits,
    read_token_ids,
    write_token_ids,
)
from tidemark.llm.token_ids import public_path


def optimal_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = heap[0] if len(heap) == 1 else 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60).filter(any))
def test_lengths_are_optimal_and_limited(counts):
    counts = np.array(counts)
    lengths = code_lengths(counts, 18)
    assert ((lengths > 0) == (counts > 0)).all()
    if counts.sum() < 2**16:
        assert (counts * lengths).sum() == optimal_cost(counts.tolist())
    short = code_lengths(counts, 6)
    assert short.max() <= 6 and (2.0 ** -short[short > 0].astype(float)).sum() <= 1


def test_length_limit_bites():
    counts = np.array([2**i for i in range(24)])
    lengths = code_lengths(counts, 8)
    assert lengths.max() == 8 and (2.0 ** -lengths.astype(float)).sum() <= 1
    codes = canonical_codes(lengths)
    text = [format(int(c), f"0{n}b") for c, n in zip(codes, lengths)]
    assert not any(a != b and b.startswith(a) for a in text for b in text)
    with pytest.raises(ValueError):
        code_lengths(np.ones(9), 3)


@settings(deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.sampled_from([1, 7, 64]))
def test_streams_come_back(ids, block):
    ids = np.array(ids, np.uint32)
    lengths = code_lengths(np.bincount(ids, minlength=41) if len(ids) else np.ones(41), 10)
    stream, marks = encode_bits(ids, canonical_codes(lengths), lengths, block)
    assert Decoder(lengths).decode(stream, marks, len(ids), block).tolist() == ids.tolist()
    for i, mark in enumerate(marks):
        part = ids[i * block : (i + 1) * block]
        assert Decoder(lengths).decode(stream, np.array([mark]), len(part), block).tolist() == part.tolist()


@pytest.mark.parametrize("ids_per_file", [50, 1_000_000])
def test_files_give_the_library_s_ids(docs, rows, tmp_path, ids_per_file):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_path())
    manifest = write_token_ids(docs, str(tmp_path / "ids"), ids_per_file=ids_per_file)
    got = sorted(read_token_ids(manifest, str(tmp_path / "ids"), with_ids=True).collect(), key=lambda r: r["start"])
    want = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((doc_id, len(ids) // 4, zlib.crc32(ids), ids))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_empty_table(empty, tmp_path):
    manifest = write_token_ids(empty, str(tmp_path / "ids"))
    assert read_token_ids(manifest, str(tmp_path / "ids")).collect() == []
