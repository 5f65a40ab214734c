import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.words import (
    Words,
    pack_gaps,
    pack_ints,
    pack_tail,
    text_blocks,
    unpack_gaps,
    unpack_ints,
    unpack_tail,
    window_hashes,
)

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x1cäZ", max_size=30)), max_size=12)


@settings(deadline=None, max_examples=200)
@given(TEXT, st.integers(1, 40))
def test_words_and_windows_are_those_of_each_text(texts, block_bytes):
    column = pa.array(["drop", *texts], pa.string()).slice(1)
    seen, hash_of = [], {}
    for first, end, data, offs in text_blocks(column, block_bytes):
        words = Words(data, offs)
        hashes = words.hashes()
        for i in range(end - first):
            a, b = words.bounds[i], words.bounds[i + 1]
            own = [data[s:e].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b])]
            seen.append(own)
            for word, h in zip(own, hashes[a:b].tolist()):
                assert hash_of.setdefault(word, h) == h
            for j, h in enumerate(window_hashes(hashes[a:b], 2, 1).tolist()):
                assert hash_of.setdefault((own[j], own[j + 1]), h) == h
    assert seen == [(t or "").encode().split() for t in texts]
    assert len(set(hash_of.values())) == len(hash_of)


def test_folding_touches_ascii_letters_only():
    data = np.frombuffer("aBÄ@[".encode(), np.uint8)
    assert Words(data, np.array([0, len(data)]), fold=True).data.tobytes() == "abÄ@[".encode()


@given(st.lists(st.integers(0, 2**62)))
def test_packed_integers_come_back(values):
    assert unpack_ints(pack_ints(np.array(values, np.int64))).tolist() == values
    ordered = np.array(sorted(values), np.int64)
    assert unpack_gaps(pack_gaps(ordered)).tolist() == ordered.tolist()
    keys = np.array(values, np.uint64)
    assert unpack_tail(pack_tail(keys, 7), 7).tolist() == [v % 2**56 for v in values]


@given(st.lists(st.integers(-(2**40), 2**40), unique=True))
def test_packed_gaps_may_begin_below_zero(values):
    ordered = np.array(sorted(values), np.int64)
    assert unpack_gaps(pack_gaps(ordered)).tolist() == ordered.tolist()
