import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm.packing import best_fit_decreasing, pack_documents, sequences
from tidemark.llm.token_ids import WordIds, public_path
from tidemark.llm.words import text_blocks


def direct(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path()).encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_decreasing_takes_the_tightest_window(lengths):
    window, offset = best_fit_decreasing(np.array(lengths, np.int64), 50)
    left, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [x for x in left if x >= lengths[i]]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else 50) - lengths[i])
        want[i] = 50 - left[-1] - lengths[i]
    assert [want[i] for i in range(len(lengths))] == offset.tolist()
    filled = defaultdict(list)
    for w, o, n in zip(window.tolist(), offset.tolist(), lengths):
        filled[w].append((o, n))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 50
    assert len(filled) == len(left)


@pytest.mark.parametrize("cache", [20, 100_000])
def test_word_cache_gives_the_library_s_ids(rows, cache):
    encoder = WordIds(public_path(), cache)
    texts = [t or "" for _, t in rows]
    texts += ["It's <|startoftext|>x <|STARTOFTEXT|> I'M 12ab'll ΑΣ ΟΔΟΣ é ́x Ǆ İ ...!? a b tail.\x1cx's 's"] * 2
    got = []
    for _, _, data, offs in text_blocks(pa.array(texts), 5_000):
        ids, bounds = encoder.encode(data, offs)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [direct(t) for t in texts]


def test_pieces_cover_documents_and_windows(docs, rows):
    packed = pack_documents(docs, length=64, with_ids=True, pieces_per_group=40).cache()
    got = packed.collect()
    want = sorted(zlib.crc32(np.array([*direct(t), 1], "<u4").tobytes()) for _, t in rows)
    whole, filled = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 256
        filled[r["sequence_id"]].append((r["offset"], r["length"], r["padded_length"]))
    once = {(r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in got}
    for doc_id, start, ids, n in once:
        whole[doc_id, n].append((start, ids))
    for parts in filled.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64 and {p for _, _, p in parts} == {at if at & (at - 1) == 0 else 64}
    assert len(got) == sum(-(-(len(direct(t)) + 1) // 64) for _, t in rows)
    joined = {zlib.crc32(b"".join(x for _, x in sorted(p))) for k, p in whole.items() if k[0] not in (None, 7)}
    assert joined <= set(want)
    kept = {r["sequence_id"]: r for r in sequences(packed).collect()}
    assert len(kept) == len(filled)
    for s, parts in filled.items():
        assert len(kept[s]["ids"]) == 4 * sum(n for _, n, _ in parts)


def test_little_padding(spark):
    frame = spark.createDataFrame([(i, "word " * (i % 300)) for i in range(3000)], "doc_id long, text string")
    got = pack_documents(frame, length=512)
    tokens = sum(r["length"] for r in got.collect())
    windows = got.select("sequence_id").distinct().count()
    assert tokens > 0.98 * 512 * windows


def test_empty_table(empty):
    assert pack_documents(empty).collect() == []


def test_the_cache_of_pieces_begins_anew_and_stays_right():
    import numpy as np

    from tidemark.llm.token_ids import Cache

    rng = np.random.default_rng(3)
    of = {int(k): np.arange(n, dtype="<u4").tobytes() for k, n in zip(rng.integers(0, 2**64, 90_000, np.uint64), rng.integers(0, 5, 90_000))}
    keys, cache = np.array(sorted(of), np.uint64), Cache(60_000)
    for _ in range(12):
        some = np.unique(rng.choice(keys, 30_000))
        cache.add({k: of[k] for k in some[cache.missing(some)].tolist()})
        assert not cache.missing(some).any()
        flat, begins, sizes = cache.ids(some)
        assert all(flat[b : b + n].tobytes() == of[k] for k, b, n in zip(some[:300].tolist(), begins, sizes))
        assert len(cache.keys) + len(cache.recent) <= 60_000 + 30_000
        cache.settle()
