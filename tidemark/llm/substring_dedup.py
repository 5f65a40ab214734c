"""Substring deduplication: remove the words of every window that an earlier document has too.

A window is ``size`` consecutive words of one document. Tasks hash every window (Rabin-Karp) and
send the hashes, packed by hash bucket, through one shuffle; a bucket finds for each hash the
smallest document and answers the windows of all later ones. Those answers meet the texts by
document, where overlapping windows merge into maximal removal intervals.

Of windows that repeat within the block of texts that a task hashes at a time, only the first of the
smallest document travels: the others are known to go. So a passage that a third of all documents
share is sent once a block, not once a document.

Two windows count as equal when 56 bits of their hash and the bucket agree. With some 2.6 million
windows a bucket, at any input size, one window in 3e10 is taken for a repeat by chance.

Rules: a null text has no words. A row with null ``doc_id`` is left whole and no other document
loses a word to it. Rows with one ``doc_id`` don't take words from each other. Documents shorter
than a window are left whole. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import buckets_for, lean
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

WINDOW = 13
CHARS_PER_BUCKET = 16_000_000
_KEY_SEED, _BUCKET_SEED, _KEY_BYTES = 11, 12, 7
_SENT = pa.schema(
    [
        ("bucket", pa.int32()),
        ("docs", pa.binary()),
        ("counts", pa.binary()),
        ("places", pa.binary()),
        ("keys", pa.binary()),
    ]
)
_FOUND = pa.schema([("doc_id", pa.int64()), ("window", pa.int64())])


def _by_bucket(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(batch["doc_id"].is_valid())
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        if np.any(ids[1:] < ids[:-1]):
            order = np.argsort(ids, kind="stable")
            batch, ids = batch.take(pa.array(order)), ids[order]
        for first, end, data, offs in text_blocks(batch["text"], 4 << 20):
            rows = list(_block_rows(ids[first:end], Words(data, offs), size, buckets))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*rows), _SENT)], schema=_SENT
                )


def _block_rows(ids: np.ndarray, words: Words, size: int, buckets: int) -> Iterator[tuple]:
    windows = np.maximum(words.counts - size + 1, 0)
    owner = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
    if not len(owner):
        return
    hashes, bounds = words.hashes(), words.bounds
    del words
    places = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = places + bounds[owner]
    places = places.astype(np.int32)
    bucket = (window_hashes(hashes, size, _BUCKET_SEED)[at] % np.uint64(buckets)).astype(np.int32)
    keys = window_hashes(hashes, size, _KEY_SEED)[at]
    del hashes, at

    # Stable by key, and places ascend by document: the first of a key is in the smallest document.
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    smallest = np.empty(len(order), np.int32)
    smallest[order] = owner[order[new]][np.cumsum(new) - 1]
    del order, new
    later = ids[owner] > ids[smallest]
    del smallest
    for known in (False, True):
        some = np.flatnonzero(later == known)
        some = some[np.argsort(bucket[some], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[some], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(some)]):
            part = some[a:b]
            docs, counts = np.unique(ids[owner[part]], return_counts=True)
            # The check of a window that is known to go; of the others, the key goes along.
            tails = pack_tail(keys[part], 4) if known else pack_tail(keys[part], _KEY_BYTES)
            sign = -1 - int(bucket[part[0]]) if known else int(bucket[part[0]])
            yield sign, pack_gaps(docs), pack_ints(counts), pack_ints(places[part]), tails


def _repeats(sent: pa.Table) -> pa.Table:
    """Document, place and check of each window that a smaller document has."""
    known = sent["bucket"][0].as_py() < 0
    docs = [np.repeat(unpack_gaps(d), unpack_ints(c)) for d, c in zip(sent["docs"].to_pylist(), sent["counts"].to_pylist())]
    docs = np.concatenate(docs)
    places = np.concatenate([unpack_ints(x) for x in sent["places"].to_pylist()])
    keys = np.concatenate([unpack_tail(x, 4 if known else _KEY_BYTES) for x in sent["keys"].to_pylist()])
    if not known:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        smallest = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = order[docs[order] > smallest]
        docs, places, keys = docs[later], places[later], keys[later]
    check = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return pa.table([pa.array(docs), pa.array((places << 32) | check)], schema=_FOUND)


def repeated_windows(docs: DataFrame, size: int = WINDOW, chars_per_bucket: int = CHARS_PER_BUCKET) -> DataFrame:
    """``doc_id`` and ``windows`` (place and check) of documents that share a window with an earlier one."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets_for(narrow, "text", chars_per_bucket)
    sent = narrow.mapInArrow(
        lambda batches: lean(_by_bucket(batches, size, buckets)),
        "bucket int, docs binary, counts binary, places binary, keys binary",
    )
    found = sent.groupBy("bucket").applyInArrow(_repeats, "doc_id long, window long")
    return found.groupBy("doc_id").agg(F.collect_list("window").alias("windows"))


def removed_words(words: Words, windows: np.ndarray, size: int) -> np.ndarray:
    """Which words of one text fall into its repeated windows."""
    n = len(words.starts)
    keys = window_hashes(words.hashes(), size, _KEY_SEED)
    places, check = windows >> 32, windows & 0xFFFFFFFF
    ours = places < len(keys)
    places, check = places[ours], check[ours]
    places = places[(keys[places] & np.uint64(0xFFFFFFFF)).astype(np.int64) == check]
    # A repeat of a window within the text goes with it.
    places = np.flatnonzero(np.isin(keys, keys[places]))
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + size, -1)
    return np.cumsum(cover)[:n] > 0


def _digests(batches: Iterator[pa.RecordBatch], size: int, texts: bool) -> Iterator[pa.RecordBatch]:
    # Parts of a batch, so that what is made of it need not lie beside all of it.
    parts = (b.slice(first, end - first) for b in batches for first, end, _, _ in text_blocks(b["text"], 4 << 20))
    for batch in parts:
        n_words, n_removed, digests, spans, cleaned = [], [], [], [], []
        windows = batch["windows"]
        for i, text in enumerate(batch["text"].cast(pa.large_binary())):
            raw = text.as_py()
            pieces = (raw or b"").split()
            gone, cuts, rest = 0, [], raw
            if windows[i].is_valid and pieces:
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                out = removed_words(words, windows[i].values.to_numpy(zero_copy_only=False), size)
                pieces = list(compress(pieces, ~out))
                gone = int(out.sum())
                edges = np.flatnonzero(np.diff(out, prepend=False, append=False))
                cuts = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                if texts and gone:
                    ends = [*words.starts, len(raw)]
                    keep, at = [], 0
                    for cut in cuts:
                        keep.append(raw[at : words.starts[cut["start"]]])
                        at = ends[cut["end"]]
                    rest = b"".join([*keep, raw[at:]])
            n_words.append(len(pieces) + gone)
            n_removed.append(gone)
            digests.append(hashlib.sha256(b" ".join(pieces)).hexdigest())
            spans.append(cuts)
            cleaned.append(rest)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = {
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
            "removed": pa.array(spans, span),
        }
        kept = [c for c in batch.schema.names if c not in ("text", "windows")]
        out = {c: batch[c] for c in kept} | columns
        if texts:
            out["cleaned"] = pa.array(cleaned, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict(out)


def substring_dedup(
    docs: DataFrame,
    size: int = WINDOW,
    texts: bool = True,
    carry: tuple[str, ...] = (),
    chars_per_bucket: int = CHARS_PER_BUCKET,
) -> DataFrame:
    """Per document: ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one space),
    ``removed`` (maximal intervals of word positions) and, with ``texts``, ``cleaned``: the text
    without those intervals, all else as it was. Columns named in ``carry`` come as struct ``carried``."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    joined = narrow.join(repeated_windows(docs, size, chars_per_bucket), "doc_id", "left")
    made = "n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    schema = joined.drop("text", "windows").schema
    for field in T.StructType.fromDDL(made + (", cleaned string" if texts else "")):
        schema = schema.add(field)
    return joined.mapInArrow(lambda batches: lean(_digests(batches, size, texts)), schema)
