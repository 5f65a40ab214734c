"""Packing of documents into sequences of fixed length, best fit decreasing.

Documents are tokenized where they are read. One longer than a sequence is first cut into full
windows, which need no search; what is left of each document, and each short document, is a piece
to fit. Only the pieces' descriptions are shuffled, dealt by hash into groups of bounded size,
and each group is packed by itself: pieces by falling length, each into the tightest open window
that takes it, found with a segment tree over remaining capacities. A group has thousands of
windows, of which only the last few stay far from full.

A sequence is padded to its full length, except one whose tokens are a power of two.

Rules: a null or empty text is the end id alone. Repeated rows are documents of their own. A null
``doc_id`` stays null. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import lean
from tidemark.llm.token_ids import public_path, word_ids
from tidemark.llm.words import text_blocks

LENGTH, END_ID = 2048, 1
PIECES_PER_GROUP = 20_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Windows:
    """Open windows by remaining capacity; a segment tree finds the least capacity that suffices."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.of: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        if not capacity:
            return
        self.of.setdefault(capacity, []).append(window)
        node = capacity + self.leaves
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with at least ``need`` left, and what it has left; it is closed."""
        counts, node = self.open, need + self.leaves
        while not counts[node]:
            # Up to the first ancestor whose right sibling may hold a larger capacity.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if counts[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.of[capacity].pop()
        while node:
            counts[node] -= 1
            node >>= 1
        return window, capacity


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece of at most ``capacity``."""
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    windows, made = Windows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = windows.take(need) if need < capacity else None
        if found is None:
            found, made = (made, capacity), made + 1
        window[i], offset[i] = found[0], capacity - found[1]
        windows.add(found[1] - need, found[0])
    return window, offset


def _pieces(
    batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    encoder, end = word_ids(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for first, last, data, offs in text_blocks(batch["text"]):
            (ids_of_block, bounds), rows = encoder.encode(data, offs), []
            for doc_id, a, b in zip(batch["doc_id"].slice(first, last - first).to_pylist(), bounds[:-1], bounds[1:]):
                ids = ids_of_block[a:b].tobytes() + end
                for start in range(0, len(ids), 4 * length):
                    piece = ids[start : start + 4 * length]
                    row = (doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    rows.append((*row, piece) if with_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names[: 6 if with_ids else 5]
            )


def _pack(group: pa.Table, length: int, groups: int) -> pa.Table:
    # A total order first, so that a repeated task packs the same.
    group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "doc_tokens", "ids_crc32")])
    window, offset = best_fit_decreasing(group["length"].to_numpy(), length)
    number = group["group"][0].as_py()
    filled = np.bincount(window, weights=group["length"].to_numpy()).astype(np.int64)[window]
    padded = np.where(filled & (filled - 1) == 0, filled, length)
    group = group.append_column("sequence_id", pa.array(window * groups + number))
    group = group.append_column("offset", pa.array(offset))
    return group.append_column("padded_length", pa.array(padded)).drop_columns(["group"])


def pack_documents(
    docs: DataFrame,
    length: int = LENGTH,
    end_id: int = END_ID,
    model_path: str | None = None,
    with_ids: bool = False,
    pieces_per_group: int = PIECES_PER_GROUP,
) -> DataFrame:
    """Per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``, ``padded_length`` (of the sequence), and ``ids`` (packed, 32 bits each) if asked."""
    path = model_path or public_path()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, chars = narrow.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    # No text has more tokens than bytes; what this says of the piece count is a bound, not an estimate.
    groups = max(1, math.ceil((rows + chars / length) / pieces_per_group))
    schema = _PIECES + (", ids binary" if with_ids else "")
    pieces = narrow.mapInArrow(lambda x: lean(_pieces(x, path, length, end_id, with_ids)), schema)
    dealt = pieces.withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long")
    )
    return dealt.groupBy("group").applyInArrow(
        lambda group: _pack(group, length, groups),
        schema + ", sequence_id long, offset long, padded_length long",
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id`` and ``ids``, pieces in order, without padding."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(
        F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["ids"]))).alias("ids"),
        F.first("padded_length").alias("padded_length"),
    )
