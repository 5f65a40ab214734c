"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

Results are the library's own for the model given, a BPE model with byte fallback. For BPE a token
sequence is the encoding of its text exactly if each two neighbours are the encoding of theirs. So
encoding is a best path: tokens are arcs, an arc may follow another if the pair encodes to itself
(score 0, else minus infinity), and the path that is left is the only one. That makes it a
max-plus product of chunk matrices:

* a cut between chunks is in the state (characters before, characters behind) of the token that
  covers the character before it;
* a chunk's matrix has, for each state at its left and its right cut, the tokens on the path between
  them, or minus infinity if there is none;
* matrices are multiplied within segments of chunks, vectors run over the segments' products from
  the left and from the right, and give each chunk its two states and the tokens before it;
* each chunk then gives its own ids.

A chunk's matrix needs no walk from every state: paths that share a token are the same from there
on, so the library encodes the inside once, and for each state the few characters around the cut
that it takes to meet that path; the window doubles until it does.

Shorter documents are encoded where they are read: no piece crosses a word's start, so each distinct
word is encoded once and kept in a bounded cache.

Decoding goes from ids to pieces; ``decoded`` says that it gave the text again.

Rules: a null or empty text has no ids. A null ``doc_id`` stays null. Repeated rows get one result each.
Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import spread, written

MODEL = "piece_bpe_32k.model"
GIANT_CHARS, CHUNK_CHARS, SEGMENT_CHUNKS = 50_000, 16_384, 64
CACHE_WORDS = 400_000
_SPACE = "▁"
_START, _END = (0, 0), (-1, 0)
_CUT_CHUNKS = 64
_CHUNK = "row long, chunk long, chunks long, before string, text string, behind string"
_WINDOW = 64
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("decoded", pa.bool_()),
        ("n_chunks", pa.int64()),
    ]
)


class Pieces:
    """The library's encoder without the leading space it adds, and the pieces' strings."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        # A later normalizer_spec (field 3) overrides: add_dummy_prefix (field 3) = false.
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        n = self.whole.get_piece_size()
        self.pieces = [self.whole.id_to_piece(i) for i in range(n)]
        is_byte = [self.whole.is_byte(i) for i in range(n)]
        special = [self.whole.is_control(i) or self.whole.is_unknown(i) for i in range(n)]
        self.raw = [bytes([int(p[1:-1], 16)]) if b else p.encode() for p, b in zip(self.pieces, is_byte)]
        self.spans = [0 if b else len(p) for p, b in zip(self.pieces, is_byte)]
        self.vocabulary = {p for p, b, s in zip(self.pieces, is_byte, special) if not b and not s}
        self.longest = max(map(len, self.vocabulary))
        # Words can be encoded alone only if no piece has a space or line end behind something else.
        self.by_word = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in self.vocabulary)
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {}

    @staticmethod
    def normal(text: str) -> str:
        """What the encoder sees of a text."""
        return (_SPACE + text.replace(" ", _SPACE)) if text else ""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32 bits."""
        split, fresh = [], set()
        for text in texts:
            if not text or not self.by_word or "  " in text or _SPACE in text or text[0] == " ":
                split.append(None)
                continue
            words = (_SPACE + text.replace(" ", " " + _SPACE).replace("\n", " \n ")).split(" ")
            split.append(words)
            fresh.update(words)
        fresh.difference_update(self.known)
        if len(self.known) + len(fresh) > self.cache_words:
            self.known.clear()
            fresh = {w for words in split if words for w in words}
        new = list(fresh)
        for word, ids in zip(new, self.bare.encode(new, num_threads=1)):
            self.known[word] = np.array(ids, "<u4").tobytes()
        get = self.known.__getitem__
        return [
            np.array(self.whole.encode(text), "<u4").tobytes() if words is None else b"".join(map(get, words))
            for text, words in zip(texts, split)
        ]

    def decode(self, ids: bytes) -> bytes:
        """The normal form of the text."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def path(self, normal: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of a bare normal text; the characters at which tokens begin, and the first id of each.
        The bytes of a character outside the vocabulary are one token."""
        ids = self.bare.encode(normal)
        begins, firsts, at, i = [], [], 0, 0
        while i < len(ids):
            begins.append(at)
            firsts.append(i)
            if self.spans[ids[i]]:
                at += self.spans[ids[i]]
                i += 1
            else:
                i += len(normal[at].encode())
                at += 1
        return ids, [*begins, at], [*firsts, len(ids)]

    def states(self, before: str, behind: str) -> list[tuple[int, int]]:
        """The tokens that may cover the character before a cut."""
        found = []
        for back in range(1, min(self.longest, len(before)) + 1):
            for on in range(min(self.longest - back, len(behind)) + 1):
                token = before[len(before) - back :] + behind[:on]
                if token in self.vocabulary or len(token) == 1:
                    found.append((back, on))
        return found


@functools.cache
def pieces(path: str) -> Pieces:
    """One encoder a Python worker."""
    return Pieces(path)


def public_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunk:
    """One chunk of a document's normal text, with what stands around it."""

    def __init__(self, model: Pieces, before: str, text: str, behind: str, first: bool, last: bool) -> None:
        self.model, self.first, self.last = model, first, last
        self.left, self.right = len(before), len(before) + len(text)
        self.all = before + text + behind
        self.entries = [_START] if first else model.states(before, text + behind)
        self.exits = [_END] if last else model.states(self.all[: self.right], behind)
        self.inside = self._tokens(self.left, self.right)

    def _tokens(self, a: int, b: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(begin, end, ids) of the tokens that the library gives all[a:b]."""
        ids, begins, firsts = self.model.path(self.all[a:b])
        return [
            (a + begins[i], a + begins[i + 1], tuple(ids[firsts[i] : firsts[i + 1]])) for i in range(len(firsts) - 1)
        ]

    def _span(self, state: tuple[int, int], cut: int) -> tuple[int, int]:
        return cut - state[0], cut + state[1]

    @functools.cached_property
    def _places(self) -> dict[tuple[int, int], int]:
        return {(a, b): i for i, (a, b, _) in enumerate(self.inside)}

    def _from(self, state: tuple[int, int]) -> tuple[list, int, bool] | None:
        """The tokens behind an entry state up to one of the inside path, that one's index, and
        whether that path has the state; None if the paths don't meet."""
        if state == _START:
            return [], 0, True
        a, b = self._span(state, self.left)
        size = _WINDOW
        while True:
            end = min(self.left + size, self.right)
            tokens = self._tokens(a, end)
            for i, token in enumerate(tokens):
                if token[:2] in self._places:
                    # The entry token itself belongs to the chunk before.
                    return tokens[1:i], self._places[token[:2]], tokens[0][:2] == (a, b)
            if end == self.right:
                return None
            size *= 2

    def _to(self, state: tuple[int, int]) -> tuple[list, int, bool] | None:
        """The tokens behind one of the inside path up to an exit state, and as above."""
        if state == _END:
            return [], len(self.inside) - 1, True
        a, b = self._span(state, self.right)
        size = _WINDOW
        while True:
            begin = max(self.right - size, self.left)
            tokens = self._tokens(begin, b)
            for i in range(len(tokens) - 1, -1, -1):
                if tokens[i][:2] in self._places:
                    return tokens[i + 1 :], self._places[tokens[i][:2]], tokens[-1][:2] == (a, b)
            if begin == self.left:
                return None
            size *= 2

    def _between(self, entry: tuple[int, int], exit_: tuple[int, int], into, out) -> list | None:
        if into and out and into[1] <= out[1] + 1:
            return into[0] + self.inside[into[1] : out[1] + 1] + out[0] if into[2] and out[2] else None
        # The path from one to the other need not touch the inside path: all of the chunk at once.
        a, b = self.left, self.right
        first = last = None
        if entry != _START:
            a, _ = first = self._span(entry, self.left)
        if exit_ != _END:
            _, b = last = self._span(exit_, self.right)
        tokens = self._tokens(a, b)
        if first is not None:
            if not tokens or tokens[0][:2] != first:
                return None
            if last == first:
                return []
            tokens = tokens[1:]
        if last is not None and (not tokens or tokens[-1][:2] != last):
            return None
        return tokens

    def between(self, entry: tuple[int, int], exit_: tuple[int, int]) -> list | None:
        """Tokens after the entry token up to the exit token; None if no path has both."""
        return self._between(entry, exit_, self._from(entry), self._to(exit_))

    def matrix(self) -> np.ndarray:
        """Numbers of tokens between each entry and each exit state."""
        into, out = [self._from(s) for s in self.entries], [self._to(s) for s in self.exits]
        score = np.full((len(self.entries), len(self.exits)), -np.inf)
        for i, (entry, left) in enumerate(zip(self.entries, into)):
            for j, (exit_, right) in enumerate(zip(self.exits, out)):
                if left and right and left[1] <= right[1] + 1:
                    if left[2] and right[2]:
                        score[i, j] = len(left[0]) + right[1] + 1 - left[1] + len(right[0])
                else:
                    tokens = self._between(entry, exit_, left, right)
                    score[i, j] = -np.inf if tokens is None else len(tokens)
        return score


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product in which plus takes the place of times, and the maximum that of plus."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings, one after the other, from theirs and the second's length."""

    def times(matrix: list[int], vector: int) -> int:
        total, i = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return total

    # The operator that appends a zero bit, squared as often as it takes.
    step = [0xEDB88320, *(1 << i for i in range(31))]
    bits = 8 * length
    while bits:
        if bits & 1:
            first = times(step, first)
        step, bits = [times(step, x) for x in step], bits >> 1
    return first ^ second


def _encode_whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        for i in range(0, len(batch), 256):
            some = batch.slice(i, 256)
            texts = [t or "" for t in some["text"].to_pylist()]
            ids = model.encode(texts)
            columns = [
                some["doc_id"],
                [len(x) // 4 for x in ids],
                [zlib.crc32(x) for x in ids],
                [model.decode(x) == model.normal(t).encode() for x, t in zip(ids, texts)],
                [1] * len(ids),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT
            )


def _chunk(model: Pieces, row: dict) -> Chunk:
    return Chunk(model, row["before"], row["text"], row["behind"], row["chunk"] == 0, row["chunk"] == row["chunks"] - 1)


def _states_bytes(states: list[tuple[int, int]]) -> bytes:
    return np.array(states, "<i4").tobytes()


def _states(raw: bytes) -> list[tuple[int, int]]:
    return [tuple(x) for x in np.frombuffer(raw, "<i4").reshape(-1, 2).tolist()]


def _score(row: dict) -> np.ndarray:
    return np.frombuffer(row["score"], "<f8").reshape(len(row["entry"]) // 8, len(row["exit"]) // 8)


def _matrices(batches: Iterator[pa.RecordBatch], path: str, segment: int) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        for row in batch.to_pylist():
            chunk = _chunk(model, row)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "row": row["row"],
                        "segment": row["chunk"] // segment,
                        "chunk": row["chunk"],
                        "chunks": row["chunks"],
                        "entry": _states_bytes(chunk.entries),
                        "exit": _states_bytes(chunk.exits),
                        "score": chunk.matrix().astype("<f8").tobytes(),
                    }
                ]
            )


def _in_order(rows: pa.Table, by: str = "chunk") -> list[dict]:
    return rows.sort_by(by).to_pylist()


def _segment_product(rows: pa.Table) -> pa.Table:
    ordered = _in_order(rows)
    product = functools.reduce(max_plus, map(_score, ordered))
    made = ordered[0] | {"exit": ordered[-1]["exit"], "score": product.astype("<f8").tobytes()}
    return pa.Table.from_pylist([made], schema=rows.schema)


def _ends(matrices: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[list, list]:
    """The vector at each matrix's left and right cut, from both ends of a chain."""
    lefts, rights = [left], [right]
    for m in matrices[:-1]:
        lefts.append(max_plus(lefts[-1][None, :], m)[0])
    for m in reversed(matrices[1:]):
        rights.append(max_plus(m, rights[-1][:, None])[:, 0])
    return lefts, rights[::-1]


def _segment_ends(products: pa.Table) -> pa.Table:
    ordered = _in_order(products)
    lefts, rights = _ends(list(map(_score, ordered)), np.zeros(1), np.zeros(1))
    return pa.Table.from_pylist(
        [
            {"row": r["row"], "segment": r["segment"], "left": a.tobytes(), "right": b.tobytes()}
            for r, a, b in zip(ordered, lefts, rights)
        ]
    )


def _choose(rows: pa.Table) -> pa.Table:
    """Of each chunk of a segment, the states on the best path and the tokens before."""
    ordered = _in_order(rows)
    matrices = list(map(_score, ordered))
    lefts, rights = _ends(matrices, np.frombuffer(ordered[0]["left"]), np.frombuffer(ordered[0]["right"]))
    made = []
    for row, m, left, right in zip(ordered, matrices, lefts, rights):
        total = left[:, None] + m + right[None, :]
        i, j = np.unravel_index(total.argmax(), total.shape)
        if total[i, j] == -np.inf:
            raise ValueError("no path through a document; the model is not one of this kind")
        entry, exit_ = _states(row["entry"])[i], _states(row["exit"])[j]
        made.append(
            {"row": row["row"], "chunk": row["chunk"], "tokens_before": int(left[i])}
            | {"entry_back": entry[0], "entry_on": entry[1], "exit_back": exit_[0], "exit_on": exit_[1]}
        )
    return pa.Table.from_pylist(made)


def _backtrace(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        for row in batch.to_pylist():
            chunk = _chunk(model, row)
            entry, exit_ = (row["entry_back"], row["entry_on"]), (row["exit_back"], row["exit_on"])
            tokens = chunk.between(entry, exit_)
            ids = np.array([i for t in tokens for i in t[2]], "<u4").tobytes()
            begin = chunk.left if entry == _START else chunk.left + entry[1]
            end = chunk.right if exit_ == _END else chunk.right + exit_[1]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "row": row["row"],
                        "chunk": row["chunk"],
                        "ids": ids,
                        "decoded": model.decode(ids) == chunk.all[begin:end].encode(),
                    }
                ],
                schema=pa.schema(
                    [("row", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary()), ("decoded", pa.bool_())]
                ),
            )


def _digest(rows: pa.Table) -> pa.Table:
    crc = 0
    for row in _in_order(rows):
        crc = crc32_combine(crc, row["crc"], row["bytes"])
    made = {
        "row": [rows["row"][0].as_py()],
        "ids_crc32": [crc],
    }
    return pa.table(made)


def _cut(batches: Iterator[pa.RecordBatch], chunk_chars: int, margin: int) -> Iterator[pa.RecordBatch]:
    """The chunks of each text with up to ``margin`` characters on both sides, in one pass over it:
    slicing a Python string costs its slice, wherever that lies."""
    for batch in batches:
        for row, text in zip(batch["row"], batch["text"]):
            normal = _SPACE + text.as_py().replace(" ", _SPACE)
            count = -(-len(normal) // chunk_chars)
            for first in range(0, count, _CUT_CHUNKS):
                begins = [i * chunk_chars for i in range(first, min(first + _CUT_CHUNKS, count))]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array([row.as_py()] * len(begins), pa.int64()),
                        "chunk": pa.array([b // chunk_chars for b in begins], pa.int64()),
                        "chunks": pa.array([count] * len(begins), pa.int64()),
                        "before": [normal[max(b - margin, 0) : b] for b in begins],
                        "text": [normal[b : b + chunk_chars] for b in begins],
                        "behind": [normal[b + chunk_chars : b + chunk_chars + margin] for b in begins],
                    }
                )


def encode_giants(
    giants: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, segment_chunks: int = SEGMENT_CHUNKS
) -> DataFrame:
    """``row``, ``chunk``, ``ids``, ``decoded`` of every chunk of ``giants`` (row, text), by the scan."""
    margin = pieces(path).longest
    if chunk_chars < 2 * margin:
        raise ValueError(f"a chunk must have {2 * margin} characters or more")
    chunks = written(
        giants.select("row", "text").mapInArrow(lambda x: _cut(x, chunk_chars, margin), _CHUNK), "chunks"
    )
    matrices = written(
        spread(chunks, "row", "chunk").mapInArrow(
            lambda x: _matrices(x, path, segment_chunks),
            "row long, segment long, chunk long, chunks long, entry binary, exit binary, score binary",
        ),
        "matrices",
    )
    products = matrices.groupBy("row", "segment").applyInArrow(_segment_product, matrices.schema)
    ends = products.groupBy("row").applyInArrow(
        _segment_ends, "row long, segment long, left binary, right binary"
    )
    chosen = (
        matrices.join(ends, ["row", "segment"])
        .groupBy("row", "segment")
        .applyInArrow(
            _choose,
            "row long, chunk long, tokens_before long, entry_back long, entry_on long, exit_back long, exit_on long",
        )
    )
    return chunks.join(chosen, ["row", "chunk"]).mapInArrow(
        lambda x: _backtrace(x, path), "row long, chunk long, ids binary, decoded boolean"
    )


def sentencepiece_digests(
    docs: DataFrame,
    model_path: str | None = None,
    giant_chars: int = GIANT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
    segment_chunks: int = SEGMENT_CHUNKS,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32 bits),
    ``decoded`` (the ids gave the text again), ``n_chunks``."""
    path = model_path or public_path()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    giant = F.coalesce(F.length("text") > giant_chars, F.lit(False))
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded boolean, n_chunks long"
    short = narrow.where(~giant).mapInArrow(lambda x: _encode_whole(x, path), schema)
    giants = written(narrow.where(giant).withColumn("row", F.monotonically_increasing_id()), "giants")
    encoded = encode_giants(giants.select("row", "text"), path, chunk_chars, segment_chunks)
    parts = written(
        encoded.select(
            "row", "chunk", F.crc32("ids").alias("crc"), F.octet_length("ids").cast("long").alias("bytes"), "decoded"
        ),
        "parts",
    )
    crcs = parts.groupBy("row").applyInArrow(_digest, "row long, ids_crc32 long")
    sums = parts.groupBy("row").agg(
        (F.sum("bytes") / 4).cast("long").alias("n_tokens"),
        F.bool_and("decoded").alias("decoded"),
        F.count("*").alias("n_chunks"),
    )
    long_ = giants.select("row", "doc_id").join(sums, "row").join(crcs, "row")
    return short.union(long_.select("doc_id", "n_tokens", "ids_crc32", "decoded", "n_chunks"))
