"""Token ids of whole texts by a public word tokenizer, with a bounded cache of words.

The tokenizer (word_bpe_49k.json) drops white space and never joins across it, so a text's ids are
those of its pieces between ASCII white space, one after the other. Each task keeps the ids of the
pieces it has met and asks the tokenizers library only for new ones.

Lower case is what the tokenizer makes of ASCII letters anyway, and it splits letters from the marks
that follow; so a piece of letters and marks is looked up as these two before it counts as new. New
runs of letters are encoded many at a time, as one text: each ends with the one token of an end of
word that it has.

Pieces are looked up by a 64-bit hash, once for each distinct piece of a block of texts. That two
pieces share one is a matter of 1 in 1e13 a new piece. The cache lies in arrays, some 25 bytes a piece, so that
the workers that Spark keeps hold little.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from tidemark.llm.words import Words

MODEL = "word_bpe_49k.json"
CACHE_WORDS, CACHE_RUNS = 1_200_000, 100_000
_RECENT = 40_000
_PIECES_AT_ONCE = 256
# ASCII characters that are neither letter nor digit, but for the apostrophe (it begins endings).
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'")


class Cache:
    """Ids of pieces by hash: sorted arrays, and what came since they were last merged.

    At ``limit`` pieces the cache begins anew; one row of ids, by hash, answers a whole block."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.flat = [np.zeros(0, np.uint32)]
        self.length = 0
        self.recent: dict[int, bytes] = {}

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the distinct ``hashes`` the cache lacks."""
        at = np.searchsorted(self.keys, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.keys)
        found[inside] = self.keys[at[inside]] == hashes[inside]
        if self.recent:
            rest = np.flatnonzero(~found)
            found[rest] = [k in self.recent for k in hashes[rest].tolist()]
        return ~found

    def add(self, made: dict[int, bytes]) -> None:
        """A piece of 65,535 ids or more is kept only until the next merge."""
        self.recent.update(made)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where each hash's are and how many."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        found = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        begins, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begins[found], sizes[found] = self.starts[at[found]], self.sizes[at[found]]
        rest = np.flatnonzero(~found)
        late = [self.recent[k] for k in hashes[rest].tolist()]
        sizes[rest] = np.fromiter(map(len, late), np.int64, len(late)) // 4
        begins[rest] = self.length + np.cumsum(sizes[rest]) - sizes[rest]
        return np.concatenate([*self.flat, np.frombuffer(b"".join(late), "<u4")]), begins, sizes

    def settle(self) -> None:
        """Between blocks: merge what is recent, or begin anew."""
        if len(self.keys) + len(self.recent) > self.limit:
            return self._empty()
        if len(self.recent) < _RECENT:
            return
        made = {k: v for k, v in self.recent.items() if len(v) < 4 * 65_535}
        sizes = np.fromiter(map(len, made.values()), np.int64, len(made)) // 4
        self.flat = [np.concatenate([*self.flat, np.frombuffer(b"".join(made.values()), "<u4")])]
        keys = np.concatenate((self.keys, np.fromiter(made, np.uint64, len(made))))
        starts = np.concatenate((self.starts, self.length + np.cumsum(sizes) - sizes))
        sizes = np.concatenate((self.sizes, sizes.astype(np.uint16)))
        self.length = len(self.flat[0])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.sizes = keys[order], starts[order], sizes[order]
        self.recent = {}


class WordIds:
    """Ids (unsigned 32 bits) of texts, by the words in them."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Cache(cache_words)
        self.known: dict[bytes, bytes] = {}  # runs of letters, of marks, and all else
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _encode_each(self, pieces: list[bytes]) -> None:
        for piece, ids in zip(pieces, self._ids(pieces)):
            self.known[piece] = np.array(ids, "<u4").tobytes()

    def _encode_words(self, words: list[bytes]) -> None:
        """Runs of letters, in one text."""
        ids = np.array(self._ids([b" ".join(words)])[0], "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            # A letter of one of them is written as letter and mark in lower case.
            return self._encode_each(words)
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            self.known[word] = raw[at:end]
            at = end

    def _learn(self, pieces: dict[int, bytes]) -> None:
        known, words, others, made = self.known, set(), set(), []
        for key, piece in pieces.items():
            plain = piece.lower()
            body = plain.rstrip(_MARKS)
            if body.isalpha() or body and not body.isascii() and body.decode().isalpha():
                marks = plain[len(body) :]
                if body not in known:
                    words.add(body)
            else:
                body, marks = b"", piece
            if marks and marks not in known:
                others.add(marks)
            made.append((key, body, marks))
        known[b""] = b""
        for some, encode in ((list(words), self._encode_words), (list(others), self._encode_each)):
            for i in range(0, len(some), _PIECES_AT_ONCE):
                encode(some[i : i + _PIECES_AT_ONCE])
        self.pieces.add({key: known[body] + known[marks] for key, body, marks in made})
        if len(known) > CACHE_RUNS:
            known.clear()

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, given as bytes and offsets, and the offsets of each text's ids."""
        words = Words(data, offs)
        hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        new = np.flatnonzero(self.pieces.missing(hashes))
        if len(new):
            raw, starts, ends = data.tobytes(), words.starts[first[new]], words.ends[first[new]]
            keys = hashes[new].tolist()
            self._learn({k: raw[a:b] for k, a, b in zip(keys, starts.tolist(), ends.tolist())})
        flat, begins, sizes = self.pieces.ids(hashes)
        self.pieces.settle()
        begins, sizes = begins[which], sizes[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        places = np.arange(ends[-1]) + np.repeat(begins - ends[:-1], sizes)
        return flat[places], ends[words.bounds]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One encoder a Python worker."""
    return WordIds(path)


def public_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
