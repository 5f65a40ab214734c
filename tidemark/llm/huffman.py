"""Token-id files, canonically Huffman-coded with global counts.

Code lengths are limited (package-merge) and come from the counts of all ids; the code itself
follows from the lengths, which each file carries. A file is a run of documents in ``doc_id``
order: a bit stream, bit offsets of every block of ``BLOCK`` ids (checkpoints), and a directory of the
documents. Any block can be decoded by itself, through one table look-up an id; whole files are
decoded block beside block, one id of each at a time.

File: ``MAGIC``; stream; then, deflated, the code lengths, the checkpoints, the documents and the
sizes of all three; the tail's size (8 bytes); ``MAGIC``.

Texts are tokenized once: tasks first write each file with a code of its own counts, which the
manifest carries; with the counts of all files added up, a second pass codes the files anew.

Tasks write files under names of their own; the manifest, a table that Spark commits, names those
of the attempts that counted. So a lost executor or a second attempt leaves files nobody reads.

Rules: a null or empty text is the end id alone. Rows with null ``doc_id`` come first. Repeated rows
are kept, ordered by text. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import file_system, new_name, spread, written
from tidemark.llm.token_ids import public_path, word_ids
from tidemark.llm.words import pack_ints, text_blocks, unpack_ints

MAGIC = b"TIDEHUF1"
MAX_BITS, BLOCK, END_ID = 18, 512, 2
IDS_PER_FILE = 2_000_000
_MANIFEST = pa.schema(
    [
        ("part", pa.int32()),
        ("number", pa.int32()),
        ("file", pa.string()),
        ("docs", pa.int64()),
        ("ids", pa.int64()),
        ("counts", pa.binary()),
    ]
)
_MANIFEST_DDL = "part int, number int, file string, docs long, ids long, counts binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (0: id does not occur), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        weights = np.concatenate((leaves, packages))
        is_leaf = np.concatenate((np.ones(n, bool), np.zeros(len(packages), bool)))
        at = np.argsort(weights, kind="stable")
        levels.append(is_leaf[at])
        weights = weights[at][: len(at) // 2 * 2]
        packages = weights[0::2] + weights[1::2]
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id): the first is all zeros, each next one more, shifted where longer."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sizes = lengths[order].astype(np.uint64)
    if len(order):
        # In units of the longest code, each code begins where the one before ends.
        longest = sizes[-1]
        width = np.uint64(1) << (longest - sizes)
        codes[order] = (np.cumsum(width) - width) >> (longest - sizes)
    return codes


class Decoder:
    """Id and code length for every ``max_bits`` bits ahead."""

    def __init__(self, lengths: np.ndarray) -> None:
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.bits = int(lengths.max(initial=1))
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        self.ids = np.repeat(order, spans).astype(np.uint32)
        self.sizes = np.repeat(lengths[order], spans).astype(np.int64)
        # A code of one id alone leaves half its bits unused.
        self.ids = np.resize(self.ids, 1 << self.bits)
        self.sizes = np.resize(self.sizes, 1 << self.bits)

    def decode(self, stream: bytes, checkpoints: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
        """Ids of the blocks that begin at the checkpoints; the last may be short."""
        raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
        ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out = np.zeros((block, len(checkpoints)), np.uint32)
        at, mask, last = checkpoints.copy(), (1 << self.bits) - 1, 8 * len(stream)
        for i in range(min(block, n_ids)):
            seen = (ahead[at >> 3].astype(np.int64) >> (32 - self.bits - (at & 7))) & mask
            out[i] = self.ids[seen]
            at = np.minimum(at + self.sizes[seen], last)
        return out.T.ravel()[:n_ids]


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Bit stream of ids, and the bit at which each block begins."""
    code, size = codes[ids], lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    word, over = starts >> 6, (starts & 63) + size - 64
    fits = over <= 0
    left = np.where(fits, -over, 0).astype(np.uint64)
    right = np.where(fits, 0, over).astype(np.uint64)
    value = (code << left) >> right
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    if len(ids):
        words[word[firsts]] = np.bitwise_or.reduceat(value, firsts)
    spill = ~fits
    words[word[spill] + 1] |= code[spill] << (np.uint64(64) - right[spill])
    return words.astype(">u8").tobytes()[: (total + 7) // 8], starts[::block]


def _file_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    stream, checkpoints = encode_bits(ids, codes, lengths)
    known = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    values = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    parts = [
        lengths.tobytes(),
        pack_ints(np.diff(checkpoints, prepend=0)),
        pack_ints(np.array(sizes)) + known + values,
    ]
    head = np.array([len(doc_ids), *map(len, parts)], "<i8").tobytes()
    tail = zlib.compress(head + b"".join(parts))
    return b"".join([MAGIC, stream, tail, len(tail).to_bytes(8, "little"), MAGIC])


def read_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids (null: None), sizes, and all ids of a file."""
    if raw[:8] != MAGIC or raw[-8:] != MAGIC:
        raise ValueError("not a token-id file")
    size = int.from_bytes(raw[-16:-8], "little")
    tail = zlib.decompress(raw[-16 - size : -16])
    n, a, b, c = np.frombuffer(tail, "<i8", 4)
    lengths = np.frombuffer(tail, np.uint8, a, 32)
    checkpoints = np.cumsum(unpack_ints(tail[32 + a : 32 + a + b]))
    values = np.frombuffer(tail, "<i8", n, 32 + a + b + c - 8 * n)
    known = np.frombuffer(tail, np.uint8, n, 32 + a + b + c - 9 * n)
    sizes = unpack_ints(tail[32 + a + b : 32 + a + b + c - 9 * n])
    ids = Decoder(lengths).decode(raw[8 : -16 - size], checkpoints, int(sizes.sum()))
    return [int(v) if k else None for v, k in zip(values, known)], sizes, ids


def _put(files, root: str, part: int, number: int, doc_ids: list, sizes: list[int], ids: np.ndarray, lengths: np.ndarray) -> str:
    name = new_name(f"part-{part:05d}-{number:05d}", ".ids")
    body = _file_bytes(doc_ids, sizes, ids, canonical_codes(lengths), lengths)
    with files.open_output_stream(f"{root}/{name}") as out:
        out.write(body)
    return name


def _write(
    batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, max_bits: int, ids_per_file: int
) -> Iterator[pa.RecordBatch]:
    """Files with a code of their own counts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    files, root = file_system(folder)
    encoder, end = word_ids(path), np.array([end_id], "<u4").tobytes()
    doc_ids, texts_ids, held, number = [], [], 0, 0

    def flush() -> pa.RecordBatch:
        sizes = [len(x) // 4 for x in texts_ids]
        ids = np.frombuffer(b"".join(texts_ids), "<u4")
        counts = np.bincount(ids)
        name = _put(files, root, part, number, doc_ids, sizes, ids, code_lengths(counts, max_bits))
        row = [[part], [number], [name], [len(sizes)], [len(ids)], [zlib.compress(pack_ints(counts))]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _MANIFEST)], schema=_MANIFEST)

    for batch in batches:
        for first, last, data, offs in text_blocks(batch["text"]):
            made, bounds = encoder.encode(data, offs)
            for doc_id, a, b in zip(batch["doc_id"].slice(first, last - first).to_pylist(), bounds[:-1], bounds[1:]):
                doc_ids.append(doc_id)
                texts_ids.append(made[a:b].tobytes() + end)
                held += int(b - a) + 1
                if held >= ids_per_file:
                    yield flush()
                    doc_ids, texts_ids, held, number = [], [], 0, number + 1
    if doc_ids:
        yield flush()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for packed in batch["counts"].to_pylist():
            some = unpack_ints(zlib.decompress(packed))
            total, some = (total, some) if len(total) >= len(some) else (some, total)
            total[: len(some)] += some
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(used), "n": pa.array(total[used])})


def _code_anew(batches: Iterator[pa.RecordBatch], draft: str, folder: str, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    (source, source_root), (files, root) = file_system(draft), file_system(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with source.open_input_file(f"{source_root}/{row['file']}") as f:
                doc_ids, sizes, ids = read_file(f.read())
            name = _put(files, root, row["part"], row["number"], doc_ids, sizes.tolist(), ids, lengths)
            yield pa.RecordBatch.from_pylist([row | {"file": name}], schema=_MANIFEST)


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    files, root = file_system(folder)
    for batch in batches:
        for name, before in zip(batch["file"].to_pylist(), batch["before"].to_pylist()):
            with files.open_input_file(f"{root}/{name}") as source:
                doc_ids, sizes, ids = read_file(source.read())
            ends = np.cumsum(sizes)
            spans = [ids[e - s : e].astype("<u4").tobytes() for s, e in zip(sizes, ends)]
            columns = [doc_ids, before + ends - sizes, sizes, [zlib.crc32(x) for x in spans]]
            arrays = [pa.array(x, f.type) for x, f in zip(columns, _DOCS)]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(spans, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def write_token_ids(
    docs: DataFrame,
    folder: str,
    model_path: str | None = None,
    end_id: int = END_ID,
    max_bits: int = MAX_BITS,
    ids_per_file: int = IDS_PER_FILE,
) -> DataFrame:
    """Write the ids of all texts, ordered by ``doc_id``, under ``folder`` (shared by all executors);
    the manifest, with one row a file, comes back as a table."""
    path, draft = model_path or public_path(), f"{folder}/draft"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files, root = file_system(folder)
    files.create_dir(f"{root}/draft", recursive=True)
    ordered = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    drafts = written(
        ordered.mapInArrow(lambda x: _write(x, draft, path, end_id, max_bits, ids_per_file), _MANIFEST_DDL), "drafts"
    )
    # One row an id of the vocabulary.
    rows = drafts.select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end_id, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    return written(spread(drafts, "file").mapInArrow(lambda x: _code_anew(x, draft, folder, lengths), _MANIFEST_DDL), "manifest").drop("counts")


def read_token_ids(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32``, and the ids themselves if asked."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file.
    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    dealt = spread(placed.select("file", "before"), "file")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return dealt.mapInArrow(lambda x: _read(x, folder, with_ids), schema)
