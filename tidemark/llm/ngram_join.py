"""Jaccard join on word n-grams: rare-first prefix filtering, each pair verified once.

1. Documents with the same word sequence form a class; tasks pass over those they have seen. They hash the
   n-grams of the others (Rabin-Karp) and send them packed by hash bucket through one shuffle, with a
   document's place in its block of texts, a byte or two, in place of its class: the more buckets there
   are, the fewer n-grams of a document fall in one, and a class would be sent with nearly each of them.
   The classes of a block are sent once. Buckets count in how many documents an n-gram is; those in one alone,
   the rarest, are known by their absence from then on. What is shared goes back to its block.
2. In the order (count, hash), a class can only link to another through its first
   ``n - ceil(t n) + 1`` n-grams. A document whose shared n-grams are fewer than ``t n`` drops out in its
   block; of those of a class one is kept, and all work below is per class.
3. Prefix n-grams of two classes or more are mapped to blocks, those with members in common mostly
   to the same one: two classes with a common prefix n-gram meet in a block, and a class is in few.
   In a block, pivots, the most central first, are compared with all members of other components
   that pass the length, positional and suffix filters, in one pass each, until all but the
   members of the largest component have been pivots. So no link between components is lost, a
   dense group costs few passes, and no pairs are written out.
4. Blocks that hold too much for a task, n-grams or classes, are cut at random into parts, anew in each
   round, while that halves the pairs between components; at last each class outside the largest
   component meets every part.

The suffix filter compares how many n-grams fall in each of 16 hash ranges: the differences bound
the number of n-grams in one set only from below.

N-grams count as equal when 56 bits of their hash and the bucket agree, with some 2.6 million
n-grams a bucket at any input size; word sequences, when 64 bits and the number of n-grams agree.

Rules: A-Z are lower-cased. A document with fewer words than ``size`` has its whole sequence as one
n-gram. Documents without words, or with null text, link with nothing. Rows with null ``doc_id``
get a null component and count as copies of no document. Repeated rows are copies of each other.
Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.store import buckets_for, lean, written
from tidemark.llm.words import Words, mix, pack_ints, pack_tail, text_blocks, unpack_ints, unpack_tail, window_hashes

SIZE, PERCENT = 5, 80
CHARS_PER_BUCKET = 16_000_000
KEYS_PER_PART = 1_000_000
# A part has at least so many classes, or half a partition's share of all where that is more.
CLASSES_PER_PART = 200
# Rounds over blocks that were cut go on while each leaves no more than this share of the pairs.
LESS = 0.5
SUFFIX_RANGES = 16
_KEY_BYTES = 7
# ``texts`` and ``more`` are places in the block, as ``_pack_places`` makes them. A row with ``classes`` tells the
# classes of a block, and in ``more`` the sizes of their sets.
_SENT = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64())]
    + [(name, pa.binary()) for name in ("texts", "more", "keys", "counts", "classes")]
)
_SHARED = pa.schema(list(_SENT)[1:])
_KEPT = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])
_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _classes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of each text's words in their order; 0 without words."""
    place = np.arange(len(hashes)) - words.bounds[words.owners()]
    out = np.zeros(len(words.counts), np.uint64)
    has = np.flatnonzero(words.counts)
    if len(has):
        placed = mix(hashes ^ mix(place.astype(np.uint64), 21), 22)
        out[has] = mix(np.add.reduceat(placed, words.bounds[has]), 23)
    return out


def class_of(text: str = "text") -> Column:
    """The ``class`` that ``ngram_jaccard_components`` gives each text; null without words."""

    def hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for _, _, data, offs in text_blocks(column):
                words = Words(data, offs, fold=True)
                parts.append((_classes(words, words.hashes()), words.counts))
            classes, counts = (np.concatenate(x) for x in zip(*parts))
            yield pa.array(classes.view(np.int64), mask=counts == 0)

    @F.arrow_udf("long")
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lean(hashed(texts))

    return made(text)


class _Sets:
    """N-gram sets of a block of texts: class and set size per text, and (owner, key) pairs."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, size: int) -> None:
        words = Words(data, offs, fold=True)
        hashes, counts, firsts = words.hashes(), words.counts, words.bounds[:-1]
        self.classes = _classes(words, hashes)
        del words
        windows = np.where(counts < size, np.minimum(counts, 1), counts - size + 1)
        ends = np.cumsum(windows)
        owners = np.repeat(np.arange(len(counts), dtype=np.int32), windows)
        # Where each window begins: its text's first word and its place among the text's windows.
        at = np.arange(len(owners)) + np.repeat(firsts - ends + windows, windows)
        found = window_hashes(hashes, size, 31 + size)
        # A text of fewer words has one window, which may be beyond the last that was hashed.
        keys = found[np.minimum(at, len(found) - 1)] if len(found) else np.zeros(len(owners), np.uint64)
        del found, at
        for n in range(1, size):
            short = np.flatnonzero(counts == n)
            spans = firsts[short, None] + np.arange(n)
            keys[ends[short] - 1] = window_hashes(hashes[spans.ravel()], n, 31 + n)[::n]
        # Text by text and in place: a sort of the whole block would need several arrays of its size.
        for a, b in zip((ends - windows)[windows > 1].tolist(), ends[windows > 1].tolist()):
            keys[a:b].sort()
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        self.keys, self.owners = keys[new], owners[new]
        self.sizes = np.bincount(self.owners, minlength=len(counts))


def _members(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offs in text_blocks(batch["text"]):
            sets = _Sets(data, offs, size)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].slice(first, end - first),
                    "class": pa.array(sets.classes.view(np.int64), mask=sets.sizes == 0),
                    "n": pa.array(sets.sizes.astype(np.int64)),
                }
            )


def _pack_places(places: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending places in a block, many of them repeated: for each the gap to the one before with up to three
    repeats in the low bits, and apart from that the repeats beyond."""
    firsts = np.flatnonzero(np.diff(places, prepend=-1))
    repeats = np.diff(np.append(firsts, len(places))) - 1
    gaps = np.diff(places[firsts], prepend=0)
    return pack_ints(gaps << 2 | np.minimum(repeats, 3)), pack_ints(repeats[repeats > 2] - 3)


def _unpack_places(texts: bytes, more: bytes) -> np.ndarray:
    packed = unpack_ints(texts)
    repeats = packed & 3
    repeats[repeats == 3] += unpack_ints(more)
    return np.repeat(np.cumsum(packed >> 2), repeats + 1)


def _block_of(classes: np.ndarray) -> int:
    """A hash of the classes of a block's texts in their order, so that a task that runs again gives the same."""
    placed = mix(classes ^ mix(np.arange(len(classes), dtype=np.uint64), 51), 52)
    return int(mix(np.add.reduce(placed, keepdims=True), 53).view(np.int64)[0])


def _by_bucket(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # at most one entry a row of this task's split
    for batch in batches:
        for _, _, data, offs in text_blocks(batch["text"], 4 << 20):
            sets = _Sets(data, offs, size)
            fresh = np.zeros(len(sets.classes), bool)
            for i, (one, n) in enumerate(zip(sets.classes.tolist(), sets.sizes.tolist())):
                if n and one not in seen:
                    seen.add(one)
                    fresh[i] = True
            if not fresh.any():
                continue
            block = _block_of(sets.classes)
            rows = [(-1 - block % buckets, block, None, pack_ints(sets.sizes), None, None, sets.classes.tobytes())]
            keys, texts = sets.keys, sets.owners
            del sets
            if not fresh.all():
                use = fresh[texts]
                keys, texts = keys[use], texts[use]
            bucket = (mix(keys, 41) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, texts, bucket = keys[order], texts[order], bucket[order]
            del order
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                rows.append((bucket[a], block, *_pack_places(texts[a:b]), pack_tail(keys[a:b], _KEY_BYTES), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SENT)], schema=_SENT)


def _shared(sent: pa.Table) -> pa.Table:
    """The bucket's n-grams that are in two documents or more, with their counts, by block."""
    bucket = sent["bucket"][0].as_py()
    if bucket < 0:
        return sent.drop_columns(["bucket"]).cast(_SHARED)
    blocks = sent["block"].to_pylist()
    texts = [_unpack_places(t, m).astype(np.int32) for t, m in zip(sent["texts"].to_pylist(), sent["more"].to_pylist())]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    texts = np.concatenate(texts)
    keys = np.concatenate([unpack_tail(k, _KEY_BYTES) for k in sent["keys"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    many = np.zeros(len(order), bool)
    same = ordered[1:] == ordered[:-1]
    many[1:] |= same
    many[:-1] |= same
    keys, order = ordered[many], order[many]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    counts = np.bincount(group)[group] if len(group) else group
    # Back in the order in which they came, by block and text.
    back = np.argsort(order)
    at, keys, counts = order[back], mix(keys[back], bucket + 1), counts[back]
    row, texts = row[at], texts[at].astype(np.int64)
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    rows = [
        (blocks[row[a]], *_pack_places(texts[a:b]), keys[a:b].tobytes(), pack_ints(counts[a:b]), None)
        for a, b in zip(cuts, [*cuts[1:], len(row)])
    ]
    columns = zip(*rows) if rows else [[] for _ in _SHARED]
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, _SHARED)], schema=_SHARED)


def _kept(block: pa.Table, percent: int) -> pa.Table:
    """``class``, ``n`` and the shared n-grams in the order (count, hash) of a block's documents that have enough."""
    told = block.filter(block["classes"].is_valid())
    shared = block.filter(block["classes"].is_null())
    if not len(shared):
        return _KEPT.empty_table()
    classes = np.frombuffer(told["classes"][0].as_py(), np.int64)
    sizes = unpack_ints(told["more"][0].as_py())
    texts = np.concatenate([_unpack_places(*x) for x in zip(shared["texts"].to_pylist(), shared["more"].to_pylist())])
    keys = np.concatenate([np.frombuffer(x, np.int64) for x in shared["keys"].to_pylist()])
    counts = np.concatenate([unpack_ints(x) for x in shared["counts"].to_pylist()])
    order = np.lexsort((keys, counts, texts))
    texts, keys = texts[order], keys[order]
    # Blocks with the same texts have the same number; each text's n-grams are taken once.
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
    texts, keys = texts[new], keys[new]
    lengths = np.bincount(texts, minlength=len(classes))
    enough = (lengths > 0) & (100 * lengths >= percent * sizes)
    offsets = np.append(0, np.cumsum(lengths[enough])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[enough[texts]]))
    return pa.table([pa.array(classes[enough]), pa.array(sizes[enough]), lists], schema=_KEPT)


def _pivots(block: pa.Table, percent: int) -> pa.Table:
    """Links that join the components of a block's classes, as far as any two of them are linked.

    Rows marked ``pivot`` are compared with all others, each in one pass. If all are, those of the
    component that is largest by then need not be. ``place`` is the earliest that the first n-gram in
    common with another may have.
    """
    classes, place = block["class"].to_numpy(), block["place"].to_numpy().astype(np.int64)
    sizes, may = block["n"].to_numpy().astype(np.int64), block["pivot"].to_numpy(zero_copy_only=False)
    _, root = np.unique(block["component"].to_numpy(), return_inverse=True)
    arrays = block["keys"].combine_chunks()
    if isinstance(arrays, pa.ChunkedArray):
        arrays = pa.concat_arrays(arrays.chunks)
    lengths = np.diff(arrays.offsets.to_numpy())
    starts, alone = np.cumsum(lengths) - lengths, sizes - lengths
    keys = arrays.flatten().to_numpy()
    _, ids = np.unique(keys, return_inverse=True)
    owner = np.repeat(np.arange(len(classes)), lengths)
    ranges = np.bincount(owner * SUFFIX_RANGES + keys % SUFFIX_RANGES, minlength=len(classes) * SUFFIX_RANGES)
    ranges = ranges.reshape(-1, SUFFIX_RANGES)
    centrality = np.add.reduceat(np.bincount(ids)[ids], starts) / np.maximum(sizes, 1)
    tried, links, mark = ~may, [], np.zeros(len(ids), bool)
    while root.min() != root.max():
        open_ = ~tried & (root != np.bincount(root).argmax()) if may.all() else ~tried
        if not open_.any():
            break
        pivot = int(np.where(open_, centrality, -1.0).argmax())
        tried[pivot] = True
        need = -(-percent * (sizes[pivot] + sizes) // (100 + percent))
        some = root != root[pivot]
        some &= 100 * np.minimum(sizes, sizes[pivot]) >= percent * np.maximum(sizes, sizes[pivot])
        some &= np.minimum(lengths - place, lengths[pivot] - place[pivot]) >= need
        apart = np.abs(ranges - ranges[pivot]).sum(axis=1)
        some &= lengths + lengths[pivot] - apart >= 2 * need
        some = np.flatnonzero(some)
        if not len(some):
            continue
        own = ids[starts[pivot] : starts[pivot] + lengths[pivot]]
        mark[own] = True
        ends = np.cumsum(lengths[some])
        at = np.arange(ends[-1]) + np.repeat(starts[some] - ends + lengths[some], lengths[some])
        common = np.add.reduceat(mark[ids[at]].astype(np.int64), ends - lengths[some])
        mark[own] = False
        linked = some[100 * common >= percent * (sizes[pivot] + sizes[some] - common)]
        # One link to each other component.
        others, first = np.unique(root[linked], return_index=True)
        links += [(classes[pivot], classes[i]) for i in linked[first]]
        root[np.isin(root, others)] = root[pivot]
    made = np.array(links, np.int64).reshape(-1, 2)
    return pa.table([pa.array(made[:, 0]), pa.array(made[:, 1])], schema=_LINKED)


def _stars(block: pa.Table, percent: int) -> pa.Table:
    """What ``_pivots`` finds, as links of the block's components to the smallest that each can reach."""
    links = _pivots(block, percent)
    component = dict(zip(block["class"].to_pylist(), block["component"].to_pylist()))
    least: dict[int, int] = {}

    def root(one: int) -> int:
        while (above := least.setdefault(one, one)) != one:
            least[one] = least[above]
            one = least[one]
        return one

    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist()):
        a, b = sorted((root(component[a]), root(component[b])))
        least[b] = a
    joined = [one for one in least if root(one) != one]
    return pa.table([pa.array(joined, pa.int64()), pa.array(map(root, joined), pa.int64())], schema=_LINKED)


def _blocks(found: DataFrame) -> DataFrame:
    """``block``, ``class``, ``place`` (the first of the class's n-grams there), ``weight`` (its set's size)."""
    rows = found.select("class", F.size("keys").alias("weight"), F.posexplode("prefix").alias("place", "key"))
    open_ = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = rows.join(open_, "key")
    # An n-gram goes to the block of the widest n-gram that one of its classes has.
    widest = rows.groupBy("class").agg(F.max(F.struct("members", "key")).alias("widest"))
    block = rows.join(widest, "class").groupBy("key").agg(F.max("widest")["key"].alias("block"))
    met = rows.join(block, "key").groupBy("block", "class")
    return written(met.agg(F.min("place").alias("place"), F.first("weight").alias("weight")), "blocks")


def _compared(found: DataFrame, dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that the pivots of each block, part and set of pivots find."""
    blocks = found.select("class", "n", "keys").join(dealt, "class")
    return blocks.groupBy("block", "part", "against").applyInArrow(lambda x: _stars(x, percent), "a long, b long")


def _parts(weight: Column, members: Column, keys_per_part: int, classes_per_part: int) -> Column:
    return F.ceil(F.greatest(weight / keys_per_part, members / classes_per_part)).cast("int")


def _between(rows: DataFrame, keys_per_part: int, classes_per_part: int) -> DataFrame:
    """Blocks of ``rows`` with each class outside the largest component against all parts."""
    sizes = rows.groupBy("block", "component").agg(F.count("*").alias("m"), F.sum("weight").alias("weight"))
    parts = (
        sizes.groupBy("block")
        .agg(F.count("*").alias("several"), F.sum("m").alias("members"), F.sum("weight").alias("all"), F.max(F.struct("m", "weight", "component")).alias("top"))
        .where("several > 1")
        .select(
            "block",
            F.col("top.component").alias("largest"),
            _parts(F.col("all"), F.col("members"), keys_per_part, classes_per_part).alias("parts"),
            _parts(
                F.col("all") - F.col("top.weight"), F.col("members") - F.col("top.m"), keys_per_part, classes_per_part
            ).alias("pivot_parts"),
        )
    )
    rows = rows.join(parts, "block")
    row = ["block", "class", "component", "place"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    members = rows.select(*row, F.lit(False).alias("pivot"), one("parts").alias("part"), every("pivot_parts").alias("against"))
    pivots = rows.where(F.col("component") != F.col("largest")).select(
        *row, F.lit(True).alias("pivot"), every("parts").alias("part"), one("pivot_parts").alias("against")
    )
    return members.union(pivots)


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) after links between components, or classes that had none, are found."""
    more = components(links)
    named = more.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    old = groups.join(named, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    return written(old.union(more.join(groups, "node", "left_anti")), "groups")


def _groups(found: DataFrame, percent: int, keys_per_part: int) -> DataFrame:
    """``node`` and ``component`` (the smallest class reachable by links) of every class with a link."""
    met = _blocks(found)
    sizes = met.groupBy("block").agg(F.sum("weight").alias("all"), F.count("*").alias("members")).where("members > 1")
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes_per_part = max(CLASSES_PER_PART, met.count() // (2 * partitions))
    parts = sizes.select("block", _parts(F.col("all"), F.col("members"), keys_per_part, classes_per_part).alias("parts"))
    rows = met.join(parts, "block").withColumn("component", F.col("class"))

    def at_random(rows: DataFrame, round_: int) -> DataFrame:
        part = F.pmod(F.xxhash64("class", F.lit(round_)), F.col("parts")).cast("int")
        return rows.select(
            "block", "class", "component", "place", F.lit(True).alias("pivot"), part.alias("part"), F.lit(0).alias("against")
        )

    groups, rounds, left = components(_compared(found, at_random(rows, 0), percent)), 0, None
    cut = written(rows.where("parts > 1").drop("component"), "cut")
    if cut.isEmpty():
        return groups
    # Later rounds read and send the n-grams of these classes alone, and search for components among components.
    found = written(found.join(cut.select("class").distinct(), "class", "left_semi"), "cut-keys")
    while True:
        rows = cut.join(groups.withColumnRenamed("node", "class"), "class", "left")
        rows = rows.withColumn("component", F.coalesce("component", "class"))
        sizes = rows.groupBy("block", "component").agg(F.count("*").alias("m")).groupBy("block")
        pairs = sizes.agg((F.pow(F.sum("m"), F.lit(2)) - F.sum(F.col("m") * F.col("m"))).alias("pairs"))
        now = pairs.agg(F.sum("pairs")).first()[0]
        if not now:
            return groups
        if left is not None and now > LESS * left:
            return _joined(groups, _compared(found, _between(rows.drop("parts"), keys_per_part, classes_per_part), percent))
        left, rounds = now, rounds + 1
        groups = _joined(groups, _compared(found, at_random(rows, rounds), percent))


def ngram_jaccard_components(
    docs: DataFrame,
    size: int = SIZE,
    percent: int = PERCENT,
    chars_per_bucket: int = CHARS_PER_BUCKET,
    keys_per_part: int = KEYS_PER_PART,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``class`` (of equal word sequences, null without words)
    and ``component_id``, the smallest ``doc_id`` reachable by links of similarity ``percent``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = written(
        narrow.mapInArrow(lambda x: lean(_members(x, size)), "doc_id long, class long, n long"), "members"
    )
    buckets = buckets_for(narrow, "text", chars_per_bucket)
    packed = "block long, texts binary, more binary, keys binary, counts binary, classes binary"
    sent = narrow.where("doc_id is not null").mapInArrow(
        lambda x: lean(_by_bucket(x, size, buckets)), f"bucket int, {packed}"
    )
    shared = sent.groupBy("bucket").applyInArrow(_shared, packed)
    kept = shared.groupBy("block").applyInArrow(lambda x: _kept(x, percent), "class long, n long, keys array<long>")
    known = members.where("class is not null and doc_id is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("first_doc"))
    need = F.expr(f"({percent} * n + 99) div 100")
    found = written(
        kept.dropDuplicates(["class"])
        # The n-grams of the prefix that other documents have: those of one alone come before them.
        .withColumn("prefix", F.slice("keys", 1, (F.size("keys") - need + 1).cast("int"))),
        "found",
    )
    groups = _groups(found, percent, keys_per_part).withColumnRenamed("node", "class")
    placed = classes.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    firsts = placed.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_class = placed.join(firsts, "component").select("class", "component_id")
    joined = members.join(of_class, "class", "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "class",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
