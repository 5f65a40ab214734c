"""Katz backoff language model: learned from some documents of a table, scoring all of them.

A token's probability is that of the word pair's Good-Turing discounted count if the pair was met in training,
else the context's backoff weight times the word's own probability; a word never met shares the mass that
discounting takes from the words. Weights are exactly normalised: over all known words and the unknown one,
the probabilities after a context add up to 1.

1. Tasks cut texts into blocks and store each block's tokens (numbers into the block's own word list, by
   falling frequency, seven bits a byte) in a table bucketed by block: later joins on the block leave it
   where it is.
2. Vocabulary table: each block sends its distinct words with their training counts, by hash bucket. A bucket
   numbers its words by falling count and answers each block.
3. Pair table: each block sends its distinct pairs by bucket of the context, as gaps between numbers. A bucket adds
   up the counts and answers each block with the pairs' counts and each context's numbers of pairs met
   once to ``K`` times, of pairs, of tokens, and its words' own probabilities. Discounts are known only when all
   pairs are counted; weights are linear in these numbers, so blocks form them afterwards.
4. Blocks read both tables and evaluate their tokens, pair first, then word, then unknown.

What is sent per distinct word or pair of a block, not per token, bounds hot ones: a block sends one row of each.
A context of more than a share of all tokens (``_spread``) is cut by following word; there are at most 100,000 such
contexts, whose numbers go to all tasks. All else travels by join.

Order 2: pairs of words. A third order would send nearly every token again with its lower probability, some
2.5 times the input.

Discounts: Katz's, for counts up to the largest ``k`` of 2 to ``K`` for which all lie between 0 and 1; where no ``k``
gives such, each count is lowered by one half. Where all counts after a context (or of all words) are above
``k``, one more token is counted there, for what was not met.

Words are told apart by a 64-bit hash. Rules: a null or empty text is its end alone. A null ``doc_id`` is held out.
Repeated rows each count. With nothing to learn from, all is unknown, with probability 1. Texts may be of
any length; a text longer than a block is a block. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import lean, work_dir, written
from tidemark.llm.words import Words, mix, pack_gaps, pack_ints, text_blocks, unpack_gaps, unpack_ints

FOLDS, HELD_OUT = 5, 1
K = 5
BLOCK_BYTES = 6 << 20
WORDS_PER_BUCKET, PAIRS_PER_BUCKET = 2_000_000, 2_000_000
CONTEXT_TOKENS, MOST_CONTEXTS = 1_000_000, 100_000
_END = np.uint64(0xA076_1D64_78BD_642F)
_BLOCKS = (
    "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, tokens_in long, "
    "distinct_in long, words binary, seen binary, tokens binary"
)
_WORDS_SENT = "bucket int, block long, hashes binary, seen binary"
_WORDS = "bucket int, block long, ids binary, counts binary, totals array<long>"
_PAIRS_SENT = "bucket int, block long, contexts binary, sizes binary, words binary, seen binary, counts binary, spread binary"
_PAIRS = "bucket int, block long, counts binary, numbers binary, own binary, totals array<long>, context long"
# Numbers of a context: tokens, pairs, pairs met once, ..., K times.
NUMBERS = 2 + K


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))


@dataclass(frozen=True)
class Discount:
    """What counts are lowered to; ``ratios[r - 1]`` is the ratio of a count ``r``, None: one half less."""

    ratios: tuple[float, ...] | None

    @staticmethod
    def of(times: list[int]) -> Discount:
        """From how many events were met once, twice, ... ``K + 1`` times."""
        for k in range(K, 1, -1):
            n = times[: k + 1]
            if min(n) <= 0:
                continue
            rest = (k + 1) * n[k] / n[0]
            if rest >= 1:
                continue
            ratios = tuple(((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) for r in range(1, k + 1))
            if all(0 < d < 1 for d in ratios):
                return Discount(ratios)
        return Discount(None)

    def lowered(self, counts: np.ndarray) -> np.ndarray:
        if self.ratios is None:
            return np.maximum(counts - 0.5, 0)
        ratio = np.ones(len(self.ratios) + 2)
        ratio[1:-1] = self.ratios
        return counts * ratio[np.minimum(counts, len(self.ratios) + 1)]

    def lost(self, numbers: np.ndarray) -> np.ndarray:
        """Count taken from each row of ``numbers`` (tokens, events, events met once, twice, ...)."""
        if self.ratios is None:
            return 0.5 * numbers[:, 1]
        r = np.arange(1, len(self.ratios) + 1)
        return numbers[:, 2 : 2 + len(r)] @ (r * (1 - np.array(self.ratios)))


@dataclass(frozen=True)
class Vocabulary:
    """Training tokens, distinct words, and the words' own probabilities."""

    tokens: int
    distinct: int
    discount: Discount
    lost: float

    @staticmethod
    def of(numbers: list[int]) -> Vocabulary:
        """From tokens, words, and how many words were met once, ..., ``K + 1`` times."""
        discount = Discount.of(numbers[2:])
        lost = float(discount.lost(np.array([numbers], np.float64))[0])
        return Vocabulary(numbers[0], numbers[1], discount, lost)

    def own(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by count; of the unknown word for 0."""
        if not self.tokens:
            return np.ones(len(counts))
        total, left = (self.tokens, self.lost) if self.lost else (self.tokens + 1, 1.0)
        return np.where(counts > 0, self.discount.lowered(counts), left) / total

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def _tokenise(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for first, end, data, offs in text_blocks(batch["text"], block_bytes):
            words = Words(data, offs, fold=True)
            n = end - first
            hashes = np.empty(len(words.starts) + n, np.uint64)
            hashes[np.arange(len(words.starts)) + words.owners()] = words.hashes()
            hashes[words.bounds[1:] + np.arange(n)] = _END
            sizes = words.counts + 1
            held = batch["held"].slice(first, n)
            learned = ~np.repeat(held.to_numpy(zero_copy_only=False), sizes)
            distinct, tokens, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens = place[tokens]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([batch["doc_id"].slice(first, n).to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([held.to_pylist()], pa.list_(pa.bool_())),
                    "sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "tokens_in": pa.array([len(tokens)], pa.int64()),
                    "distinct_in": pa.array([len(distinct)], pa.int64()),
                    "words": pa.array([distinct[order].tobytes()], pa.binary()),
                    "seen": pa.array([pack_ints(np.bincount(tokens[learned], minlength=len(distinct)))], pa.binary()),
                    "tokens": pa.array([pack_ints(tokens)], pa.binary()),
                }
            )
            number += 1


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of each run of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1 if len(values) else values[:0].astype(np.int64)
    edges = [0, *cuts.tolist(), len(values)] if len(values) else []
    yield from zip(edges, edges[1:])


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and the words in the order in which a block sends them."""
    bucket = (mix(hashes, 51) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


_WORDS_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("seen", pa.binary())])
_WORDS_ARROW = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("totals", pa.list_(pa.int64()))]
)
_PAIRS_SENT_ARROW = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64())]
    + [(n, pa.binary()) for n in ("contexts", "sizes", "words", "seen", "counts", "spread")]
)
_PAIRS_ARROW = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("numbers", pa.binary()), ("own", pa.binary())]
    + [("totals", pa.list_(pa.int64())), ("context", pa.int64())]
)


def _send_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            hashes, seen = np.frombuffer(row["words"], np.uint64), unpack_ints(row["seen"])
            bucket, order = _by_bucket(hashes, buckets)
            found = []
            for a, b in _runs(bucket[order]):
                some = order[a:b]
                found.append((int(bucket[some[0]]), row["block"], hashes[some].tobytes(), pack_ints(seen[some])))
            yield _rows(found, _WORDS_SENT_ARROW)


def _met(counts: np.ndarray, most: int) -> list[int]:
    """How many of ``counts`` are 1, ..., ``most``."""
    return np.bincount(np.minimum(counts, most + 1), minlength=most + 2)[1 : most + 1].tolist()


def _count_words(sent: pa.Table, buckets: int) -> pa.Table:
    """Answers to the blocks, and one row (block null) with the bucket's numbers."""
    bucket = sent["bucket"][0].as_py()
    parts = [np.frombuffer(x, np.uint64) for x in sent["hashes"].to_pylist()]
    seen = np.concatenate([unpack_ints(x) for x in sent["seen"].to_pylist()])
    distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.bincount(place, seen).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    ids = np.empty(len(order), np.int64)
    # From 1, frequent words first; bucket by bucket they don't meet.
    ids[order] = np.arange(len(order)) * buckets + bucket + 1
    rows, at = [], 0
    for block, part in zip(sent["block"].to_pylist(), parts):
        some = place[at : at + len(part)]
        rows.append((bucket, block, pack_ints(ids[some]), pack_ints(counts[some]), None))
        at += len(part)
    totals = [int(counts.sum()), int((counts > 0).sum()), *_met(counts, K + 1)]
    rows.append((bucket, None, None, None, totals))
    return pa.Table.from_batches([_rows(rows, _WORDS_ARROW)])


@dataclass(frozen=True)
class _Plan:
    """How pairs are dealt: buckets, and tokens of a context beyond which it is spread over several."""

    word_buckets: int
    pair_buckets: int
    context_tokens: int


class _Pairs:
    """A block's distinct pairs of context and word, in the order in which it sends them.

    ``context`` is 0 at the beginning of a text; a word never met in training is 0 too."""

    def __init__(self, row: dict, plan: _Plan) -> None:
        local = unpack_ints(row["tokens"])
        hashes = np.frombuffer(row["words"], np.uint64)
        _, order = _by_bucket(hashes, plan.word_buckets)
        answers = sorted(row["answers"], key=lambda x: x["bucket"])
        ids, counts = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        ids[order] = np.concatenate([unpack_ints(x["ids"]) for x in answers])
        counts[order] = np.concatenate([unpack_ints(x["counts"]) for x in answers])
        sizes = np.array(row["sizes"], np.int64)
        self.firsts = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.counts = counts[local]
        none = len(hashes)
        ids, counts = np.append(ids, 0), np.append(counts, self.counts[-1])
        context = np.empty(len(local), np.int64)
        context[1:] = local[:-1]
        context[self.firsts] = none
        # The context was met in training: the beginning if any document was learned from.
        self.known = counts[context] > 0
        word = np.where(self.counts > 0, local, none)
        distinct, self.pair = np.unique(context[self.known] * (none + 1) + word[self.known], return_inverse=True)
        context, word = distinct // (none + 1), distinct % (none + 1)
        context_counts = counts[context]
        self.context, self.word = ids[context], ids[word]
        self.word_counts = np.where(word == none, 0, counts[word])
        self.spread = context_counts > plan.context_tokens
        parts = np.maximum(-(-context_counts // plan.context_tokens), 1).astype(np.uint64)
        part = np.where(self.spread, mix(self.word.astype(np.uint64), 61) % parts, np.uint64(0))
        self.bucket = (mix(mix(self.context.astype(np.uint64), 62) + part, 63) % np.uint64(plan.pair_buckets)).astype(np.int64)
        order = np.lexsort((self.word, self.context, self.bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[self.pair]
        for name in ("context", "word", "word_counts", "spread", "bucket"):
            setattr(self, name, getattr(self, name)[order])
        # Runs of one context in one bucket.
        new = np.ones(len(order), bool)
        new[1:] = (self.context[1:] != self.context[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.starts = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        learned = ~np.repeat(np.array(row["held"], bool), sizes)
        self.seen = np.bincount(self.pair[learned[self.known]], minlength=len(order))


def _send_pairs(blocks: pa.Table, plan: _Plan) -> pa.Table:
    """What a block sends; its row comes alone."""
    found = []
    for row in blocks.to_pylist():
        p = _Pairs(row, plan)
        steps = np.diff(p.word, prepend=0)
        steps[p.starts] = p.word[p.starts]
        run_sizes = np.diff(np.append(p.starts, len(p.context)))
        run_bucket = p.bucket[p.starts]
        for a, b in _runs(run_bucket):
            first, end = p.starts[a], p.starts[a] + run_sizes[a:b].sum()
            contexts = p.context[p.starts[a:b]]
            found.append(
                (
                    int(run_bucket[a]),
                    row["block"],
                    pack_gaps(contexts),
                    pack_ints(run_sizes[a:b]),
                    pack_ints(steps[first:end]),
                    pack_ints(p.seen[first:end]),
                    pack_ints(p.word_counts[first:end]),
                    pack_gaps(contexts[p.spread[p.starts[a:b]]]),
                )
            )
    return pa.Table.from_batches([_rows(found, _PAIRS_SENT_ARROW)] if found else [], _PAIRS_SENT_ARROW)


def _count_pairs(sent: pa.Table, vocabulary: Vocabulary) -> pa.Table:
    """Answers to the blocks; rows without block hold the bucket's totals and what it has of spread contexts."""
    bucket = sent["bucket"][0].as_py()
    column = lambda name, unpack=unpack_ints: [unpack(x) for x in sent[name].to_pylist()]
    contexts, sizes = column("contexts", unpack_gaps), column("sizes")
    runs = np.cumsum([0, *(len(x) for x in sizes)])
    sizes = np.concatenate(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Steps to word numbers, anew at each run.
    steps = np.cumsum(np.concatenate(column("words")))
    words = steps - np.repeat(np.where(starts > 0, steps[starts - 1], 0), sizes)
    run_context = np.concatenate(contexts)
    known, run_place = np.unique(run_context, return_inverse=True)
    word_known, word_place = np.unique(words, return_inverse=True)
    key = np.repeat(run_place, sizes) * len(word_known) + word_place
    distinct, first, pair = np.unique(key, return_index=True, return_inverse=True)
    seen = np.bincount(pair, np.concatenate(column("seen"))).astype(np.int64)
    own = vocabulary.own(np.concatenate(column("counts"))[first])
    of = distinct // len(word_known)
    met = seen > 0
    numbers = np.zeros((len(known), NUMBERS), np.int64)
    numbers[:, 0] = np.bincount(of, seen, len(known))
    numbers[:, 1] = np.bincount(of[met], minlength=len(known))
    for r in range(1, K + 1):
        numbers[:, 1 + r] = np.bincount(of[seen == r], minlength=len(known))
    own = np.bincount(of[met], own[met], len(known))
    rows = []
    for i, block in enumerate(sent["block"].to_pylist()):
        a, b = runs[i], runs[i + 1]
        some = run_place[a:b]
        counts = seen[pair[starts[a] : ends[b - 1]]]
        rows.append((bucket, block, pack_ints(counts), pack_ints(numbers[some].ravel()), own[some].tobytes(), None, None))
    rows.append((bucket, None, None, None, None, _met(seen, K + 1), None))
    spread = np.unique(np.concatenate(column("spread", unpack_gaps)))
    for i in np.searchsorted(known, spread):
        rows.append((bucket, None, None, None, own[i : i + 1].tobytes(), numbers[i].tolist(), int(known[i])))
    return pa.Table.from_batches([_rows(rows, _PAIRS_ARROW)])


@dataclass(frozen=True)
class Model:
    """What all tasks need besides the tables: vocabulary, discounts of pairs, and spread contexts."""

    vocabulary: Vocabulary
    pairs: Discount
    contexts: np.ndarray
    numbers: np.ndarray
    own: np.ndarray

    def weights(self, numbers: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that a context's counts are divided by, and its backoff weight."""
        lost = self.pairs.lost(numbers)
        total = numbers[:, 0] + (lost == 0)
        left = np.where(lost > 0, lost, 1.0) / total
        return total, left / (1 - own)


def _evaluate(blocks: pa.Table, plan: _Plan, model: Model) -> pa.Table:
    """Scores of a block's documents; its row comes alone."""
    made = []
    for row in blocks.to_pylist():
        p = _Pairs(row, plan)
        score = np.log10(model.vocabulary.own(p.counts))
        backed_off = np.ones(len(p.counts), bool)
        if len(p.context):
            answers = sorted(row["pairs"], key=lambda x: x["bucket"])
            counts = np.concatenate([unpack_ints(x["counts"]) for x in answers])
            numbers = np.concatenate([unpack_ints(x["numbers"]) for x in answers]).reshape(-1, NUMBERS)
            own = np.concatenate([np.frombuffer(x["own"], np.float64) for x in answers])
            spread = np.flatnonzero(p.spread[p.starts])
            if len(spread):
                at = np.searchsorted(model.contexts, p.context[p.starts[spread]])
                numbers[spread], own = model.numbers[at], own.copy()
                own[spread] = model.own[at]
            total, weight = model.weights(numbers, own)
            met = counts > 0
            pair = np.log10(weight)[p.run]
            pair[met] = np.log10(model.pairs.lowered(counts[met]) / total[p.run[met]])
            backed_off[p.known] = ~met[p.pair]
            score[p.known] = np.where(met[p.pair], 0, score[p.known]) + pair[p.pair]
        base = model.vocabulary.base(p.counts)
        sums = lambda x: np.add.reduceat(x, p.firsts)
        made.append(
            pa.table(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "held_out": pa.array(row["held"], pa.bool_()),
                    "n_tokens": pa.array(p.sizes),
                    "n_known": pa.array(sums((p.counts > 0).astype(np.int64))),
                    "n_backed_off": pa.array(sums(backed_off.astype(np.int64))),
                    "base_score": pa.array(sums(base)),
                    "score": pa.array(sums(score)),
                }
            )
        )
    return pa.concat_tables(made)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_backed_off long, base_score double, score double"


def _blocks(docs: DataFrame, held: Column, block_bytes: int) -> tuple[DataFrame, str]:
    """The table of blocks, bucketed by block, and its name."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(True)).alias("held"))
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    # At least as many as shuffle partitions, so that joins shuffle the other side alone.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / (4 * block_bytes)))
    name = f"tidemark_blocks_{uuid.uuid4().hex[:12]}"
    made = narrow.mapInArrow(lambda x: lean(_tokenise(x, block_bytes)), _BLOCKS)
    writer = made.write.bucketBy(buckets, "block").sortBy("block").option("path", work_dir(spark, "blocks"))
    writer.format("parquet").saveAsTable(name)
    return spark.table(name), name


def _sum_lists(rows: DataFrame, n: int) -> list[int]:
    sums = rows.agg(*(F.sum(F.col("totals")[i]).alias(f"n{i}") for i in range(n))).first()
    return [x or 0 for x in sums]


def katz_scores(
    docs: DataFrame,
    held: Column | None = None,
    block_bytes: int = BLOCK_BYTES,
    words_per_bucket: int = WORDS_PER_BUCKET,
    pairs_per_bucket: int = PAIRS_PER_BUCKET,
    context_tokens: int = CONTEXT_TOKENS,
) -> DataFrame:
    """Scores of all documents by a model of those that are not ``held`` (by default ``held_out()``).

    Per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``n_backed_off``, ``train_tokens``, ``base_score``
    and ``score``, log10 probabilities."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, name = _blocks(docs, held_out() if held is None else held, block_bytes)
    sizes = blocks.agg(F.sum("tokens_in").alias("tokens"), F.sum("distinct_in").alias("distinct")).first()
    tokens, distinct = sizes["tokens"] or 0, sizes["distinct"] or 0
    word_buckets = max(partitions, math.ceil(distinct / words_per_bucket))
    sent = blocks.select("block", "words", "seen").mapInArrow(lambda x: _send_words(x, word_buckets), _WORDS_SENT)
    words = written(sent.groupBy("bucket").applyInArrow(lambda x: _count_words(x, word_buckets), _WORDS), "vocabulary")
    vocabulary = Vocabulary.of(_sum_lists(words.where("block is null"), K + 3))

    spread = max(vocabulary.tokens // MOST_CONTEXTS, min(context_tokens, vocabulary.tokens // (4 * partitions)), 1)
    plan = _Plan(word_buckets, max(partitions, math.ceil(tokens / pairs_per_bucket)), spread)
    answers = words.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "ids", "counts")).alias("answers"))
    met = blocks.select("block", "held", "sizes", "words", "tokens").join(answers, "block")
    # Joined by block, rows lie by block: one at a time in Python.
    sent = met.groupBy("block").applyInArrow(lambda x: _send_pairs(x, plan), _PAIRS_SENT)
    pairs = written(sent.groupBy("bucket").applyInArrow(lambda x: _count_pairs(x, vocabulary), _PAIRS), "pairs")
    discount = Discount.of(_sum_lists(pairs.where("block is null and context is null"), K + 1))
    # At most tokens / spread contexts.
    parts = pairs.where("context is not null").select("context", "totals", "own").collect()
    contexts, numbers, own = _add_up([(r["context"], r["totals"], r["own"]) for r in parts])
    model = Model(vocabulary, discount, contexts, numbers, own)

    found = (
        pairs.where("block is not null")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "counts", "numbers", "own")).alias("pairs"))
    )
    met = blocks.select("block", "doc_ids", "held", "sizes", "words", "tokens").join(answers, "block").join(found, "block", "left")
    scores = met.groupBy("block").applyInArrow(lambda x: _evaluate(x, plan, model), _SCORES)
    return scores.withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long"))


def _add_up(rows: list[tuple[int, list[int], bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, at = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
    numbers, own = np.zeros((len(contexts), NUMBERS), np.int64), np.zeros(len(contexts))
    if rows:
        np.add.at(numbers, at, np.array([r[1] for r in rows], np.int64))
        np.add.at(own, at, np.array([np.frombuffer(r[2], np.float64)[0] for r in rows]))
    return contexts, numbers, own
