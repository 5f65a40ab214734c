"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded (its mix of bytes,
word lengths and repeated words, then a learned layer); gated attention, ``softmax(w . (tanh(V h) *
sigmoid(U h)))``, weighs the passages, and the weighted sum of their encodings is scored. The
weights come from document labels alone: nothing says which passage made a document bad.

Training takes at most ``MAX_PER_LABEL`` rows of each label, those with the smallest hash of ``doc_id``, and of
these, in that order, as many as have ``MAX_PASSAGES`` passages together; a row is learned from with all its
passages or not at all. Both bounds are parameters. Scoring reads whole texts, in the tasks that read them, and
shuffles nothing; only texts go to Python, and only scores come back.

Rules: a null or empty text is one passage without words. Labels of a document that contradict each
other, null labels and labels without document are not learned from, nor is a row repeated. With only one label, or
none, every score is the share of 1 among the labels learned from (0.5 without any). Columns
besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import lean, written
from tidemark.llm.words import Words, text_blocks

PASSAGE_WORDS = 64
MAX_PER_LABEL, MAX_PASSAGES = 2_000, 200_000
THRESHOLD = 0.3
FOLDS = 5
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 32, 16, 30, 64, 0.01, 1e-4

# Kinds of bytes: lower case, upper case, digit, space, line end, beyond ASCII, control; each mark.
_KIND = np.full(256, 6, np.int64)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord(" ")], _KIND[ord("\n")], _KIND[128:] = 3, 4, 5
_MARKS = [i for i in range(33, 127) if _KIND[i] == 6]
_KIND[_MARKS] = np.arange(7, 7 + len(_MARKS))
KINDS = 7 + len(_MARKS)
FEATURES = KINDS + 7


def passages(data: np.ndarray, offs: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a block of texts, and the number of passages of each text."""
    words = Words(data, offs)
    per_text = np.maximum(-(-words.counts // size), 1)
    firsts = np.cumsum(per_text) - per_text
    total = int(per_text.sum())
    owner = words.owners()
    of_word = firsts[owner] + (np.arange(len(owner)) - words.bounds[owner]) // size
    # A passage's bytes run from its first word to the next passage; a text's first begins with the text.
    starts = np.empty(total, np.int64)
    begins = np.flatnonzero(np.diff(of_word, prepend=-1))
    starts[firsts] = offs[:-1]
    inner = np.ones(total, bool)
    inner[firsts] = False
    starts[of_word[begins]] = np.where(inner[of_word[begins]], words.starts[begins], starts[of_word[begins]])
    sizes = np.diff(np.append(starts, len(data)))
    of_byte = np.repeat(np.arange(total), sizes)
    kinds = np.bincount(of_byte * KINDS + _KIND[data], minlength=total * KINDS).reshape(total, KINDS)

    n = np.bincount(of_word, minlength=total).astype(np.float64)
    length = (words.ends - words.starts).astype(np.float64)
    some = np.maximum(n, 1)
    mean = np.bincount(of_word, length, total) / some
    spread = np.sqrt(np.maximum(np.bincount(of_word, length**2, total) / some - mean**2, 0))
    longest = np.zeros(total)
    hashes = words.hashes()
    again = np.zeros(total)
    twice = np.zeros(total)
    if len(owner):
        longest[of_word[begins]] = np.maximum.reduceat(length, begins)
        same = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        twice = np.bincount(of_word[1:][same], minlength=total) / some
        order = np.lexsort((hashes, of_word))
        same = (hashes[order][1:] == hashes[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
        again = np.bincount(of_word[order][1:][same], minlength=total) / some
    rest = np.stack([np.log1p(n), mean / 8, spread / 8, np.log1p(longest), again, twice, (n > 0) * 1.0], axis=1)
    # Square roots, so that a few marks among many letters are seen.
    mix = np.sqrt(kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1))
    return np.concatenate((mix, rest), axis=1).astype(np.float32), per_text


@dataclass(frozen=True)
class Model:
    """Weights of the network; without any, ``share`` is every document's score."""

    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, ...] = ()

    def scores(self, x: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text and attention of each passage."""
        if not self.weights:
            return np.full(len(per_text), self.share), np.repeat(1 / per_text, per_text)
        made = _forward(self.weights, (x - self.mean) / self.scale, per_text)
        return made["score"], made["attention"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(weights: tuple[np.ndarray, ...], x: np.ndarray, per_text: np.ndarray) -> dict[str, np.ndarray]:
    w1, b1, v, u, a, c, b = weights
    firsts, owner = np.cumsum(per_text) - per_text, np.repeat(np.arange(len(per_text)), per_text)
    h = np.tanh(x @ w1 + b1)
    tv, su = np.tanh(h @ v), _sigmoid(h @ u)
    e = (tv * su) @ a
    e = np.exp(e - np.maximum.reduceat(e, firsts)[owner])
    attention = e / np.add.reduceat(e, firsts)[owner]
    z = np.add.reduceat(attention[:, None] * h, firsts, axis=0)
    return {"h": h, "tv": tv, "su": su, "attention": attention, "z": z, "owner": owner, "score": _sigmoid(z @ c + b[0])}


def _gradients(weights, x, per_text, label, importance) -> list[np.ndarray]:
    """Of the weighted log loss."""
    w1, b1, v, u, a, c, b = weights
    m = _forward(weights, x, per_text)
    h, tv, su, att, owner = m["h"], m["tv"], m["su"], m["attention"], m["owner"]
    d = importance * (m["score"] - label) / importance.sum()
    dz = d[:, None] * c
    da = (h * dz[owner]).sum(axis=1)
    firsts = np.cumsum(per_text) - per_text
    de = att * (da - np.add.reduceat(att * da, firsts)[owner])
    dtv, dsu = de[:, None] * a * su * (1 - tv**2), de[:, None] * a * tv * su * (1 - su)
    dh = att[:, None] * dz[owner] + dtv @ v.T + dsu @ u.T
    dx = dh * (1 - h**2)
    return [x.T @ dx, dx.sum(axis=0), h.T @ dtv, h.T @ dsu, (tv * su).T @ de, m["z"].T @ d, np.array([d.sum()])]


def train(x: np.ndarray, per_text: np.ndarray, label: np.ndarray, importance: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam; ``importance`` weighs the documents of a balanced sample as they occur."""
    share = float((importance * label).sum() / importance.sum()) if len(label) else 0.5
    if len(np.unique(label)) < 2:
        return Model(share)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.01
    x = ((x - mean) / scale).astype(np.float64)
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, ATTENTION), (HIDDEN, ATTENTION), (ATTENTION,), (HIDDEN,), (1,)]
    weights = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or s[0] > 1 else np.zeros(s) for s in shapes]
    weights[1][:] = 0
    first, second, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    starts = np.cumsum(per_text) - per_text
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            rows = np.concatenate([np.arange(starts[j], starts[j] + per_text[j]) for j in some])
            found = _gradients(weights, x[rows], per_text[some], label[some], importance[some])
            step += 1
            for k, g in enumerate(found):
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(share, mean, scale, tuple(w.astype(np.float32) for w in weights))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offs in text_blocks(batch["text"]):
            x, per_text = passages(data, offs)
            ends = np.cumsum(per_text)
            bags = [x[end - n : end].astype("<f4").tobytes() for end, n in zip(ends, per_text)]
            rows = batch.slice(first, last - first)
            made = [rows["label"], rows["place"], pa.array(per_text.astype(np.int64)), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["label", "place", "n", "bag"])


def fit(
    docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, max_passages: int = MAX_PASSAGES
) -> Model:
    """Learn from ``labels`` (doc_id, label 0 or 1); see the bounds above."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    clean = (
        labels.where("doc_id is not null and label in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("label").cast("int").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
        # Labels of absent documents take no place in the sample.
        .join(narrow.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    counts = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        some = clean.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_label)
        chosen = some if chosen is None else chosen.union(some)
    # Broadcast: at most 2 * max_per_label narrow rows.
    met = narrow.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    order = [F.xxhash64("doc_id"), F.xxhash64("text")]
    # An id may have many texts.
    bounded = reduce(
        DataFrame.union, (met.where(F.col("label") == x).orderBy(*order).limit(max_per_label) for x in (0, 1))
    )
    placed = bounded.withColumn("place", F.struct(F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b")))
    bags = written(
        placed.select("label", "place", "text").mapInArrow(
            lambda x: lean(_bags(x)), "label int, place struct<a: long, b: long>, n long, bag binary"
        ),
        "bags",
    )
    # At most max_per_label rows a label.
    so_far = F.sum("n").over(Window.partitionBy("label").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    whole = bags.withColumn("so_far", so_far).where(F.col("so_far") <= max_passages // 2)
    rows = sorted((r["label"], bytes(r["bag"])) for r in whole.select("label", "bag").collect())
    if not rows:
        return Model(0.5)
    label = np.array([r[0] for r in rows], np.float64)
    parts = [np.frombuffer(r[1], "<f4").reshape(-1, FEATURES) for r in rows]
    importance = np.array([counts[int(y)] / max((label == y).sum(), 1) for y in label])
    return train(np.concatenate(parts), np.array([len(p) for p in parts]), label, importance)


_MADE = "struct<n_passages: long, top_attention: double, score: double>"


def _score(texts: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    for column in texts:
        parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for _, _, data, offs in text_blocks(column):
            x, per_text = passages(data, offs)
            score, attention = model.scores(x, per_text)
            most = np.maximum.reduceat(attention, np.cumsum(per_text) - per_text)
            parts.append((per_text.astype(np.int64), most.astype(np.float64), np.clip(score, 0, 1).astype(np.float64)))
        made = [pa.array(np.concatenate(x)) for x in zip(*parts)]
        yield pa.StructArray.from_arrays(made, names=["n_passages", "top_attention", "score"])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the columns given, as a struct), ``n_passages``, ``top_attention`` (the largest weight of a
    passage) and ``score``."""

    @F.arrow_udf(_MADE)
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lean(_score(texts, model))

    rows = docs.select(F.struct(*docs.columns).alias("row"), scored("text").alias("made"))
    return rows.select("row", "made.*")


def held_out(doc_id: str = "doc_id"):
    """The fold that nothing is learned from. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def quality_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
