"""Exact top-k search by inner product over integer vectors, pruned by length.

Vectors are sorted by falling length into blocks. They are rotated onto the eigenvectors of their
Gram matrix (the right singular vectors), so that the first few components hold most of a
product. Queries go over the blocks in rounds, the longest vectors first: one block, one more, two, four
and so on. What they have found so far is their threshold in the next round, where

* a block whose longest vector times the query is below the threshold is not visited; once no block is
  left for any query, the search ends, and
* a vector whose product over the leading components, plus the product of the remaining lengths
  (Cauchy-Schwarz), is below it is passed over.

What is left gets its exact integer product. Bounds carry a margin for rounding and keep ties. Query
blocks and vector blocks meet through a join on the block numbers that a query block still needs; a
joined row is one task's piece of work, so vector blocks are shuffled once a round and not once a pair.

Rules: vectors that are null, hold null or non-finite components, or have no ``vec_id`` take no part. Only
vectors with as many components have a product, so each width is searched by itself. A row repeated
takes part once a row; a query repeated gets one answer, that of its first row in (``vec_id``,
components) order, whose width counts.
Columns besides ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import written

SCALE, K, EVERY = 256, 5, 50
BLOCK_ROWS, QUERY_ROWS = 8_192, 512
LEAD_SHARE = 0.9
_BLOCK = "block long, ids binary, vectors binary, longest double"
_QUERIES = "q_block long, q_ids binary, q_vectors binary, least binary, reach double"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def to_integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``v`` (floor of scale times each component) and its squared length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rounded = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return (
        vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
        .where(finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"), rounded.alias("v"))
        .withColumn("squared", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy().reshape(-1, width)


def _gram(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width, width))
    for batch in batches:
        x = _matrix(batch["v"], width).astype(np.float64)
        total += x.T @ x
    yield pa.RecordBatch.from_pydict({"gram": pa.array([total.tobytes()], pa.binary())})


def _rotation(integers: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Eigenvectors by falling weight, and how many carry ``LEAD_SHARE`` of it. One matrix of
    ``width`` squared numbers comes to the driver from each task's partition."""
    weight = np.zeros((width, width))
    for row in integers.mapInArrow(lambda x: _gram(x, width), "gram binary").toLocalIterator():
        weight += np.frombuffer(row["gram"]).reshape(width, width)
    values, vectors = np.linalg.eigh(weight)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-12)
    return np.ascontiguousarray(vectors), int(min(np.searchsorted(share, LEAD_SHARE) + 1, width))


def _best(
    q: np.ndarray, query_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, rotation: np.ndarray, lead: int, k: int, least: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, the ids and scores of its best in one block, of those that may reach ``least``."""
    rq, rv = q @ rotation, v @ rotation
    rest_q, rest_v = (np.sqrt(np.square(x[:, lead:]).sum(axis=1)) for x in (rq, rv))
    partial = rq[:, :lead] @ rv[:, :lead].T
    margin = 1e-6 * (1 + np.sqrt(np.square(q).sum(axis=1)) * np.sqrt(np.square(v).sum(axis=1).max(initial=0)))
    iq, iv = q.astype(np.int64), v.astype(np.int64)
    for i in range(len(q)):
        bound = partial[i] + rest_q[i] * rest_v + margin[i]
        may = np.flatnonzero((bound >= least[i]) & (ids != query_ids[i]))
        if len(may) > 4 * k:
            # The most promising give a threshold for the others.
            some = may[np.argpartition(-bound[may], 4 * k)[: 4 * k]]
            floor = np.partition(iv[some] @ iq[i], -k)[-k]
            may = may[bound[may] >= floor]
        scores = iv[may] @ iq[i]
        order = np.lexsort((ids[may], -scores))[:k]
        yield i, ids[may][order], scores[order]


def _search(
    batches: Iterator[pa.RecordBatch], width: int, rotation: np.ndarray, lead: int, k: int
) -> Iterator[pa.RecordBatch]:
    """Each row is one block of queries and one block of vectors."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield _search_pair(batch.slice(i, 1).to_pylist()[0], width, rotation, lead, k)


def _search_pair(row: dict, width: int, rotation: np.ndarray, lead: int, k: int) -> pa.RecordBatch:
    queries, v = (np.frombuffer(row[c], "<i8").reshape(-1, width).astype(np.float64) for c in ("q_vectors", "vectors"))
    query_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
    out: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    least = np.frombuffer(row["least"], "<f8")
    for i, found, scores in _best(queries, query_ids, v, ids, rotation, lead, k, least):
        out[0].append(np.full(len(found), query_ids[i]))
        out[1].append(found)
        out[2].append(scores)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], schema=_HITS)


def _pack_vectors(rows: pa.Table, width: int) -> pa.Table:
    return pa.table(
        {
            "block": pa.array([rows["block"][0].as_py()], pa.int64()),
            "ids": pa.array([rows["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([_matrix(rows["v"], width).astype("<i8").tobytes()], pa.binary()),
            "longest": pa.array([float(np.sqrt(rows["squared"].to_numpy().max()))], pa.float64()),
        }
    )


def _pack_queries(rows: pa.Table, width: int) -> pa.Table:
    """With each query's threshold; no vector shorter than ``reach`` can meet any of them."""
    least = rows["least"].to_numpy()
    length = np.sqrt(rows["squared"].to_numpy().astype(np.float64))
    reach = np.where(least > 0, least / np.maximum(length, 1e-9), -np.inf).min()
    return pa.table(
        {
            "q_block": pa.array([rows["q_block"][0].as_py()], pa.int64()),
            "q_ids": pa.array([rows["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "q_vectors": pa.array([_matrix(rows["v"], width).astype("<i8").tobytes()], pa.binary()),
            "least": pa.array([least.astype("<f8").tobytes()], pa.binary()),
            "reach": pa.array([float(reach)], pa.float64()),
        }
    )


def _by_length(integers: DataFrame, width: int, rows: int, count: int) -> DataFrame:
    """Blocks of about ``rows`` vectors, numbered by falling length. Among equal lengths the hash
    of the id decides, so that many copies of a vector don't make one block."""
    n = max(1, -(-count // rows))
    ranged = integers.withColumn("at", F.xxhash64("vec_id")).repartitionByRange(n, F.desc("squared"), "at")
    numbered = ranged.withColumn("block", F.spark_partition_id().cast("long")).drop("at")
    return written(numbered.groupBy("block").applyInArrow(lambda x: _pack_vectors(x, width), _BLOCK), "blocks")


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for every row whose id is divisible by ``every``,
    the ``k`` highest products among all other rows, ties to the smaller id."""
    integers = written(to_integers(vectors, scale), "integers")
    asked = integers.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("v", "squared")).alias("one")).select("vec_id", "one.*")
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Widths are few: their number doesn't grow with the rows.
    for width, count in integers.groupBy(F.size("v").alias("width")).count().orderBy("width").collect():
        same = [x.where(F.size("v") == width) for x in (integers, asked)]
        found = found.union(_top_k_of_width(*same, width, count, k, every, block_rows, query_rows))
    return found


def _top_k_of_width(
    integers: DataFrame, asked: DataFrame, width: int, count: int, k: int, every: int, block_rows: int, query_rows: int
) -> DataFrame:
    rotation, lead = _rotation(integers, width)
    blocks = _by_length(integers, width, block_rows, count)
    spans = written(blocks.select("block", "longest"), "spans")
    blocks_end = (spans.agg(F.max("block")).first()[0] or 0) + 1
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-count // (every * query_rows)))))
    best = integers.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    begin, end = 0, 1
    while begin < blocks_end:
        floors = best.groupBy(F.col("query_id").alias("vec_id")).agg(
            F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor")
        )
        informed = asked.join(floors, "vec_id", "left").withColumn("least", F.coalesce("floor", F.lit(float("-inf"))))
        queries = written(
            informed.groupBy("q_block").applyInArrow(lambda x: _pack_queries(x, width), _QUERIES), "queries"
        )
        # Descriptors only. Blocks get shorter: where none of these is needed, no later one is.
        visited = spans.where((F.col("block") >= begin) & (F.col("block") < end))
        needed = written(
            queries.select("q_block", "reach").join(
                visited, F.col("longest") * (1 + 1e-9) + 1e-9 >= F.col("reach")
            ).select("q_block", "block"),
            "needed",
        )
        if needed.isEmpty():
            break
        pairs = needed.join(queries, "q_block")
        hits = pairs.join(blocks.drop("longest"), "block").mapInArrow(
            lambda x: _search(x, width, rotation, lead, k), "query_id long, vec_id long, score long"
        )
        ranked = best.drop("rank").union(hits).withColumn(
            "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        )
        best = written(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        begin, end = end, 2 * end
    return best
