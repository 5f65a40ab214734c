"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage takes the session, the documents that the stage before it kept, and the folder of the tables.
All but the last return the columns of ``documents``. Empty inputs give empty results; rows with a
null ``doc_id`` pass the filters on their text alone and are never counted as copies. Both quality
stages learn from the raw documents and labels of the folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mil_quality, quality_rules
from tidemark.llm.ngram_join import class_of, ngram_jaccard_components
from tidemark.llm.packing import pack_documents
from tidemark.llm.store import table
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.session import written


# Bytes of a batch between Spark and Python: a task holds few of them at a time.
BATCH_BYTES = 8 << 20


def _bounded_batches(spark: SparkSession) -> None:
    """A setting of this application's session; it stays after the stage."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good."""
    _bounded_batches(spark)
    raw = table(spark, sf_dir, "documents")
    model = mil_quality.fit(raw, mil_quality.quality_labels(table(spark, sf_dir, "labels")))
    scored = mil_quality.score_quality(docs, model)
    return scored.where(F.col("score") >= mil_quality.THRESHOLD).select("row.*")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base statistics and the decision list, learned from the raw documents:
    stage 1 leaves hardly a bad one to learn from."""
    _bounded_batches(spark)
    raw, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality_rules.fit_rules(raw, quality_rules.quality_labels(labels))
    return quality_rules.apply_rules(docs, rules).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row with its smallest id. Rows under one id with different texts
    are documents of their own; those with equal words are copies."""
    _bounded_batches(spark)
    groups = ngram_jaccard_components(docs)
    first = groups.where("doc_id = component_id").groupBy("component_id").agg(F.min("class").alias("of"))
    kept = first.select(F.col("component_id").alias("_id"), F.col("of").alias("_class"))
    # Words are hashed in one pass over the texts: a filter on the class, or a second branch, would be another.
    rows = docs.where("doc_id is not null").withColumn("_words", class_of("text"))
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_words") == F.col("_class"))
    # A text without words is in no class; under its id it is a copy of its like.
    chosen = rows.join(kept, same, "left").where("_words is null or _id is not null")
    chosen = chosen.withColumn("_wordless", F.when(F.col("_words").isNull(), F.col("text")))
    chosen = chosen.dropDuplicates(["doc_id", "_words", "_wordless"]).select(*docs.columns)
    return chosen.union(docs.where("doc_id is null"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    _bounded_batches(spark)
    changed = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    # Texts cross to Python once.
    made = substring_dedup(docs, carry=tuple(c for c in docs.columns if c not in changed))
    return made.select(*(changed[c].alias(c) if c in changed else f"carried.{c}" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    _bounded_batches(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", remove_repeats),
    ("packing", pack),
]

# Learned verdicts are beyond SQL; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
