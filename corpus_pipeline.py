"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Stages work on all that their predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.llm import near_dup, packing, pii, quality, substring
from corollary.llm.common import drop_folder, shared_folder, table

#: Near duplicates share 80 % of their runs of five words.
SHINGLE, PERCENT = 5, 80
#: Rows that Spark hands to Python at a time: documents are long, and a task holds one batch of them.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def _in_batches(spark: SparkSession) -> None:
    """Batches of the session are of BATCH rows at most from now on."""
    if not 0 < int(spark.conf.get(BATCH[0])) <= BATCH[1]:
        spark.conf.set(*BATCH)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    _in_batches(spark)
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    _in_batches(spark)
    others = near_dup.linked(docs, k=SHINGLE, percent=PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has."""
    _in_batches(spark)
    return _counted(substring.cut(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    _in_batches(spark)
    return _counted(pii.redact(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    _in_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dup", one_of_each_group),
    ("substring", without_repeats),
    ("pii", without_personal_data),
    ("packing", sequences),
]

#: Stages train a classifier and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's folder goes when the next one's is written; the last one's stays for the result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
