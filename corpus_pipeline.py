"""The training-data pipeline: stages over ``documents``, each written before the next.

Part of the corpus subpackage.  Every stage takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import toxicity as tox
from cloudloom.llm.common import table, written
from cloudloom.llm.decontaminate import decontaminate
from cloudloom.llm.line_dedup import line_dedup
from cloudloom.llm.ngram_join import ngram_classes
from cloudloom.llm.packing import pack_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects at their language's threshold go.

    Null and empty texts have the score of no words; an empty table stays empty.
    """
    return tox.classify(docs, table(spark, sf_dir, "labels")).where(~F.col("toxic")).select(docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; every document stays, if with an empty text.

    A null text becomes an empty one; n_chars is counted again.
    """
    out = line_dedup(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id.

    Classes are linked by Jaccard similarity 0.8 or more of five-word shingles.  Of rows
    repeated under one id one stays; rows without an id all stay.
    """
    classes = written(ngram_classes(docs, width=5, percent=80), "classes")
    copies = classes.where("component_id < doc_id").select("doc_id").distinct()
    out = docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    again = classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.take(1):
        once = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
        out = out.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null, empty and very short texts hold none and stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents left in sequences of 2048 tokens; a null or empty text is its end mark."""
    return pack_documents(docs, capacity=2048, end_id=0, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
