"""The corpus pipeline: language ID, toxicity, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
other columns, whatever their names, are dropped first. Stages read what the stage before them wrote, as Parquet, so
that a row's place in it tells it apart from rows with the same id or text. Every stage takes null ids, texts and
languages, empty and very long texts, repeated rows and an empty table, as its own docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.op_anchor_simhash import simhash_components
from lodestone.llm.op_exact_dedup import exact_groups
from lodestone.llm.op_pattern_packing import pack
from lodestone.llm.op_pu_toxicity import keep_clean, train_toxicity
from lodestone.llm.op_subword_langid import keep_accepted, train_language_model
from lodestone.session import remove_folder, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The row's place in the table that a stage reads: its partition and its place in that.
ROW = "_row"


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id())


def _only(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose places are in `kept` (column ROW). Texts are shuffled once, by their places, which are unique."""
    return placed.join(kept.select(ROW), ROW, "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects; it learns from the languages that documents state.

    Null and empty texts, and those without a letter, are rejected; a null id or language is no reason to. Where no
    document states a language, all are rejected. Very long texts are read whole. Rows that repeat, and rows whose
    languages tie, are judged alike, each by itself. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    return keep_accepted(docs, train_language_model(docs, fold=None))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents predicted toxic; it learns from the labels of all labelled documents.

    Null and empty texts hold nothing toxic and stay; documents with a null id have no label but are judged. Without a
    toxic label all stay. A score of just the threshold is toxic. Very long texts are read whole. Rows that repeat are
    judged alike. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    return keep_clean(docs, train_toxicity(docs, table(spark, sf_dir, "labels"), fold=None))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: the longest, then of the smallest id (null last), then the first.

    Null and empty texts, and those of white space alone, are one group. Rows that repeat an id with different texts are
    documents of their own; rows that repeat an id and a text are one group. Very long texts are compared in chunks. An
    empty table stays empty.
    """
    docs = _placed(docs)
    return _only(docs, exact_groups(docs, row_col=ROW).filter("kept").withColumnRenamed("uid", ROW))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that SimHash links: that of the smallest id (null last), then the first.

    Texts without words are a group, with all whose fingerprints it links. Rows that repeat an id are documents of their
    own. Very long texts are hashed whole. An empty table stays empty.
    """
    docs = _placed(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = simhash_components(docs, row_col=ROW).groupBy("root").agg(first.alias("first"))
    return _only(docs, kept.select(F.col("first.row").alias(ROW)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into sequences; one row per piece.

    Null and empty texts are the end token alone; null and repeated ids, and equal texts, are documents each; very long
    texts are cut into pieces. An empty table gives no pieces.
    """
    return pack(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]

#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the shared folder and read again. A
    stage's folder is removed once the next one is written; the last one's holds the result."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        own = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(own), own
    return docs
