"""The corpus pipeline: documents to packed training sequences.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which run() writes as Parquet in the shared folder and reads again as the
next one's docs. All but the last return the columns of documents. What a stage wrote on
its way, and what it read, is deleted once its own result has been written.

Every stage takes nulls in any column, empty and very long texts, repeated rows, columns
with any other names and empty tables (which stay empty): each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import common, minhash, packing, quality, suffix_dedup, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts, which have no
    words, among them. Repeated rows stay or go together."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones among them calls toxic go. Without
    labels of both classes, or for a text without terms, the rate of toxic labels decides.
    Repeated rows stay or go together."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays, once if
    its row is repeated; of a class without a doc_id one row. Null texts count as empty, and
    texts without words are alike if equal."""
    return minhash.keep_one(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier go; every document stays, if need be
    with an empty text, and null texts stay null. A null doc_id is before all others."""
    return suffix_dedup.without_repeats(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the documents' token pieces lie in sequences of at most 4096 tokens. Null and
    empty texts are an end token alone; repeated rows are packed as often as they occur."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("best_fit_packing", sequence_packing),
]

#: The trained model, the tokenizer and the merged transforms have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, read = common.finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir)), before
        before = docs
        if read is not None:
            common.dropped(read)
    return docs
