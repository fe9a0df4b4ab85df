"""Documents to packed training sequences: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes
each stage's rows to the shared folder and reads them again, so a lost executor costs a stage's tasks and no more.

Cases, for every stage: an empty table gives no rows with the usual columns; other columns, whatever their names, are kept by all
stages but the last and ignored by that; very long texts are handled whole. Nulls, empty texts and repeated rows: see each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import ngram_join, packing, pii, quality_rules, substring_dedup
from matchloom.llm.common import small_batches, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts have no words, so they go; a null language is a language of
    its own; repeated rows are judged alike, so all of them stay or go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by near copies, the one with the least doc_id stays. Null doc_ids come after all others; null
    and empty texts are linked with nothing and stay, one of those with equal doc_id; of repeated rows one stays."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that also stand elsewhere are cut out; the text left may be empty. Null and empty texts stay as
    they are. Repeated rows lose what they share, both of them."""
    return substring_dedup.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets. Null and empty texts stay as they are; repeated rows are masked alike."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its ids and its place in a sequence of at most 4096. A null or empty text is its end id
    alone; a null doc_id stays null; each of repeated rows is packed."""
    with small_batches(spark):
        return stored(spark, packing.pack_documents(docs), "pieces")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("PII", personal_data), ("packing", packed)]

#: SQL can't say the verdicts of the rules, the field's spans or best-fit packing; tests hold each stage
#: and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, "stage")
    return docs
