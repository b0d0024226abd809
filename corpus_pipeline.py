"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents.

Defined results: null and empty texts have no lines and are judged by the share of good labels; among each other they are equal, and the largest
doc_id stays; they are near to nothing, stay null or empty, and become one piece that holds the end id. Texts of any length pass whole. Of rows
that share doc_id and text one stays; a row without doc_id is judged like any other and is linked with nothing near. Ties fall to the largest
doc_id among equal texts and to the smallest among near ones. Further columns pass through all stages but the last, whatever their names. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import common, exact_dedup, line_crf, minhash_dedup, packing, pii


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects go."""
    return line_crf.kept(docs, line_crf.fitted(docs, common.labels(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word runs, similarity 0.8 or more) the smallest doc_id stays."""
    return minhash_dedup.deduplicated(docs, width=5)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind in brackets."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, its place there, and its sequence and offset."""
    return packing.packed(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("pii_redaction", private), ("best_fit_packing", packed)]
#: The classifier and the packing are beyond SQL; run() is tested against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
