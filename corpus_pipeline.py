"""The corpus pipeline: quality, near duplicates, contamination, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns the columns of documents; the last returns the
packed pieces.

Every stage takes texts of any length whole, and a table without rows gives
none. Further columns of documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, ngram_join, packing, quality, secrets
from quillstone.llm.common import stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go.

    Null and empty texts are scored as a bag of one empty passage; rows that repeat score alike, and so go or stay
    together. Without usable labels every score is 0.5, so all stay.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id, null last.

    Rows that repeat both doc_id and text are one, and among equal ids the first row wins. Null, empty and blank texts
    are copies of nothing and all stay.
    """
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; rows that repeat go or stay together; items without words hit nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text and n_chars counted anew; every document stays.

    Null stays null and empty stays empty; rows that repeat are changed alike; overlapping secrets are replaced once.
    """
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids.

    Null and empty texts are the one id that ends a document; rows that repeat are packed each; ties along the curve go
    by row.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", packing_stage),
]

#: SQL has no trained classifier and no tokenizer; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
