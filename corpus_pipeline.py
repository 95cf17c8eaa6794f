"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and packing, one after another.

Each stage works on all that its predecessor kept; between stages the documents are written as Parquet and read again.
Null and empty texts, repeated rows and extra columns are treated as each operator's module states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import settle
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.mixing import mix
from quarry.llm.near_copies import keep_one
from quarry.llm.packing import pack_documents
from quarry.llm.quality_rules import filter_documents
from quarry.llm.queries import word_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules learned from ``labels`` reject go; the others stay unchanged."""
    return filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document (or line) has go, from ten words on up to one word edit; every document stays."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more of their five-word shingles the document with the smallest
    id stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken towards their weights: a document stands in the result as often as the mix takes it."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack_documents(docs, word_vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The learned rules, fingerprints and seeded draws have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"stage{k}")
    return docs
