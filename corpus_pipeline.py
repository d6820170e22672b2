"""A corpus pipeline over documents: quality, repeated lines, near-duplicates, benchmark passages, packing.

Each stage is written as Parquet and read back as the next one's docs. All but the last return the columns of
documents. Stages keep rows with a null id or text unless their own rule rejects them; a null text scores as an
empty one, has no lines and no words, and is packed as the end token alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import written
from riskloom.llm.decontaminate import decontaminate
from riskloom.llm.line_dedup import dedup_lines
from riskloom.llm.packing import pack
from riskloom.llm.quality import keep_quality
from riskloom.llm.simhash import near_dedup


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has, exactly or within a few edits, go."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its place in a sequence."""
    return pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", distinct_lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", clean_of_benchmark),
    ("best-fit packing", packed),
]

#: The classifier, the edit join and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
