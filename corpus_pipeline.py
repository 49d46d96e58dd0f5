"""A training corpus from documents: rules, near duplicates, repeated passages, mix, packing.

Each stage reads what the one before kept. All but the last return the columns
of documents. The mix may take a document up to three times: it then has a row
for each taking, so that the packer sees its words as often as they count; a
document of which blocks cut a part is taken as a whole.

Defined results: a null or empty text fails the quality rules and goes; null ids
are documents by their texts; of ties and repeated rows one of each id and text is
decided for all, and rows of the id that stays stay; very long texts pass whole;
empty tables give no rows; other columns, whatever their names, pass to the last
stage. Without ``tessera.llm`` this module can't be imported: ``__spark_entry__``
then leaves its query out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from tessera.llm.scratch import Scratch


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that lose too much, or fail the base rules, go."""
    return quality_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by 50-byte strings of documents with smaller ids go."""
    return suffix_dedup.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken by size, rounded, once at least if any are taken."""
    return mixing.repeat_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to weights", mixed),
    ("packing", packed),
]

#: Tokenizers and passages cut inside characters can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tmp = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tmp.table(name.replace(" ", "-"), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
