"""From raw documents to packed token sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.session import checkpoint_dir
from riskloom.llm import decontaminate as q_grams
from riskloom.llm import packing, quality_rules, simhash, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted target is those labelled good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, *quality_rules.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id."""
    return simhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 50-word windows that a document of smaller id has."""
    return substring_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage within the edit budget."""
    return q_grams.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_rows=True, short=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", substrings),
    ("benchmark decontamination", decontamination), ("packing", pack),
]

# Trained ratios, XXH64, alignments and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; only the last one's rows stay in the shared folder."""
    root = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            where = spark._jvm.org.apache.hadoop.fs.Path(before)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        before = path
    return docs
