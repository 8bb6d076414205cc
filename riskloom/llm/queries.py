"""The thirteen registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import (
    attention_lm, byte_cnn, chunk_recipes, decontaminate, html_text, packing, quality_rules, sharding, simhash, spelling_variants, substring_dedup,
    token_counts, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, _table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, *quality_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 24)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), 4096)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), 4096)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.exact_duplicates(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 16)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_byte_cnn, op2_substring_dedup, op3_simhash, op4_attention_lm, op5_decontaminate, op6_quality_rules, op7_sharding, op8_token_counts,
            op9_packing, op10_html_text, op11_chunk_recipes, op12_whitening, op13_spelling_variants,
        )
    }


# Equal texts, sizes and digests of a text are SQL; the chunks that the operator compares are not needed for them.
OP11_SQL = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""


def llm_oracles() -> dict[str, str]:
    """The others need trained weights, XXH64, a tokenizer, alignments, a parser, eigenvectors or CRC-32, which are no SQL."""
    return {"op11_chunk_recipes": OP11_SQL}
