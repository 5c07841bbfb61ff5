"""The queries of the training-data operators, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import byte_bpe, licenses, mixing, mtree, one_bit_codes, quality, simhash, token_counts, toxicity, warc
from vertexloom.llm._common import drop_table, read_table, scratch_path


def _vocabulary() -> str:
    import public_tokenizers

    if public_tokenizers.PATTERN != byte_bpe.PATTERN:
        raise ValueError("the tokenizer splits texts by another pattern than the automaton's")
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), _vocabulary())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op3-warc")
    found = warc.page_digests(read_table(spark, sf_dir, "pages"), path)
    drop_table(spark, path)  # what was read back is checkpointed
    return found


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix().decide(read_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licences(read_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(read_table(spark, sf_dir, "documents"), _vocabulary())


def op10_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_codes.approximate_top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_toxicity, op3_warc, op4_quality, op5_mtree_top_k, op6_simhash, op7_mixing, op8_licenses, op9_byte_bpe, op10_one_bit_codes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The classifiers, the searches, the fingerprints and the tokenizer have no SQL; their tests hold them against brute force."""
    return {"op3_warc": warc.ORACLE, "op7_mixing": mixing.ORACLE, "op8_licenses": licenses.ORACLE}
